import io
import random
import zipfile
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.functions import checks, segment
from weft.functions import text as T
from weft.operators import files, memory, protected, terms, upkeep
from weft.operators.dedup import first_delivery
from weft.sources import office, plain, snapshots
from weft.streaming import feeds


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n\t؟1A«»\"'", max_size=60))
def test_split_loses_nothing(text):
    parts = segment.split(text)
    assert "".join(a + b for a, b in parts) == text


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("A dog barks. Two cats.", 2), ("Abc. Two cats.", 1), ("Dr. Smith came. He left.", 2), ("It costs 3.5 crowns. Yes.", 2), ("Wait... what? Yes!", 2), ("1. First item", 1),
        ("Article 5. The tenant pays.", 1), ("Line one\nLine two", 2), ("", 0), ("   ", 1), ("هل وصل؟ نعم.", 2), ("Вес 3 кг. Дальше", 2), ("Вес 3 кг. и ещё", 1),
        ("المادة 7. يدفع المستأجر الأجرة.", 1), ("انظر المادة 7. ثم عد.", 2), ("Стоит 20 руб. Налог отдельно.", 2), ("Стоит 20 руб. без налога.", 1), ("Пункт 4. Сторона платит.", 1), ("Офис: ул. Садовая, д. 5 открыт.", 1),
        ("Elma, armut vb. meyveler gelir.", 1), ("Madde 3. Kiracı öder.", 1), ("Bkz. Ek 4 ve sonrası. Devam eder.", 2), ("Papers, files etc. are kept.", 1), ("Papers, files etc. The rest is not.", 2),
        ("Подписано 5 мая 2030 г. Москва получила копию.", 1), ("البند (ب). يسري النص.", 1), ("انتهى... ثم عاد.", 1), ('He said "no." Then he left.', 2), ("The sum is 150.000 crowns. Paid.", 2),
    ],
)
def test_split_counts(text, n):
    assert len(segment.split(text)) == n


def test_text_functions(spark):
    rows = [("<g1>Hello</g1>  world", ), ("  ", ), (None, ), ("12 3", ), ("the the end", )]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(T.strip_tags("t"), T.count_words("t"), T.is_translatable("t"), T.repeats_word("t"), F.size(T.tag_ids("t"))).collect()
    assert [tuple(r) for r in got] == [("Hello  world", 2, True, False, 1), ("  ", 0, False, False, 0), (None, 0, False, False, 0), ("12 3", 2, False, False, 0), ("the the end", 3, True, True, 0)]


def test_flags(spark):
    rows = [
        ("Pay 1,500 now", "Pay 1.500 now", "fr", "en"), ("<g1>a b</g1> c", "a b c", "en", "fr"), ("The house is old and very big indeed", "Yes", "en", "fr"),
        ("Pay 5", "Pay 6", "en", "fr"), ("x", None, "en", "fr"), (None, "x", "en", "fr"), ("Hello there my friend", "Hello there my friend", "en", "ar"),
    ]
    df = spark.createDataFrame(rows, "s string, t string, a string, b string")
    got = [r[0] for r in df.select(checks.flags(F.col("s"), F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert got[0] == ["separator_changed"]
    assert got[1] == ["tags_missing:1"]
    assert got[2] == ["too_short"]
    assert got[3] == ["numbers_mismatch"]
    assert got[4] == ["empty"]
    assert got[5] == []
    assert got[6] == ["untranslated"]


def test_first_delivery(spark):
    df = spark.createDataFrame([(1, "a", {"k": "v"}, 1), (1, "a", {"k": "v"}, 2), (2, None, None, 1), (None, "x", None, 1)], "id int, t string, m map<string,string>, loaded_at int")
    assert first_delivery(df, "id").count() == 3
    assert first_delivery(df.limit(0), "id").count() == 0


def test_exact_prefers_the_domain(spark):
    s = spark.createDataFrame([("s1", "h", "en", "fr"), ("s2", "none", "en", "fr"), ("s3", None, "en", "fr")], "id string, source_hash string, source_lang string, target_lang string")
    m = spark.createDataFrame([("m1", "h", "en", "fr", "art"), ("m2", "h", "en", "fr", "legal"), ("m3", "h", "en", "de", "legal")], "id string, source_hash string, source_lang string, target_lang string, domain string")
    assert [tuple(r) for r in memory.exact(s, m, "legal").collect()] == [("s1", "m2", True)]
    assert [tuple(r) for r in memory.exact(s, m, "law").collect()] == [("s1", "m1", False)]


def test_fuzzy_equals_brute_force(spark):
    base = [f"The {a} signs the {b} in two copies" for a in ("tenant", "tenants", "museum", "supplier") for b in ("report", "reports", "invoice")]
    m = [(f"m{i:02d}", t, "en", "fr", "d") for i, t in enumerate(base)]
    q = [("q1", "The tenant signs the report in two copies", "en", "fr"), ("q2", "short", "en", "fr")]
    got = memory.fuzzy(spark.createDataFrame(q, "id string, text string, source_lang string, target_lang string"), spark.createDataFrame(m, "id string, text string, source_lang string, target_lang string, domain string"), "d").collect()
    want = []
    for key, text, *_ in q:
        if len(text) < 8:
            continue
        scored = []
        for mid, cand, *_ in m:
            if int(len(text) * 0.75) <= len(cand) <= int(len(text) / 0.75) + 1:
                r = int(SequenceMatcher(None, cand, text, autojunk=False).ratio() * 100)
                if r >= 75:
                    scored.append((-r, abs(len(cand) - len(text)), mid))
        want += [(key, mid, -r, n + 1) for n, (r, _, mid) in enumerate(sorted(scored)[:5])]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_fuzzy_compares_the_whole_band(spark, monkeypatch):
    rng = random.Random(3)
    query = "The tenant signs the annual report of the museum in two copies before the end of Monday 日本"
    other = ["".join(rng.choice("abcdefghij ") for _ in query).strip().ljust(len(query), "x") for _ in range(900)]
    m = [(f"a{i:03d}", t, "en", "fr", "d") for i, t in enumerate(other)] + [("z1", query + " at noon", "en", "fr", "d"), ("z2", query[:-12], "en", "fr", "d"), ("z3", " ", "en", "fr", "d"), ("z4", None, "en", "fr", "d")]
    queries = spark.createDataFrame([("q", query, "en", "fr")], "id string, text string, source_lang string, target_lang string")
    entries = spark.createDataFrame(m, "id string, text string, source_lang string, target_lang string, domain string")
    want = sorted((-int(SequenceMatcher(None, t, query, autojunk=False).ratio() * 100), abs(len(t) - len(query)), k) for k, t, *_ in m[900:902])
    for chars in (500_000, 4_000):
        monkeypatch.setattr(memory, "BLOCK_CHARS", chars, raising=False)
        got = sorted(memory.fuzzy(queries, entries, "d").collect(), key=lambda r: r["place"])
        assert [(r["memory_id"], r["score"]) for r in got] == [(k, -s) for s, _, k in want]


def test_upsert(spark):
    m = spark.createDataFrame([("a", "Old", "X", "en", "fr", "g", 2)], "id string, source_text string, target_text string, source_lang string, target_lang string, domain string, usage_count int").withColumn("source_hash", T.text_hash("source_text"))
    u = spark.createDataFrame([("Old", "Y", "en", "fr", "g", 1), ("Old", "Z", "en", "fr", "g", 2), ("New", "N", "en", "fr", "g", 3), (" ", "N", "en", "fr", "g", 4)], "source_text string, target_text string, source_lang string, target_lang string, domain string, seq int")
    got = {r["source_text"]: (r["target_text"], r["usage_count"]) for r in memory.upsert(m, u).collect()}
    assert got == {"Old": ("Z", 4), "New": ("N", 0)}


def test_terms(spark):
    assert terms.change_of("the old lease ends", "the old contract ends") == ("lease", "contract")
    assert terms.change_of("a b", "a b") is None
    assert terms.change_of("Lease", "lease") is None
    df = spark.createDataFrame([("s1", "The invoice is paid", "La note est payée"), ("s2", "The invoice", "la facture")], "segment_id string, source_text string, target_text string")
    t = spark.createDataFrame([("invoice", "facture")], "source_term string, target_term string")
    assert [tuple(r) for r in terms.enforcement(df, t).collect()] == [("s1", "invoice", "facture")]
    one = spark.createDataFrame([("an Invoice, invoices",)], "t string")
    assert one.select(terms.replace_term(F.col("t"), "invoice", "b$ill")).first()[0] == "an b$ill, invoices"


def test_term_enforcement_equals_substring_search(spark, monkeypatch):
    sources = ["L'exemplaire signé est ici", "voir l'échéancier, svp", "L’échéancier", "وبالعقد يبدأ", "合同已签署", "The invoices", "the Invoice", "A well-known  rule", "", None]
    texts = [(f"s{i}{j}", s, t) for i, s in enumerate(sources) for j, t in enumerate(("Nothing", "the SIGNED copy, schedule; contract", "", None))]
    listed = [("L'exemplaire signé", "signed copy"), ("échéancier", "Schedule"), ("l'échéancier", "schedule"), ("العقد", "contract"), ("合同", "contract"), ("invoice", "facture"), ("invoice", "note"), ("well-known rule", "x"), (None, "z"), ("rule", None)]
    want = {(k, a, b) for k, s, t in texts if s and t is not None for a, b in listed if a and b and a in " ".join(s.split()) and b.lower() not in t.lower()}
    df = spark.createDataFrame(texts, "segment_id string, source_text string, target_text string")
    t = spark.createDataFrame(listed, "source_term string, target_term string")
    for block in (20_000, 2):
        monkeypatch.setattr(terms, "BLOCK", block, raising=False)
        got = [tuple(r) for r in terms.enforcement(df, t).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert terms.enforcement(df, t.limit(0)).count() == 0
    assert terms.enforcement(df, spark.createDataFrame([("", "y")], t.schema)).count() == 0


def test_greedy_batches(spark):
    rows = [("f", f"s{i:02d}", i, "x" * n) for i, n in enumerate((3000, 3000, 1, 9000, 5, 5))] + [("g", "t", 0, None)]
    df = spark.createDataFrame(rows, "file_id string, id string, order_index int, source_text string")
    got = {r["id"]: r["batch_no"] for r in files.greedy_batches(df).collect()}
    assert got == {"s00": 0, "s01": 0, "s02": 1, "s03": 2, "s04": 3, "s05": 3, "t": 0}


def test_context_equals_loop(spark):
    texts = [f"sentence {i} " + "w" * (i * 37 % 90) for i in range(30)]
    df = spark.createDataFrame([("f", f"{i:03d}", i, t) for i, t in enumerate(texts)], "file_id string, id string, order_index int, source_text string")
    got = {int(r["id"]): (r["before"], r["after"]) for r in files.context(df).collect()}
    for i in range(30):
        assert got[i] == (" ".join(texts[:i])[-220:], " ".join(texts[i + 1 :])[:220])


def test_assembled_and_siblings(spark):
    df = spark.createDataFrame([("1", "f", "u", 0, "a.", "A.", " ", "h"), ("2", "f", "u", 1, "b.", None, None, "h"), ("3", "f", "v", 0, "c", " ", "", "k")], "id string, file_id string, unit_key string, unit_order int, source_text string, target_text string, trailing_ws string, source_hash string")
    assert {r["unit_key"]: r["text"] for r in files.assembled(df).collect()} == {"u": "A. b.", "v": "c"}
    assert {r["id"]: r["siblings"] for r in files.siblings(df).collect()} == {"1": 1, "2": 1}


def test_merge_lines(spark):
    rows = [(1, "f", 1, 0.0, 0.0, 100.0, 10.0), (2, "f", 1, 0.0, 14.0, 90.0, 24.0), (3, "f", 1, 0.0, 60.0, 90.0, 70.0), (4, "f", 1, 300.0, 72.0, 350.0, 82.0)]
    df = spark.createDataFrame(rows, "span_id long, file_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert {r["span_id"]: r["block_no"] for r in files.merge_lines(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 2}


def test_plain_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\n\ntwo\x0bthree".encode())
    (tmp_path / "b.txt").write_bytes("سلام".encode("cp1256"))
    (tmp_path / "t.csv").write_bytes(("source,target,note\ncat,chat,x\ncat,chat,\n,leer\n" + "x" * 130 + ",y\ndog,chien,\n").encode("utf-8-sig"))
    got = plain.read_files(spark, str(tmp_path))
    units = plain.plain_units(got.where(F.col("path").endswith(".txt")))
    assert sorted(r["text"] for r in units.where("trim(text) <> ''").collect()) == ["one", "three", "two", "سلام"]
    target = units.where("text = 'two'").select("path", "unit_key", F.lit("zwei").alias("target"))
    back = {r["path"].rpartition("/")[2]: r["text"] for r in plain.rebuilt(units, target).collect()}
    assert back["a.txt"] == "one\r\n\nzwei\x0bthree"
    assert sorted((r["source_term"], r["target_term"], r["note"]) for r in plain.term_table(got.where(F.col("path").endswith(".csv"))).collect()) == [("cat", "chat", "x"), ("dog", "chien", None)]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_round_trip(spark):
    doc = package({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>big</w:t></w:r><w:r><w:t> world of text</w:t></w:r></w:p><w:p/></w:body></w:document>", "other.bin": "raw"})
    book = package({"xl/sharedStrings.xml": f"<sst {S}><si><t>Name</t></si><si><t>Unused</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><f>1+1</f><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>'})
    df = spark.createDataFrame([("d.docx", "docx", bytearray(doc)), ("b.xlsx", "xlsx", bytearray(book)), ("bad.docx", "docx", bytearray(b"no zip"))], "path string, fmt string, content binary")
    got = {(r["path"], r["unit_key"]): r["text"] for r in office.units(df).collect()}
    assert got == {("d.docx", "docx:word/document.xml:p:00000"): "<g1>Hello </g1><g2>big</g2> world of text", ("b.xlsx", "xlsx:sst:000000"): "Name", ("b.xlsx", "xlsx:sst:000001"): "Unused"}
    t = spark.createDataFrame([("d.docx", "docx:word/document.xml:p:00000", "<g1>Salut </g1><g2>grand</g2> monde"), ("b.xlsx", "xlsx:sst:000000", "Nom")], "path string, unit_key string, target string")
    back = {r["path"]: bytes(r["content"]) for r in office.rebuilt(df, t).collect()}
    assert office.read("d", "docx", back["d.docx"])[0][5].replace("<g1>", "").replace("</g1>", "").replace("<g2>", "").replace("</g2>", "") == "Salut grand monde"
    assert zipfile.ZipFile(io.BytesIO(back["d.docx"])).read("other.bin") == b"raw"
    assert {x[5] for x in office.read("b", "xlsx", back["b.xlsx"])} == {"Nom", "Unused"}
    plain_text = office.read("d", "docx", office.write("docx", doc, {"docx:word/document.xml:p:00000": "no tags at all"}))
    assert plain_text[0][5] == "no tags at all"


def test_streams(spark, tmp_path):
    rows = [(1, "2025-01-01 00:10:00", 1, "a", 1.0), (2, "2025-01-01 00:20:00", 1, "a", 2.0), (3, "2025-01-01 05:00:00", 1, "b", 3.0), (4, "2025-01-01 05:01:00", 2, "b", 4.0)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
    df.coalesce(1).write.parquet(str(tmp_path / "events"))

    def drain(stream, name):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    events = feeds.read_events(spark, str(tmp_path / "events"))
    assert sorted((r["user_id"], r["event_id"]) for r in drain(feeds.changes(events), "changes_out")) == [(1, 1), (1, 3), (2, 4)]
    # only windows the watermark has passed come out: the first hour, not the last
    assert [(r["event_type"], r["n"], r["total"]) for r in drain(feeds.usage(feeds.read_events(spark, str(tmp_path / "events"))), "usage_out")] == [("a", 2, 3.0)]


def test_sentences_in_sql(spark):
    segment.register(spark)
    assert [r["text"] for r in spark.sql("SELECT s.text FROM VALUES ('A dog barks. Two cats.') AS v(t), LATERAL sentences(v.t) AS s ORDER BY no").collect()] == ["A dog barks.", "Two cats."]


def test_protected(spark):
    assert protected.detect("plain text") == [] and protected.detect(None) == [] and protected.detect("") == []
    got = protected.detect("قال تعالى «اقرأ باسم ربك» ثم سكت")
    assert [(x["kind"], x["confidence"]) for x in got] == [("verse", "certain")]
    assert protected.detect("وقال النبي كلاما طيبا للناس")[0]["confidence"] == "likely"
    assert protected.detect("نص ﴿ بسم الله ﴾ نص")[0]["end"] == 15
    assert protected.detect("السَّلَامُ عَلَيْكُمْ وَرَحْمَةُ اللَّهِ")[0]["kind"] == "verse"
    kinds = lambda t: [(x["kind"], x["confidence"]) for x in protected.detect(t)]
    assert kinds("كلام \u06dd آخر") == kinds("\ufdfd كلام") == [("verse", "certain")]
    assert kinds("كما ورد في (البقرة: 255) هنا") == [("verse", "certain")] and kinds("كما ورد في (الميناء: 255) هنا") == []
    assert kinds("أخرجه البخاري (٧٩)، ومسلم (٢٢٨٢).") == [("saying", "likely")]
    assert kinds("رواه البخاري أن المستأجر يدفع الأجرة كل شهر") == [("saying", "certain")]
    assert kinds("قال النبي «الدين المعاملة» وانصرف") == [("saying", "certain")]
    assert kinds("عن سالم رضي الله عنه أنه قال كلاما") == [("saying", "likely")] and kinds("عن سالم أنه قال كلاما") == []
    assert kinds("عن سالم رضي الله عنه قال تعالى في الكتاب وقال رسول الله كلاما") == [("saying", "likely")]
    assert kinds("المقال تعالى صوته") == [] and kinds("فقال تعالى كلاما") == [("verse", "likely")]
    df = spark.createDataFrame([(1, "رواه البخاري (١٢٣) ومسلم [45] والبخاري (123) وسنن أبي داود (٩) ومسلم 77 والميناء (3)"), (2, None)], "k int, t string")
    assert sorted((r["collection"], r["number"]) for r in protected.citations(df, "k", "t").collect()) == [("abudawud", "9"), ("bukhari", "123"), ("muslim", "45")]
    assert protected.normalized(spark.createDataFrame([("ﻋﻠﻢ  ـ‏x",), (None,)], "t string"), "t").collect()[0][0] == "علم x"


def test_verses_equal_brute_force(spark):
    verses = [("1:1", "السلام ماء للأرض العطشى"), ("1:2", "العلم جسر بين القلوب"), ("1:3", "قصير"), ("1:4", "السَّلَامُ مَاءٌ للأرضِ العطشى")]
    texts = [(1, "قيل إن السلام ماء للأرض العطشى دائما"), (2, "العِلْمُ جسرٌ بين القلوب"), (3, "لا شيء هنا"), (4, None), (None, "العلم جسر بين القلوب")]
    v = spark.createDataFrame(verses, "verse_key string, arabic string")
    t = spark.createDataFrame(texts, "k long, t string")
    assert {tuple(r) for r in protected.verses_in(t, "k", "t", v, 8).collect()} == {(1, "1:1"), (1, "1:4"), (2, "1:2")}
    assert protected.verses_in(t, "k", "t", v.limit(0)).count() == 0


def test_term_bulk(spark):
    old = spark.createDataFrame([("a", "g", "x"), ("b", "g", "y")], "source_term string, domain string, target_term string")
    new = spark.createDataFrame([("a", "g", "z", 1), ("a", "g", "w", 2), ("c", "g", "q", 1), (" ", "g", "q", 1), ("b", "g", "y", 1)], "source_term string, domain string, target_term string, seq int")
    assert sorted(tuple(r) for r in terms.bulk(old, new).collect()) == [("a", "g", "w", "updated"), ("b", "g", "y", "kept"), ("c", "g", "q", "added")]


def test_layout(spark):
    units = spark.createDataFrame([("f", 0, "same text"), ("f", 1, "other"), ("f", 2, "x")], "file_id string, place int, text string")
    layout = spark.createDataFrame([("f", 0, "same  text and more"), ("f", 1, "else")], "file_id string, place int, text string")
    assert [tuple(r) for r in files.drift(layout, units).collect()] == [("f", 3, 2, 0.6667)]
    boxes = spark.createDataFrame([("f", 1, i, 0.0, float(i), 10.0, i + 1.0) for i in range(5)], "file_id string, page int, box_no int, x0 double, y0 double, x1 double, y1 double")
    texts = spark.createDataFrame([("f", 1, 0), ("f", 1, 1)], "file_id string, page int, text_no int")
    assert {r["text_no"]: (r["y0"], r["y1"]) for r in files.boxes_for_texts(boxes, texts).collect()} == {0: (0.0, 2.0), 1: (2.0, 5.0)}


def test_snapshots(spark, tmp_path):
    s = snapshots.Snapshots(spark, str(tmp_path / "t"))
    assert s.versions() == []
    s.write(spark.range(3))
    s.write(spark.range(5))
    (tmp_path / "t" / "v=3").mkdir()
    assert s.versions() == [1, 2] and s.read().count() == 5 and s.read(1).count() == 3
    assert snapshots.with_missing(spark.range(1), {"id": ("long", 0), "n": ("int", 7)}).first()["n"] == 7


def test_numbers_and_repeats(spark):
    rows = [("٣٠ و 40", "to, to"), ("150.000 and 3.14", "5 5"), ("1 200,50 or 7", "the plan the"), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(T.numbers("a"), T.ambiguous_numbers("a"), T.repeats_word("b")).collect()
    assert [r[0] for r in got] == [["٣٠", "40"], ["150.000", "3.14"], ["1 200,50", "7"], None, []]
    assert [r[1] for r in got] == [[], ["150.000"], [], None, []] and [r[2] for r in got] == [True, False, False, False, False]


def test_upkeep(spark):
    rows = [
        ("a", "f", "h", "x", True, 2, "draft", None, False), ("b", "f", "h", "y", False, 1, "draft", "engine", False), ("c", "f", "h", "x", False, 1, "translated", "echo", False), ("d", "f", None, "y", False, 1, "reviewed", "engine", True),
        ("e", "f", "h", "w", True, 1, "approved", None, False), ("g", "g", "h", " ", False, 1, "translated", None, None), ("i", "g", "h", "[EN] z", False, 1, "translated", None, None),
    ]
    s = spark.createDataFrame(rows, "id string, file_id string, source_hash string, target_text string, edited_by_human boolean, updated_at int, status string, origin string, is_locked boolean")
    assert {tuple(r) for r in upkeep.sibling_proposals(s).collect()} == {("b", "x")}
    proposals = spark.createDataFrame([("a", "new"), ("d", "new"), ("gone", "new"), ("b", "y"), ("c", None)], "id string, proposal string")
    assert {tuple(r) for r in upkeep.apply_proposals(s, proposals).collect()} == {("a", "x", "new", "translated")}
    assert {tuple(r) for r in upkeep.approved(s).collect()} == {("c", False), ("d", True), ("i", False)}
    assert {r["id"] for r in upkeep.without(s, s.where("file_id = 'f'").select("file_id"), "file_id").collect()} == {"g", "i"}
    assert [r["id"] for r in upkeep.polluted(s).collect()] == ["i"]
    texts = spark.createDataFrame([("abcd1z",), ("a b c",), ("",), (None,), ("zyx",)], "t string")
    assert [r[0] for r in texts.select(upkeep.longest_run(F.col("t"))).collect()] == [4, 3, 0, 0, 1]
    n = spark.createDataFrame([(0,), (125,), (375,), (626,)], "n int")
    assert [tuple(r) for r in n.select(upkeep.pages_from_words(F.col("n")), upkeep.encoded_bytes(F.col("n"))).collect()] == [(1, 0), (1, 168), (2, 500), (3, 836)]
    m = spark.createDataFrame([("a", "<g1>four</g1>", 4), ("b", "four", 0), ("c", None, None)], "id string, source_text string, source_length int")
    assert {tuple(r) for r in upkeep.reindexed(m).collect()} == {("b", 0, 4), ("c", None, 0)}
    new = spark.createDataFrame([("a", "Some words", "h1"), ("b", "12.5", "h2"), ("c", "Other words", "h3")], "id string, source_text string, source_hash string")
    got = {r["id"]: tuple(r)[1:] for r in upkeep.derived(new, spark.createDataFrame([("a", "Des mots")], "id string, memory_text string")).collect()}
    assert got == {"a": ("translated", "Des mots", "tm_exact", False), "b": ("approved", "12.5", "source", True), "c": ("draft", None, None, False)}


def test_cluster_needs_a_shared_folder(monkeypatch):
    from weft import session

    class Fake:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("J", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(ValueError):
        session.shared_dir(Fake)


def test_snapshot_of_another_writer_stays(spark, tmp_path):
    s = snapshots.Snapshots(spark, str(tmp_path / "t"))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "claim-1").write_text("")
    assert s.write(spark.range(3).toDF("k")) == 2 and s.versions() == [2]
    (tmp_path / "t" / "v=3").mkdir()  # begun and not finished
    assert s.write(spark.range(4).toDF("k")) == 4 and s.read().count() == 4 and s.read(2).count() == 3


def test_fuzzy_in_the_domain_of_the_query(spark):
    q = spark.createDataFrame([("q1", "The tenant signs the report", "en", "fr", "a"), ("q2", "The tenant signs the report", "en", "fr", "b"), ("q3", "The tenant signs the report", "en", "fr", None)], "id string, text string, source_lang string, target_lang string, domain string")
    m = spark.createDataFrame([(k, "The tenant signs the reports", "en", "fr", d) for k, d in (("m1", "a"), ("m2", "b"), ("m3", None))], "id string, text string, source_lang string, target_lang string, domain string")
    assert {(r["segment_id"], r["memory_id"]) for r in memory.fuzzy(q, m).collect()} == {("q1", "m1"), ("q2", "m2")}
    assert {(r["segment_id"], r["memory_id"]) for r in memory.band(q, m).collect()} == {("q1", "m1"), ("q2", "m2")}


def test_office_order_comments_and_failures(spark, monkeypatch):
    rels = lambda rows: f'<Relationships xmlns="{office.RELATED}">' + "".join(f'<Relationship Id="{i}" Type="x/{k}" Target="{t}"/>' for i, k, t in rows) + "</Relationships>"
    r = f'xmlns:r="{office.NS["r"]}"'
    sheet = lambda ref, text: f'<worksheet {S}><sheetData><row><c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c></row></sheetData></worksheet>'
    book = package({
        "xl/workbook.xml": f'<workbook {S} {r}><sheets><sheet name="Second" r:id="b"/><sheet name="First" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels([("a", "worksheet", "worksheets/sheet1.xml"), ("b", "worksheet", "/xl/worksheets/sheet2.xml")]),
        "xl/worksheets/sheet1.xml": sheet("A1", "one"), "xl/worksheets/sheet2.xml": sheet("B2", "two"),
        "xl/worksheets/_rels/sheet2.xml.rels": rels([("c", "comments", "../comments1.xml")]),
        "xl/comments1.xml": f'<comments {S}><commentList><comment ref="B2"><text><r><t>a </t></r><r><t>note</t></r></text></comment></commentList></comments>',
    })
    assert [(u[2], u[3], u[5]) for u in office.read("b", "xlsx", book)] == [("cell", "Second!B2", "two"), ("comment", "Second!B2", "a note"), ("cell", "First!A1", "one")]
    slide = lambda text: f'<p:sld xmlns:p="{office.NS["p"]}" xmlns:a="{office.NS["a"]}"><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:sld>'
    deck = package({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{office.NS["p"]}" {r}><p:sldIdLst><p:sldId r:id="y"/><p:sldId r:id="x"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels([("x", "slide", "slides/slide1.xml"), ("y", "slide", "slides/slide2.xml")]),
        "ppt/slides/slide1.xml": slide("one"), "ppt/slides/slide2.xml": slide("two"), "ppt/slides/_rels/slide2.xml.rels": rels([("n", "notesSlide", "../notesSlides/notesSlide7.xml")]), "ppt/notesSlides/notesSlide7.xml": slide("spoken"),
    })
    assert [(u[2], u[5]) for u in office.read("d", "pptx", deck)] == [("paragraph", "two"), ("notes", "spoken"), ("paragraph", "one")]
    rows = [("b.xlsx", "xlsx", bytearray(book)), ("bad.docx", "docx", bytearray(b"no zip")), ("cut.docx", "docx", bytearray(package({"word/document.xml": "<w"}))), ("old.doc", None, bytearray(b"x"))]
    df = spark.createDataFrame(rows, "path string, fmt string, content binary")
    assert {tuple(x) for x in office.failures(df).collect()} == {("bad.docx", "no package"), ("cut.docx", "broken part"), ("old.doc", "unsupported format")}
    monkeypatch.setattr(office, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        office.read("b", "xlsx", book)

"""Edge cases, brute-force comparisons and held-out accuracy of the training-text operators."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.llm import alignment, bitext, encoding, leaks, lookalike, mixing, packing, pairs, quality, scanned, sentences
from weft.llm.words import Counts

# ---------------------------------------------------------------- 6 look-alikes


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Ｎａｍｅ１", "Name1", True), ("ﬁn", "fin", True), ("été", "été", True), ("a b", "a b", True), ("a​b", "ab", True), ("Сор", "Cop", True), ("ﻋﻠﻢ", "علم", True),
        ("A", "a", False), ("a.", "a", False), ("x²", "x2", False), ("علم", "عِلم", False), ("۴", "٤", False), ("۱", "١", True), ("<g1>a</g1>", "a", False), ("", "​", True),
    ],
)
def test_skeleton(a, b, same):
    assert (lookalike.skeleton(a) == lookalike.skeleton(b)) is same


def test_lookalike_pairs_equal_brute_force(spark):
    texts = ["Сор 1", "Cop 1", "Cop 1", None, "", "​", "été", "été", "other"]
    left = spark.createDataFrame([(f"s{i}", t, 1) for i, t in enumerate(texts)] + [("s0", texts[0], 1), (None, "Cop 1", 1)], "left_id string, text string, skeleton int")
    right = spark.createDataFrame([(f"m{i}", t, 2) for i, t in enumerate(texts)], "right_id string, text string, k int")
    got = {tuple(r) for r in lookalike.matches(left, right).collect()}
    want = {(f"s{i}", f"m{j}") for i, a in enumerate(texts) for j, b in enumerate(texts) if a is not None and b is not None and a != b and lookalike.skeleton(a) == lookalike.skeleton(b)}
    assert got == want
    assert lookalike.matches(left.limit(0), right).count() == 0


# ---------------------------------------------------------------- 4 encodings

RUSSIAN = ["Арендатор проверяет годовой отчёт", "Школа копирует план участка", "Музей хранит страховой полис"]
ARABIC = ["يراجع المستأجر التقرير السنوي", "تنسخ المدرسة مخطط الموقع", "يحفظ المتحف وثيقة التأمين"]


@pytest.mark.parametrize("text", [*RUSSIAN, *ARABIC, "L'école vérifie le procès-verbal", "Müze imzalı nüshayı yayımlar", "– see the annex’s list"])
@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1251", "cp1256"])
def test_multibyte_round_trip(text, codec):
    raw = text.encode("utf-8")
    try:
        garbled = raw.decode(codec)
    except UnicodeDecodeError:
        return
    assert encoding.repair(garbled)[:2] == (text, True)


@pytest.mark.parametrize("text", [*RUSSIAN, *ARABIC, "Þkunuku & Ðkunuku A/S, Ødnes", "SÃO PAULO, RUA 5", "£ 40 ± 3 µm × 2", "naïve façade", "", "α β γ, √ 2 ≈ 1.41", "", None])
def test_sound_text_stays(text):
    lexicon = encoding.Lexicon({w: 9 for t in [*RUSSIAN, *ARABIC] for w in encoding.words_of(t)})
    assert encoding.repair(text, lexicon)[:2] == (text, False)


def test_encodings_met_leaves_out_none():
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        t = rng.choice([*RUSSIAN, *ARABIC, "L'école vérifie le procès-verbal", "Müze imzalı nüshayı yayımlar"])
        if rng.random() < 0.6:
            t = f"{rng.choice(RUSSIAN)} {t.encode('utf-8').decode(rng.choice(['latin-1', 'koi8_r', 'cp437']))}"
        texts.append(t + rng.choice(["", "\ufffd", "\n", "😀", "،"]))
    for t, met in zip(texts, encoding.encodings_met(texts)):
        assert encoding.repair_multibyte(t, met) == encoding.repair_multibyte(t)
    assert list(encoding.encodings_met([""])) == [0]


def test_counts_of_words():
    counts = {"a": 3, "б": 5, "": 1, "ab": 2**20}
    held = Counts.of(counts)
    assert all(held.get(w) == n for w, n in counts.items()) and held.get("c", 7) == 7 and "c" not in held and len(held) == 4


def test_counts_are_read_as_hashed_in_python(spark):
    assert Counts.read(spark.createDataFrame([("слово", 4), ("a", 2)], "word string, n long")).get("слово") == 4


def test_single_byte_swap_and_lost_bytes():
    lexicon = encoding.Lexicon({w: 9 for t in [*RUSSIAN, *ARABIC] for w in encoding.words_of(t)})
    for text, real, read in ((RUSSIAN[0], "cp1251", "cp1252"), (RUSSIAN[1], "koi8_r", "cp1251"), (ARABIC[0], "cp1256", "cp1252")):
        assert encoding.repair(text.encode(real).decode(read), lexicon)[:2] == (text, True)
    assert encoding.repair("repr�sente")[1:] == (True, False)


def test_encoding_operator(spark):
    rows = [(1, "f", 1, "Ø§Ù„Ù…ØªØ\xadÙ", "x"), (1, "f", 1, "Ø§Ù„Ù…ØªØ\xadÙ", "x"), (2, "f", 1, None, "x"), (3, None, None, "", "x"), (4, "f", 2, "plain", "x"), (None, "f", 1, "plain", "x")]
    df = spark.createDataFrame(rows, "span_id long, file_id string, page int, text string, affected string")
    assert [r["span_id"] for r in encoding.found(df).collect()] == [1]
    assert encoding.restore(df).count() == 4
    assert encoding.found(df.limit(0)).count() == 0
    hints = spark.createDataFrame([("f", [2, 2, 9]), ("g", None)], "id string, unreliable_pages array<int>")
    got = {(r["file_id"], r["page"]): (r["garbled"], r["hinted"]) for r in encoding.pages(encoding.restore(df), hints).collect()}
    assert got[("f", 1)] == (1, False) and got[("f", 2)] == (0, True) and got[("f", 9)] == (0, True)


def test_misread_words_stay_suspect_as_counts_grow(spark):
    arabic, russian = "والزيارة القادمة في {} يونيو 2031.", "Музей хранит план в {} томах и в копии"
    garbled = [(arabic.format(8).replace("يونيو", "нжднж"), arabic.format(8)), (russian.format(3).encode("cp1251").decode("koi8_r"), russian.format(3))]
    rows = [t.format(i) for i in range(60) for t in (arabic, russian)] + [g for g, _ in garbled for _ in range(4)]
    df = spark.createDataFrame([(i, "f", 1, t) for i, t in enumerate(rows)], "span_id long, file_id string, page int, text string")
    got = {r["span_id"]: r["restored"] for r in encoding.restore(df).where("affected").collect()}
    assert got == {120 + k: garbled[k // 4][1] for k in range(8)}


# ---------------------------------------------------------------- 5 sentences

UNITS = [
    (1, "en", "Dr. Basana signs. The tenant waits. “Is it signed?” asked the clerk. The amount ... remains open. 41. The end."),
    (2, "zh", "“计划好。”银行提交副本。他说：“请等！”然后合上了。"), (3, "ar", "هل وصل؟ نعم. «المخطط جاهز.» يوقع المورد."), (4, None, None), (5, "en", ""), (6, "th", "ธนาคารชำระ 60 โครนต่อเดือน โรงเรียนตรวจ"), (7, "en", "  \n \n"),
    (8, "ur", "بینک نقشہ جمع کرتا ہے۔ ڈاکٹر آتا ہے۔"), (9, "en", "No break?The next one. Line\nbreak"),
]


def test_sentences(spark):
    more = [(100 + i, "en", f"Dr. N{chr(97 + i % 26)}ma came. The tenant waits for mail.") for i in range(60)]
    df = spark.createDataFrame([*UNITS, *more, UNITS[0]], "unit_id long, lang string, text string")
    model = sentences.learn(df)
    assert "dr" in model.abbreviations["en"]
    out = {}
    for r in sentences.split_units(df, model).collect():
        out.setdefault(r["unit_id"], []).append((r["no"], r["sentence"], r["start_pos"], r["end_pos"]))
    texts = {k: [x[1] for x in sorted(v)] for k, v in out.items()}
    assert texts[1] == ["Dr. Basana signs.", "The tenant waits.", "“Is it signed?” asked the clerk.", "The amount ... remains open.", "41. The end."]
    assert texts[2] == ["“计划好。”", "银行提交副本。", "他说：“请等！”然后合上了。"]
    assert texts[3] == ["هل وصل؟", "نعم.", "«المخطط جاهز.»", "يوقع المورد."]
    assert texts[6] == ["ธนาคารชำระ 60 โครนต่อเดือน", "โรงเรียนตรวจ"]
    assert len(texts[8]) == 2
    assert texts[9] == ["No break?", "The next one.", "Line", "break"]
    assert not {4, 5, 7} & set(texts)
    for uid, _, text in UNITS:  # all characters but white space belong to one sentence
        if text:
            spans = [(a, b) for _, _, a, b in sorted(out.get(uid, []))]
            assert "".join(text[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == "".join(text.split())
    assert sentences.found(df.limit(0)).count() == 0


def test_collocations(spark):
    rng = random.Random(12)
    names, verbs = ("tenant", "carrier", "museum", "clinic"), ("signs", "checks", "keeps", "sends")
    rows = []
    for i in range(160):
        one = f"The {rng.choice(names)} {rng.choice(verbs)} {rng.randint(2, 90)}. Kapitel before {rng.randint(2, 9)} o'clock."
        two = f"Then the {rng.choice(names)} {rng.choice(verbs)} unit {rng.randint(2, 90)}. It {rng.choice(verbs)} the {rng.choice(names)}. It {rng.choice(verbs)} the {rng.choice(names)}. It {rng.choice(verbs)} all."
        rows.append((i, f"{one} {two}", "en"))
    df = spark.createDataFrame([*rows, *rows[:5], (999, None, "en"), (None, "x 3. Kapitel", "en")], "unit_id long, text string, lang string")
    model = sentences.learn(df)
    assert ("#", "kapitel") in model.collocations["en"] and ("#", "it") not in model.collocations["en"]
    cut = [rows[0][1][a:b] for a, b in sentences.split(rows[0][1], model, "en")]
    assert len(cut) == 5 and ". Kapitel" in cut[0] and all(x.startswith("It ") for x in cut[2:])


# ---------------------------------------------------------------- 7 packing


def test_packing_keeps_every_character():
    rng = random.Random(3)
    for capacity, most in ((100, 5), (37, None), (10, 1), (1, 3)):
        sizes = [rng.randint(0, 150) for _ in range(200)]
        bins = packing.pack(sizes, capacity, most)
        got = {}
        for content in bins:
            assert sum(b - a for _, a, b in content) <= capacity
            assert most is None or len(content) <= most
            for i, a, b in content:
                got.setdefault(i, []).append((a, b))
        for i, n in enumerate(sizes):
            parts = sorted(got[i])
            assert parts[0][0] == 0 and parts[-1][1] == n and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
            assert len(parts) == 1 or n > capacity


def test_packing_fills_classes_by_their_count():
    bins = packing.pack([40] * 10 + [30] * 9 + [11] * 18 + [0], 100, None)
    assert sorted(len(b) for b in bins if {i for i, _, _ in b} & set(range(10))) and len(bins) <= 10
    assert [len(b) for b in packing.pack([34] * 7, 100, None)] == [2, 2, 2, 1]
    assert [len(b) for b in packing.pack([5] * 25, 100, 10)] == [10, 10, 5]
    rng = random.Random(2)
    sizes = [rng.randint(1, 60) for _ in range(3000)]
    assert len(packing.pack(sizes, 100, None)) <= 1.03 * sum(sizes) / 100


def test_packing_operator(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 10)
    rows = [(f"s{i}", "f", True, "x" * (i % 7)) for i in range(50)] + [("n", "f", True, None), ("u", "f", False, "x"), (None, "f", True, "x"), ("o", None, True, "x"), ("s1", "f", True, "x")]
    s = spark.createDataFrame(rows, "id string, file_id string, is_translatable boolean, source_text string").withColumn("shard", F.lit("clash"))
    settings = spark.createDataFrame([("a", 10, None), ("b", 3, 2), ("c", None, 2)], "profile string, batch_char_budget int, batch_max_segments int")
    out = packing.batches(s, settings).collect()
    assert {r["profile"] for r in out} == {"a", "b"}
    assert {r["segment_id"] for r in out} == {f"s{i}" for i in range(50)} | {"n"}
    assert len({r["shard"] for r in out}) > 1
    use = {r["profile"]: r for r in packing.use_of_budget(packing.batches(s, settings), settings).collect()}
    assert use["b"]["fullest"] <= 3 and use["b"]["most_pieces"] <= 2
    assert packing.batches(s.limit(0), settings).count() == 0


# ---------------------------------------------------------------- 8 leaks


def test_leaks(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(60)]
    changed = [w if i % 9 else word() for i, w in enumerate(item)]
    fill = lambda n: [word() for _ in range(n)]
    docs = [
        (1, " ".join(fill(30) + item + fill(30))), (2, " ".join(fill(10) + changed[10:55] + fill(10)).upper()), (3, " ".join(fill(40) + item[:15] + fill(40))), (4, " ".join(fill(90))), (5, None), (6, ""),
        (7, "\n".join(fill(200) + item[20:58] + fill(300))), (None, " ".join(item)), (8, " ".join(item)), (8, " ".join(item)),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    items = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, "..."), (None, "x y z")], "item_id long, text string")
    assert sorted(tuple(r) for r in leaks.found(d, items).collect()) == [(1, 1), (2, 1), (7, 1), (8, 1)]
    assert leaks.found(d.limit(0), items).count() == 0
    assert leaks.found(d, items.limit(0)).count() == 0


def test_short_items_leak(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    five, eight = words[:5], words[5:13]
    parts = [five, *[eight[k : k + 4] for k in range(5)], five[:2], eight[:3]]
    docs = spark.createDataFrame([(i, " ".join(words[20:60] + part + words[60:100])) for i, part in enumerate(parts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(five)), (2, " ".join(eight))], "item_id long, text string")
    assert sorted(tuple(r) for r in leaks.found(docs, items).collect()) == [(0, 1), *[(k, 2) for k in range(1, 6)]]


def test_leak_blocks_agree(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))) for i in range(12)]
    docs = [(i, f"front {t} back") for i, t in items]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(tuple(r) for r in leaks.found(a, b).collect())
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 1000)
    assert sorted(tuple(r) for r in leaks.found(a, b).collect()) == one == [(i, i) for i in range(12)]


# ---------------------------------------------------------------- 9 mixing


def test_apportion():
    assert mixing.apportion({"a": 0.5, "b": 0.3, "c": 0.2}, 10) == {"a": 5, "b": 3, "c": 2}
    assert sum(mixing.apportion({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, 100).values()) == 100
    assert mixing.apportion({"a": 0.9, "b": 0.1, "z": 0.0}, 10, {"a": 2})["a"] == 2
    assert mixing.apportion({}, 5) == {}


def test_subset_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(0, 9))]
        want = rng.uniform(-5, 1.2 * sum(sizes) + 3)
        sums = {sum(n for i, n in enumerate(sizes) if mask >> i & 1) for mask in range(1 << len(sizes))}
        got = sum(n for n, take in zip(sizes, mixing.subset(sizes, want)) if take)
        assert abs(got - want) == min(abs(x - want) for x in sums)


def test_mix(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, "big", rng.randint(1, 900)) for i in range(600)] + [(1000 + i, "small", rng.randint(20, 300)) for i in range(40)] + [(2000, None, 5), (2001, "empty", 0), (2002, "one", 7000)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame(
        [("m", "big", 0.7, 1), ("m", "small", 0.2, 3), ("m", "none", 0.1, 5), ("m", "small", 0.2, 3), ("t", "small", 0.5, 2), ("t", "one", 0.5, 1), ("n", None, 1.0, 1), (None, "big", 1.0, 1), ("z", "big", 1.0, 0)],
        "mix_name string, source string, target_share double, max_repeats int",
    )
    for docs_a_shard in (1000, 90):  # one shard of each source, then several of the big one
        monkeypatch.setattr(mixing, "SHARD_DOCS", docs_a_shard)
        chosen = mixing.records(counts, targets)
        got = {(r["mix_name"], r["source"]): r for r in mixing.shares_reached(chosen, counts, targets).collect()}
        assert got["m", "none"]["records"] == 0 and got["m", "none"]["remark"] == "no documents"
        assert got["m", "small"]["remark"] == "sets the size" and got["m", "small"]["most_repeats"] == 3 and got["m", "big"]["most_repeats"] == 1
        assert abs(got["m", "big"]["reached_share"] - 0.7 / 0.9) < 0.0005 and abs(got["m", "small"]["reached_share"] - 0.2 / 0.9) < 0.0005
        assert abs(got["t", "small"]["reached_share"] - 0.5) < 0.005 and got["t", "one"]["records"] == 1
        again = mixing.records(counts.repartition(7), targets)
        assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))
    assert mixing.records(counts.limit(0), targets).count() == 0
    assert mixing.records(counts, targets.limit(0)).count() == 0


def test_mix_may_leave_few_documents_aside(spark):
    rows = [(i, "big", 100) for i in range(400)] + [(1000, "one", 50)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "one", 0.5, 2)], "mix_name string, source string, target_share double, max_repeats int")
    exact = {r["source"]: r["tokens"] for r in mixing.shares_reached(mixing.records(counts, targets), counts, targets).collect()}
    large = {r["source"]: r["tokens"] for r in mixing.shares_reached(mixing.records(counts, targets, few=20), counts, targets).collect()}
    assert exact == {"big": 100, "one": 100} and large == {"big": 40000, "one": 100}


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a", "two words"), (2, None, None), (3, "a", ""), (None, "a", "x")], "doc_id long, source string, text string")
    got = {r["doc_id"]: r["tokens"] for r in mixing.token_counts(df).collect()}
    assert got[1] >= 2 and got[2] == 0 and got[3] == 0 and None not in got


# ---------------------------------------------------------------- 10 quality


def test_shapes(spark):
    verbs, things = ("signs", "checks", "keeps", "returns"), ("annual report", "site plan", "price list", "user manual")
    rng = random.Random(2)
    sentence = lambda: f"The tenant {rng.choice(verbs)} the {rng.choice(things)} in the presence of {rng.randint(2, 90)} witnesses."
    docs = [(i, " ".join(sentence() for _ in range(8))) for i in range(60)]
    docs += [
        (101, "\n".join(f"The {rng.choice(things)}" for _ in range(12))), (102, "\n".join(f"The {rng.choice(things)}\t{rng.randint(1, 999)}\t{rng.randint(1, 999)}" for _ in range(9))),
        (103, "copy " * 200), (104, "jq wr fqjzcdgbvfz hdpprlkgdxl sfhwdgkvlvm bblltjcfg gjq wgvnmlb vmqc znblfb qdbj " * 2), (105, "□□□□□\n▒▒▒▒▒\n□□□□□\n~~~^^^"),
        (106, "The tenant signs the annual report in the\npresence of 4 witnesses. The tenant keeps\nthe site plan in the presence of 5\nwitnesses. The tenant checks the user\nmanual in the presence of 7 witnesses."),
        (107, sentence() + "\n- one\n- two\n" + " ".join(sentence() for _ in range(6))), (108, None), (109, ""), (None, "x"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shape", F.lit("clash"))
    got = {r["doc_id"]: r["shape"] for r in quality.found(df).collect()}
    assert got == {101: "list", 102: "table", 103: "junk", 104: "junk", 105: "junk", 108: "junk", 109: "junk"}
    assert quality.found(df.limit(0)).count() == 0
    scored = {r["doc_id"]: r for r in quality.percentiles(quality.statistics(df)).collect()}
    assert scored[101]["prose_share_z"] < -9 and scored[102]["table_share_pct"] > 0.9 and scored[104]["common_share_z"] < -8 and abs(scored[0]["prose_share_z"]) < 1


# ---------------------------------------------------------------- 1 scans


def scan_blocks():
    rng = random.Random(4)
    verbs, things = ("signs", "checks", "keeps", "returns"), ("annual report", "insurance policy", "contractor file", "certificate")
    rows, n = [], 0
    for page in range(1, 41):
        rows.append((n, "f", page, 0, "header", f"PORT OFFICE / lists   - {page + 2} -"))
        n += 1
        for k in range(4):
            text = f"The tenant {rng.choice(verbs)} the {rng.choice(things)} with the translator and the\nsupplier before day {rng.randint(100, 9999)} of the year."
            rows.append((n, "f", page, k + 1, "paragraph", text))
            n += 1
    return rows, n


def test_scanned(spark):
    rows, n = scan_blocks()
    rows += [
        (n, "f", 41, 0, None, "The tenant keeps the insu-\nrance policy. A follow-\nup comes."), (n + 1, "f", 41, 1, None, "The tenanf keeps the anriual rep0rt."), (n + 2, "f", 41, 2, "paragraph", "It ends with the contrac-"),
        (n + 3, "f", 42, 0, "paragraph", "tor file. The end."), (n + 4, "f", 42, 1, None, None), (n + 5, None, 1, 0, None, "x"), (n + 6, "f", None, 0, None, "x"), (n, "f", 41, 0, None, "The tenant keeps the insu-\nrance policy. A follow-\nup comes."),
    ]
    rows += [(n + 10 + i, "f", 43, i, "paragraph", "The follow-up comes with the tenant.") for i in range(6)]
    df = spark.createDataFrame([(*r, [] if r[4] else None) for r in rows], "block_id long, file_id string, page int, seq int, kind string, text string, cells array<string>").withColumn("pages", F.lit("clash"))
    got = {(r["block_id"], r["defect"]) for r in scanned.found(df).collect()}
    assert {b for b, d in got if d == "split_word"} == {n, n + 2}
    assert {b for b, d in got if d == "misread"} == {n + 1}
    heads = {r[0] for r in rows if r[4] == "header"}
    assert {b for b, d in got if d == "running_head"} == heads - {0}
    assert {b for b, d in got if d == "page_number"} == heads
    text = {r["block_id"]: r["text"] for r in scanned.paragraphs(df).collect()}
    assert text[n] == "The tenant keeps the insurance policy. A follow- up comes." or text[n].startswith("The tenant keeps the insurance policy.")
    assert text[n + 2] == "It ends with the contractor" and text[n + 3] == "file. The end."
    assert not heads & set(text)
    assert scanned.found(df.limit(0)).count() == 0


def test_word_counts_do_not_depend_on_batches(spark):
    running = [(10 * f + p, f"f{f}", p, p, "body", "Nilana Report", None) for f in range(3) for p in range(1, 7)]
    body = [(100 + k, "f0", k, 9, "body", "Rules of the harbour\nthe harbour keeps the ledger", None) for k in range(1, 4)]
    df = spark.createDataFrame([*running, *body, *running, *body], "block_id long, file_id string, page int, seq int, kind string, text string, cells array<string>")
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    for rows, parts in ((10_000, 1), (2, 1), (2, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        got.append({(r["kind"], r["key"]): r["n"] for r in scanned.facts(df.repartition(parts)).where("kind in ('w', 't')").collect()})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", own)
    assert got[0] == got[1] == got[2]
    assert got[0]["w", "nilana"] == 3 and got[0]["w", "harbour"] == 4 and got[0]["w", "ledger"] == 3


def test_long_file_is_read_in_groups(spark):
    rows, n = [], 0
    for page in range(1, 201):
        head = "Annual Ledger" if page <= 100 else "Second Volume"
        words = f"The tenant of house {page * 7} keeps the insu-" if page % 64 == 0 else f"rance policy {page} of the tenant." if page % 64 == 1 else f"The tenant keeps insurance number {page * 3} here."
        rows += [(n, "f", page, 0, None, f"{head}  {page}"), (n + 1, "f", page, 1, None, words), (n + 2, "f", page, 2, None, f"It ends on day {page * 5} of the insurance.")]
        n += 3
    df = spark.createDataFrame([(*r, None) for r in rows], "block_id long, file_id string, page int, seq int, kind string, text string, cells array<string>")
    got = {(r["block_id"], r["defect"]) for r in scanned.found(df).collect()}
    assert {b for b, d in got if d == "running_head"} == {r[0] for r in rows if r[3] == 0 and r[2] > 1}
    hints = {r["chunk"]: r for r in scanned.running_lines(scanned.facts(df)).collect()}
    assert len(hints) == 4 and all(len(r["templates"]) <= 16 for r in hints.values())


def test_break_follows_from_the_label(spark):
    lexicon = scanned.Lexicon(Counts.of({"insurance": 30, "policy": 50, "tenant": 90, "north": 40, "east": 40}), Counts.of({"north-east": 30}), Counts.of({}), {}, {}, 10_000)
    page = [{"block": 1, "page": 2, "part": -1, "line": x, "kind": None, "context": False} for x in ("The tenant keeps the insu-", "rance policy of the north-", "east tenant.")]
    lines = scanned.label([(2, page)], [], set(), scanned.first_model(), lexicon)
    assert [x.state for x in lines] == ["break", "body", "body"] and lines[0].goes_on == 1


def test_viterbi_of_lines_equals_brute_force():
    import itertools

    rng = random.Random(6)
    model = scanned.first_model()
    for _ in range(20):
        rows = [[rng.randrange(k) for k in scanned.FEATURES] for _ in range(5)]
        worth = lambda path: model._start[path[0]] + sum(model.score(x)[k] for x, k in zip(rows, path)) + sum(model._move[b][a] for a, b in zip(path, path[1:]))
        assert abs(worth(model.decode(rows)) - max(map(worth, itertools.product(range(4), repeat=5)))) < 1e-9


# ---------------------------------------------------------------- 2 and 3 bilingual

WHO = {"tenant": "locataire", "museum": "musée", "school": "école", "carrier": "transporteur", "auditor": "auditeur"}
DOES = {"signs": "signe", "checks": "vérifie", "keeps": "conserve", "copies": "copie", "returns": "renvoie"}
WHAT = {"report": "rapport", "plan": "plan", "policy": "police", "invoice": "facture", "record": "relevé"}


def bilingual(rng, number=True):
    a, b, c = rng.choice(list(WHO)), rng.choice(list(DOES)), rng.choice(list(WHAT))
    n = f" {rng.randint(1000, 9999)}" if number else ""
    return f"The {a} {b} the {c}{n} on Monday without any delay.", f"Le {WHO[a]} {DOES[b]} le {WHAT[c]}{n} lundi sans aucun retard."


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    memory = spark.createDataFrame([(f"m{i}", "en", "fr", *bilingual(rng)) for i in range(300)], "id string, source_lang string, target_lang string, source_text string, target_text string")
    rows, ids = [], []
    for i in range(200):
        s, t = bilingual(rng)
        rows.append((f"s{i}", s, t))
    bad = {
        "e1": ("The tenant signs the plan 1111 on Monday without any delay.", None, "empty"), "e2": ("The tenant signs the plan 1111 on Monday without any delay.", " <g1>…</g1>​", "empty"),
        "c1": ("The tenant signs the plan 1112 on Monday without any delay.", "« THE TENANT SIGNS THE PLAN 1112 ON MONDAY WITHOUT ANY DELAY »", "copied"),
        "r1": ("The tenant signs the plan 1113 on Monday without any delay.", "Désolé, je ne peux pas traduire ce texte.", "refusal"), "r2": ("The tenant signs the plan 1114 on Monday without any delay.", "I'm sorry, but I can't translate this passage.", "refusal"),
        "t1": ("The tenant signs the plan 1115 on Monday without any delay.", "Le locataire signe…", "truncated"), "t2": ("The tenant signs the plan 1115 on Monday without any delay. The museum keeps the invoice 1234 on Monday without any delay.", "Le locataire signe le plan 1115 lundi sans aucun retard.", "truncated"),
    }
    rows += [(k, s, t) for k, (s, t, _) in bad.items()] + [("n1", "AB-1234, Nila Basa", "AB-1234, Nila Basa"), ("unsent", "x", None), ("null", None, "Le musée"), ("e1", bad["e1"][0], None)]
    segments = spark.createDataFrame(rows, "id string, source_text string, target_text string").withColumn("language", F.lit("clash"))
    ids = [r[0] for r in rows if r[0] != "unsent"] + ["gone", None]
    results = spark.createDataFrame([(1, "en", "fr", ids, ["e1"]), (2, "en", "fr", ids[:5], None), (3, "en", "fr", None, None)], "batch_id long, source_lang string, target_lang string, segment_ids array<string>, missing array<string>")
    return segments, results, memory, {k: v[2] for k, v in bad.items()}


def test_pairs(tables):
    segments, results, memory, want = tables
    got = {r["segment_id"]: r["defect"] for r in pairs.found(segments, results, memory).collect()}
    got.pop("null", None)
    assert {k: got.get(k) for k in want} == want
    assert len(set(got) - set(want)) <= 4  # of 200 sound pairs


def test_pairs_empty(tables):
    segments, results, memory, _ = tables
    assert pairs.found(segments.limit(0), results, memory).count() == 0
    assert pairs.found(segments, results.limit(0), memory).count() == 0


def test_pairs_are_fitted_on_all_rows(spark):
    rng = random.Random(5)
    many = [(f"m{i}", "en", "fr", *bilingual(rng)) for i in range(bitext.SAMPLE + 900)]
    many += [(f"n{i}", "fr", "en", "Le chat dort.", "The cat sleeps.") for i in range(5)] + [("twice", "en", "fr", *bilingual(rng))] * 3
    odd = [(None, None, "fr", "The plan", "Le plan"), ("o1", "en", None, "The plan", "Le plan"), ("o2", "en", "fr", None, "Le plan"), ("o3", "en", "fr", "The plan", None), ("o4", "zh Hant", "fr", "計畫", "Le plan")]
    memory = spark.createDataFrame(many + odd, "id string, source_lang string, target_lang string, source_text string, target_text string")
    rows = [(f"s{i}", *bilingual(rng)) for i in range(60)]
    segments = spark.createDataFrame(rows, "id string, source_text string, target_text string")
    results = spark.createDataFrame([(1, "en", "fr", [r[0] for r in rows], None)], "batch_id long, source_lang string, target_lang string, segment_ids array<string>, missing array<string>")
    known, got, _ = pairs.prepare(segments, results, memory)
    want = bitext.fit([m[1:] for m in many[:-2] + odd[-1:]] + [("en", "fr", *r[1:]) for r in rows])
    assert got.weight.keys() == want.weight.keys() and got.speaks == want.speaks
    assert all(abs(got.weight[w] - want.weight[w]) < 1e-9 for w in want.weight)
    assert {w: set(x) for w, x in got.likely.items() if x} == {w: set(x) for w, x in want.likely.items() if x}
    assert all(abs(p - want.likely[w][v]) < 1e-9 for w, x in got.likely.items() for v, p in x.items())
    # every pair is an example as it stands, at the least
    assert len(many) - 2 + len(rows) < known.where("segment_id is null").agg(F.sum("n")).first()[0] < 3 * (len(many) + len(rows))


def test_expected_translations_by_table_and_by_keys(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    n_x, n_y = rng.integers(1, 6, 50), rng.integers(1, 6, 50)
    block = rng.integers(0, 7, n_x.sum()), n_x, rng.integers(0, 9, n_y.sum()), n_y
    keys = np.flatnonzero(rng.random(63) < 0.6)
    values = rng.random(len(keys))
    p = np.zeros(63)
    p[keys] = values
    want, at_x, at_y = np.zeros(63), np.cumsum(n_x) - n_x, np.cumsum(n_y) - n_y
    for i in range(50):
        for y in block[2][at_y[i] : at_y[i] + n_y[i]]:
            cells = block[0][at_x[i] : at_x[i] + n_x[i]] * 9 + y
            np.add.at(want, cells, p[cells] / (p[cells].sum() + 1e-9))
    for full, chunk in ((63, 50_000), (0, 50_000), (63, 1)):
        monkeypatch.setattr(bitext, "FULL", full)
        monkeypatch.setattr(bitext, "CHUNK", chunk)
        sums = bitext._Sums(63)
        bitext._expect(bitext._Table(63, keys, values), sums, 9, block)
        got = np.zeros(63)
        got[sums.items()[0]] = sums.items()[1]
        assert np.allclose(got, want)


def test_field_by_tasks_equals_field_by_driver(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(bytes(rng.integers(0, 5, n).tolist()), rng.normal(size=(n, pairs.FEATURES)).astype(np.float32).tobytes(), int(rng.integers(1, 4))) for n in rng.integers(1, 4, 40).tolist()]
    examples = spark.createDataFrame(rows, "labels binary, rows binary, n long")
    one = pairs.fit_crf(examples)
    monkeypatch.setattr(pairs, "LOCAL", 0)
    two = pairs.fit_crf(examples)
    assert np.allclose(one.weights, two.weights, atol=1e-3) and np.allclose(one.moves, two.moves, atol=1e-3)
    # where the likelihood is greatest, what is expected is what is there but for the penalty
    blocks = [(len(y), x, y, np.array([n]).tobytes()) for y, x, n in rows]
    truth, got = pairs.sums(blocks, None, None), pairs.sums(blocks, one.weights, one.moves)
    flat = np.concatenate([one.weights.ravel(), one.moves.ravel()])
    assert np.abs((truth[1:] - got[1:]) / truth[0] - 2e-3 * flat).max() < 1e-4


def test_field_is_fitted_in_few_steps(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(7)
    truth = rng.normal(size=(pairs.FEATURES, len(pairs.LABELS)))
    rows = []
    for n in [*rng.integers(1, 4, 3000).tolist(), *range(4, 40)]:
        x = rng.normal(size=(n, pairs.FEATURES)).astype(np.float32)
        rows.append(((x @ truth + rng.gumbel(size=(n, len(pairs.LABELS)))).argmax(1).astype(np.int8).tobytes(), x.tobytes(), 1))
    examples = spark.createDataFrame(rows, "labels binary, rows binary, n long")
    one = pairs.fit_crf(examples)
    passes, ascend = [], pairs.ascend
    monkeypatch.setattr(pairs, "LOCAL", 0)
    monkeypatch.setattr(pairs, "TOGETHER", 1500)
    monkeypatch.setattr(pairs, "ascend", lambda value, *a, **k: ascend(lambda x: (passes.append(len(passes)), value(x))[1] if k else value(x), *a, **k))
    two = pairs.fit_crf(examples)
    assert np.allclose(one.weights, two.weights, atol=5e-3) and np.allclose(one.moves, two.moves, atol=5e-3)
    assert 0 < len(passes) <= 10
    # examples of all lengths make one block
    block = next(pairs.blocks(iter([pd.DataFrame({"labels": [r[0] for r in rows[-40:]], "rows": [r[1] for r in rows[-40:]], "n": [1] * 40})])))
    assert block["examples"].tolist() == [40] and block["longest"].tolist() == [39]
    each = [(len(y), x, y, np.array([n]).tobytes()) for y, x, n in rows[-40:]]
    mine = [tuple(block[c].iloc[0] for c in ("lengths", "rows", "labels", "n"))]
    for w, m in ((None, None), (one.weights, one.moves)):
        assert np.allclose(pairs.sums(each, w, m), pairs.sums(mine, w, m))


def test_clauses_part_as_by_lookbehind():
    import re

    between = re.compile(r"(?<=[.!?؟。！？۔])[\"'”»)\]]*\s+|\n+|(?<=[。！？])(?=[^\W\d_])|(?<=[^\W\d_][.!?])(?=[^\W\d_]{3})")
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("ab1 \n.!?؟。！۔\"')» Ж字_") for _ in range(rng.randint(0, 14)))
        assert pairs.clauses(text) == [c for c in between.split(text) if c and not pairs.ALNUM.fullmatch(c)]


def test_crf_counts_equal_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    k, sizes = len(pairs.LABELS), [4, 3, 3, 1]
    w, m = rng.normal(size=(pairs.FEATURES, k)), rng.normal(size=(k, k))
    data = [rng.normal(size=(n, pairs.FEATURES)) for n in sizes]
    of_w, of_m = pairs.gradient([np.array([x[t] for x in data if len(x) > t]) for t in range(4)], w, m)
    want_w, want_m = np.zeros_like(w), np.zeros_like(m)
    for x in data:
        paths = list(itertools.product(range(k), repeat=len(x)))
        score = np.array([sum((x @ w)[t, y] for t, y in enumerate(p)) + sum(m[a, b] for a, b in zip(p, p[1:])) for p in paths])
        share = np.exp(score - score.max())
        share /= share.sum()
        for p, q in zip(paths, share):
            for t, y in enumerate(p):
                want_w[:, y] += q * x[t]
            for a, b in zip(p, p[1:]):
                want_m[a, b] += q
    assert np.allclose(of_w, want_w) and np.allclose(of_m, want_m)


def test_crf_decodes_like_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    crf = pairs.Crf(rng.normal(size=(pairs.FEATURES, len(pairs.LABELS))), rng.normal(size=(len(pairs.LABELS),) * 2))
    x = rng.normal(size=(3, 4, pairs.FEATURES))
    lengths = np.array([4, 2, 1])
    got = crf.decode(x, lengths)
    for i, n in enumerate(lengths):
        s = x[i, :n] @ crf.weights
        best = max(itertools.product(range(len(pairs.LABELS)), repeat=int(n)), key=lambda y: sum(s[t, y[t]] for t in range(n)) + sum(crf.moves[y[t - 1], y[t]] for t in range(1, n)))
        assert tuple(got[i, :n]) == best


def alignment_lexicon():
    rng = random.Random(3)
    pairs_ = [("en", "fr", *bilingual(rng)) for _ in range(400)]
    return bitext.fit(pairs_)


def best_path_score(sources, targets, lexicon, path=None):
    """Score of the best path over all states, or of the given spans, by the dense table of all moves."""
    emissions = alignment.Emissions(sources, lexicon)
    n, spans = len(sources), list(zip(emissions.starts.tolist(), (emissions.starts + emissions.longer).tolist()))
    jump = lambda d: alignment.JUMP.get(d, alignment.FAR - 0.05 * min(abs(d), alignment.FARTHEST))
    best = {("null", -1): 0.0}
    for j, t in enumerate(targets):
        emit, new = emissions.of(t), {}
        for (kind, p), x in best.items():
            for k, (a, b) in enumerate(spans):
                if path is None or path[j] == (a, b):
                    new[a, b] = max(new.get((a, b), -1e9), x + jump(a - p) + emit[k])
            if path is None or path[j] == (-1, -1):
                new["null", p] = max(new.get(("null", p), -1e9), x + alignment.NULL)
        best = new
    return max(best.values())


def test_alignment_decoding_equals_the_dense_table():
    rng = random.Random(7)
    lexicon = alignment_lexicon()
    for _ in range(6):
        both = [[bitext.tokens(x) for x in bilingual(rng)] for _ in range(9)]
        sources = [s for s, _ in both]
        targets = [t for _, t in both if rng.random() > 0.2]
        rng.shuffle(targets)
        targets[1:3] = [targets[1] + targets[2]]
        got = alignment.decode(sources, targets, lexicon)
        assert abs(best_path_score(sources, targets, lexicon) - best_path_score(sources, targets, lexicon, got)) < 1e-6


def test_long_documents_are_aligned_in_time():
    import time

    rng = random.Random(5)
    both = [bilingual(rng) for _ in range(2000)]
    began = time.time()
    got = alignment.links([s for s, _ in both], [t for _, t in both], alignment_lexicon())
    assert time.time() - began < 60
    assert len(set(got) & {(i, i) for i in range(2000)}) > 1900


def test_alignment(spark, tables):
    segments, results, memory, _ = tables
    rng = random.Random(9)
    rows, want = [], set()
    for key in range(12):
        both = [bilingual(rng) for _ in range(10)]
        source = [s for s, _ in both]
        extra = bilingual(rng)[1]
        t = [x for _, x in both]
        target = [t[0], t[1] + " " + t[2], t[3], extra, t[5], t[4], *t[6:9]]  # merged, added, moved, left out
        rows.append((key, source, target))
        links = [(0, 0), (1, 1), (2, 1), (3, 2), (5, 4), (4, 5), (6, 6), (7, 7), (8, 8)]
        want |= {(key, i, j) for i, j in links}
    rows += [(50, None, ["x"]), (51, [], []), (52, [None, ""], ["x"]), (None, ["a"], ["b"]), rows[0]]
    df = spark.createDataFrame(rows, "pair_id long, source_texts array<string>, target_texts array<string>").withColumn("source_no", F.lit(1))
    got = {tuple(r) for r in alignment.align(df, memory).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
    assert alignment.align(df.limit(0), memory, segments, results).count() == 0


def test_bitext_tokens():
    assert bitext.tokens("Pay ٢,٥٠٠ on 06.07.2028 <g1>now</g1>") == ["pay", "2500", "on", "6", "7", "2028", "now"]
    assert bitext.skeleton("باتونو") == bitext.skeleton("batunu")


def test_short_part_of_a_merged_unit():
    rng = random.Random(5)
    lexicon = bitext.fit([("en", "fr", *bilingual(rng)) for _ in range(300)])
    short, long = "The tenant checks the plan.", "The carrier keeps the invoice LS-3764 146 5812 Nilana Basanu on Monday without any delay"
    merged = "Le transporteur conserve la facture LS-3764 146 5812 Nilana Basanu lundi sans aucun retard ; Le locataire vérifie le plan."
    a, whole, _ = lexicon.covered(bitext.tokens(merged), bitext.tokens(short))
    assert a / whole < 0.3
    assert alignment.links([long, short], [merged], lexicon) == [(0, 0), (1, 0)]
    assert alignment.links([merged], [long, short], lexicon) == [(0, 0), (0, 1)]
    assert not alignment.agree(bitext.tokens("The school signs the policy on Monday without any delay."), bitext.tokens(merged), lexicon)

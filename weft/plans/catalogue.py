"""Named queries over the tables of a data folder, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import checks
from weft.functions import text as T
from weft.operators import files, memory, protected, terms
from weft.operators.dedup import first_delivery
from weft.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Views shared by the SQL texts: every record once.
SEG = "(SELECT DISTINCT ON (id) * FROM segments)"
MEM = "(SELECT DISTINCT ON (id) * FROM tm_entries)"
FILES = "(SELECT DISTINCT ON (id) * FROM source_files)"
RES = "(SELECT DISTINCT ON (batch_id) * FROM batch_results)"
SPAN = "(SELECT DISTINCT ON (span_id) * FROM text_spans)"
UNIT = "(SELECT DISTINCT ON (unit_id) * FROM text_units)"
TAGS = r"regexp_replace({}, '</?g[0-9]+>', '', 'g')"
SPACED = r"trim(regexp_replace({}, '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


def collapse(x: str) -> str:
    return SPACED.format(x)


def visible(x: str) -> str:
    return SPACED.format(TAGS.format(x))


def words(x: str) -> str:
    return f"CASE WHEN coalesce({collapse(x)}, '') = '' THEN 0 ELSE len(string_split({collapse(x)}, ' ')) END"


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def seg(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return first_delivery(table(spark, d, "segments").select("id", *columns), "id")


def mem(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return first_delivery(table(spark, d, "tm_entries").select("id", *columns), "id")


def spans(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return first_delivery(table(spark, d, "text_spans").select("span_id", *columns), "span_id")


def source_files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return first_delivery(table(spark, d, "source_files").select("id", *columns), "id")


def with_languages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    langs = source_files(spark, d, "source_lang", "target_lang").withColumnRenamed("id", "file_id")
    return seg(spark, d, "file_id", *columns).join(langs, "file_id")


# ---------------------------------------------------------------- scans and text

SPLIT_SQL = r"SELECT doc_id, generate_subscripts(l, 1) - 1 AS unit_no, unnest(l) AS text FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents)"
UNITS_SQL = f"SELECT * FROM ({SPLIT_SQL}) WHERE {collapse('text')} <> ''"


@query(f"SELECT doc_id, unit_no::INT AS unit_no, length(text)::INT AS chars FROM ({UNITS_SQL})")
def units_scan(spark, d):
    return files.line_units(table(spark, d, "documents")).select("doc_id", "unit_no", F.length("text").alias("chars"))


@query(f"SELECT doc_id, unit_no::INT AS unit_no, sha256({collapse('text')}) AS source_hash FROM ({UNITS_SQL})")
def unit_hash(spark, d):
    return files.line_units(table(spark, d, "documents")).select("doc_id", "unit_no", T.text_hash("text").alias("source_hash"))


@query(f"SELECT doc_id, count(*) AS units, count(*) FILTER (WHERE length({visible('text')}) >= 2 AND regexp_matches({visible('text')}, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]')) AS translatable FROM ({UNITS_SQL}) GROUP BY doc_id")
def translatable_filter(spark, d):
    u = files.line_units(table(spark, d, "documents"))
    return u.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.count_if(T.is_translatable("text")).alias("translatable"))


@query(f"SELECT id, {words('source_text')}::INT AS words, coalesce(length(source_text), 0)::INT AS chars, coalesce(length({visible('source_text')}), 0)::INT AS visible_chars FROM {SEG}")
def word_char_counts(spark, d):
    s = seg(spark, d, "source_text")
    return s.select("id", T.count_words("source_text").alias("words"), F.coalesce(F.length("source_text"), F.lit(0)).alias("chars"), F.coalesce(F.length(T.visible("source_text")), F.lit(0)).alias("visible_chars"))


@query(r"SELECT id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(source_text, '</?g([0-9]+)>', 1))), ','), '') AS tags FROM " + SEG)
def tags_of_segments(spark, d):
    return seg(spark, d, "source_text").select("id", F.array_join(T.tag_ids("source_text"), ",").alias("tags"))


def _share_sql(pattern: str) -> str:
    letters = r"length(regexp_replace(source_text, '[^\p{L}]', '', 'g'))"
    own = rf"length(regexp_replace(regexp_replace(source_text, '[^\p{{L}}]', '', 'g'), '{pattern}', '', 'g'))"
    return f"CASE WHEN {letters} > 0 THEN round({own}::DOUBLE / {letters}, 6) ELSE 0.0 END"


@query(f"SELECT id, {_share_sql('[^؀-ۿ]')} AS arabic, {_share_sql('[^A-Za-zÀ-ɏ]')} AS latin, {_share_sql('[^Ѐ-ӿ]')} AS cyrillic FROM {SEG}")
def script_ratio(spark, d):
    s = seg(spark, d, "source_text")
    return s.select("id", *[F.round(T.script_share("source_text", k), 6).alias(k) for k in ("arabic", "latin", "cyrillic")])


@query(r"SELECT verse_key, regexp_replace(arabic, '[ً-ْٰـ]', '', 'g') AS bare, round(CASE WHEN length(regexp_replace(arabic, '[^ء-غف-ي]', '', 'g')) >= 8 THEN length(regexp_replace(arabic, '[^ً-ْٰ]', '', 'g'))::DOUBLE / length(regexp_replace(arabic, '[^ء-غف-ي]', '', 'g')) ELSE 0.0 END, 6) AS marked FROM verse_catalogue".replace("regexp_replace(arabic, '[ً-ْٰـ]', '', 'g') AS bare", collapse("regexp_replace(arabic, '[ً-ْٰـ]', '', 'g')") + " AS bare"))
def verse_forms(spark, d):
    return table(spark, d, "verse_catalogue").select("verse_key", T.bare_arabic("arabic").alias("bare"), F.round(T.marked_share("arabic"), 6).alias("marked"))


# ---------------------------------------------------------------- memory

LANGS_SQL = f"SELECT s.*, f.source_lang, f.target_lang FROM {SEG} s JOIN {FILES} f ON f.id = s.file_id"


def _exact_sql(domain: str | None) -> str:
    other = f"domain IS DISTINCT FROM '{domain}'" if domain else "TRUE"
    best = f"SELECT source_hash, source_lang, target_lang, min({{'o': {other}, 'd': domain, 'i': id}}) AS m FROM {MEM} WHERE source_hash IS NOT NULL GROUP BY ALL"
    return f"SELECT s.id AS segment_id, m.i AS memory_id, NOT m.o AS same_domain FROM ({LANGS_SQL}) s JOIN ({best}) b USING (source_hash, source_lang, target_lang)"


@query(_exact_sql(None))
def exact_memory_lookup(spark, d):
    return memory.exact(with_languages(spark, d, "source_hash"), mem(spark, d, "source_hash", "source_lang", "target_lang", "domain"))


@query(_exact_sql("legal"))
def exact_lookup_domain_fallback(spark, d):
    return memory.exact(with_languages(spark, d, "source_hash"), mem(spark, d, "source_hash", "source_lang", "target_lang", "domain"), "legal")


@query(f"SELECT file_id, count(*) AS segments, count(DISTINCT source_hash) AS hashes, count(DISTINCT CASE WHEN hit THEN source_hash END) AS hit_hashes, round(count(*) FILTER (WHERE hit)::DOUBLE / count(*), 4) AS coverage FROM (SELECT s.*, EXISTS (SELECT 1 FROM {MEM} m WHERE m.source_hash = s.source_hash AND m.source_lang = s.source_lang AND m.target_lang = s.target_lang) AS hit FROM ({LANGS_SQL}) s) GROUP BY file_id")
def memory_coverage(spark, d):
    keys = mem(spark, d, "source_hash", "source_lang", "target_lang").select("source_hash", "source_lang", "target_lang").distinct().withColumn("hit", F.lit(True))
    s = with_languages(spark, d, "source_hash").join(keys, ["source_hash", "source_lang", "target_lang"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return s.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("segments"), F.count_distinct("source_hash").alias("hashes"), F.count_distinct(F.when(F.col("hit"), F.col("source_hash"))).alias("hit_hashes"),
        F.round(F.count_if("hit") / F.count(F.lit(1)), 4).alias("coverage"),
    )


def fuzzy_queries(spark, d):
    """The stated query set: segments whose id, its first eight hexadecimal digits as a number, is divisible by 50.

    A segment is looked up in the domain of its project, the one most of the project's own entries have;
    without such entries in 'general'.
    """
    n = mem(spark, d, "origin_project_id", "domain").where("origin_project_id IS NOT NULL AND domain IS NOT NULL").groupBy(F.col("origin_project_id").alias("project_id"), "domain").agg(F.count(F.lit(1)).alias("n"))
    domains = n.groupBy("project_id").agg(F.min_by("domain", F.struct(-F.col("n"), "domain")).alias("domain"))
    files_of = source_files(spark, d, "project_id").withColumnRenamed("id", "file_id").join(domains, "project_id").select("file_id", "domain")
    s = with_languages(spark, d, "source_text").withColumnRenamed("source_text", "text")
    s = s.join(files_of, "file_id", "left").fillna("general", ["domain"])
    return s.where(F.conv(F.left("id", F.lit(8)), 16, 10).cast("long") % 50 == 0)


def fuzzy_memory(spark, d):
    return mem(spark, d, "source_text", "source_lang", "target_lang", "domain").withColumnRenamed("source_text", "text")


@query(
    f"""WITH pd AS (SELECT project_id, arg_min(domain, (-n, domain)) AS domain FROM (SELECT origin_project_id AS project_id, domain, count(*) AS n FROM {MEM} WHERE origin_project_id IS NOT NULL AND domain IS NOT NULL GROUP BY ALL) GROUP BY 1),
q AS (SELECT l.id AS segment_id, {visible('source_text')} AS query, l.source_lang, l.target_lang, coalesce(domain, 'general') AS domain FROM ({LANGS_SQL}) l JOIN {FILES} f ON f.id = l.file_id LEFT JOIN pd USING (project_id)
WHERE ('0x' || left(l.id, 8))::BIGINT % 50 = 0),
m AS (SELECT id AS memory_id, {visible('source_text')} AS candidate, source_lang, target_lang, domain FROM {MEM}),
p AS (SELECT segment_id, memory_id, abs(length(candidate) - length(query))::INT AS gap FROM q JOIN m USING (source_lang, target_lang, domain)
WHERE length(query) >= 8 AND length(candidate) BETWEEN floor(length(query) * 0.75)::INT AND floor(length(query) / 0.75)::INT + 1)
SELECT segment_id, memory_id, gap, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY gap, memory_id) AS place FROM p) WHERE place <= 800"""
)
def fuzzy_candidates(spark, d):
    return memory.band(fuzzy_queries(spark, d), fuzzy_memory(spark, d)).select("segment_id", "memory_id", "gap", "place")


@query()
def fuzzy_topk(spark, d):
    return memory.fuzzy(fuzzy_queries(spark, d), fuzzy_memory(spark, d))


@query(
    f"""WITH u AS (SELECT sha256({collapse('source_text')}) AS source_hash, source_lang, target_lang, 'general' AS domain, count(*) AS n, max({{'s': order_index, 't': target_text}}).t AS nt, min({{'s': order_index, 'x': source_text}}).x AS ns
FROM ({LANGS_SQL}) WHERE edited_by_human AND {collapse('source_text')} <> '' AND {collapse('target_text')} <> '' GROUP BY ALL),
m AS (SELECT source_hash, source_lang, target_lang, domain, min({{'i': id, 's': source_text, 't': target_text, 'n': usage_count}}) AS o FROM {MEM} GROUP BY ALL)
SELECT source_hash, source_lang, target_lang, domain, coalesce(o.s, ns) AS source_text, coalesce(nt, o.t) AS target_text,
(CASE WHEN o IS NULL THEN n - 1 ELSE coalesce(o.n, 0) + coalesce(n, 0) END)::BIGINT AS usage_count, length({visible('coalesce(o.s, ns)')})::INT AS source_length
FROM m FULL JOIN u USING (source_hash, source_lang, target_lang, domain)"""
)
def memory_upsert(spark, d):
    edits = with_languages(spark, d, "source_text", "target_text", "order_index", "edited_by_human").where("edited_by_human")
    updates = edits.select("source_text", "target_text", "source_lang", "target_lang", F.lit("general").alias("domain"), F.col("order_index").alias("seq"))
    return memory.upsert(mem(spark, d, "source_hash", "source_text", "target_text", "source_lang", "target_lang", "domain", "usage_count"), updates)


@query(f"SELECT domain, source_lang, target_lang, count(*) AS entries, count(DISTINCT source_hash) AS sentences, sum(usage_count)::BIGINT AS used, count(*) FILTER (WHERE source_length IS DISTINCT FROM length(source_text)) AS wrong_length FROM {MEM} GROUP BY ALL")
def memory_stats(spark, d):
    return mem(spark, d, "domain", "source_lang", "target_lang", "source_hash", "usage_count", "source_length", "source_text").groupBy("domain", "source_lang", "target_lang").agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("source_hash").alias("sentences"), F.sum("usage_count").cast("long").alias("used"),
        F.count_if(~F.col("source_length").eqNullSafe(F.length("source_text"))).alias("wrong_length"),
    )


@query(f"SELECT id, usage_count FROM {MEM} ORDER BY usage_count DESC, id LIMIT 100")
def memory_mine_topk(spark, d):
    return mem(spark, d, "usage_count").orderBy(F.desc("usage_count"), "id").limit(100)


@query(f"SELECT source_hash, source_lang, target_lang, count(*) AS entries, count(DISTINCT target_text) AS renderings FROM {MEM} GROUP BY ALL HAVING count(DISTINCT target_text) > 1")
def memory_inconsistent(spark, d):
    return mem(spark, d, "source_hash", "source_lang", "target_lang", "target_text").groupBy("source_hash", "source_lang", "target_lang").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("target_text").alias("renderings")).where("renderings > 1")


# ---------------------------------------------------------------- terms

TERMS_SQL = f"""SELECT source_term, target_term, count(*) AS frequency FROM (SELECT {visible('source_text')} AS source_term, {visible('target_text')} AS target_term FROM {SEG})
WHERE {words('source_term')} BETWEEN 1 AND 4 AND {words('target_term')} BETWEEN 1 AND 4 AND NOT regexp_matches(source_term, '\\p{{N}}') AND NOT regexp_matches(target_term, '\\p{{N}}')
AND length(source_term) >= 2 AND length(target_term) >= 2 AND regexp_matches(source_term, '\\p{{L}}') AND regexp_matches(target_term, '\\p{{L}}') GROUP BY ALL"""


def term_pairs(spark, d):
    return terms.candidates(seg(spark, d, "source_text", "target_text"))


@query(TERMS_SQL)
def term_tally(spark, d):
    return term_pairs(spark, d)


@query(f"SELECT source_term, count(*) AS renderings, arg_min(target_term, place) AS best, sum(frequency)::BIGINT AS frequency FROM (SELECT *, row_number() OVER (PARTITION BY source_term ORDER BY frequency DESC, target_term) AS place FROM ({TERMS_SQL})) GROUP BY source_term HAVING count(*) > 1")
def term_conflicts(spark, d):
    return terms.conflicts(term_pairs(spark, d))


@query(f"SELECT source_term, target_term, frequency, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY source_term ORDER BY frequency DESC, target_term) AS place FROM ({TERMS_SQL})) WHERE place > 1")
def term_alternatives(spark, d):
    return terms.ranked(term_pairs(spark, d)).where("place > 1")


@query(
    f"""SELECT s.id AS segment_id, source_term, target_term FROM (SELECT source_term, target_term FROM (SELECT *, row_number() OVER (PARTITION BY source_term ORDER BY frequency DESC, target_term) AS place
FROM ({TERMS_SQL})) WHERE place = 1 AND frequency >= 2 AND source_term <> '') t JOIN {SEG} s ON contains({collapse('s.source_text')}, source_term) AND NOT contains(lower({collapse('s.target_text')}), lower(target_term))"""
)
def term_enforcement(spark, d):
    best = terms.ranked(term_pairs(spark, d)).where((F.col("place") == 1) & (F.col("frequency") >= 2)).select("source_term", "target_term")
    return terms.enforcement(seg(spark, d, "source_text", "target_text").withColumnRenamed("id", "segment_id"), best)


@query(f"SELECT id, regexp_replace(target_text, '(?i)\\binvoice\\b', 'bill', 'g') AS proposal FROM {SEG} WHERE NOT is_locked AND regexp_matches({visible('target_text')}, '(?i)\\binvoice\\b')")
def term_propagation(spark, d):
    s = seg(spark, d, "target_text", "is_locked").where(~F.col("is_locked") & T.visible("target_text").rlike(terms.whole_word("invoice")))
    return s.select("id", terms.replace_term(F.col("target_text"), "invoice", "bill").alias("proposal"))


# ---------------------------------------------------------------- review

PAGE = "file_id, order_index, id"


@query(f"SELECT id, order_index FROM {SEG} WHERE file_id = (SELECT max(file_id) FROM segments) ORDER BY order_index, id LIMIT 200 OFFSET 0")
def segments_page(spark, d):
    s = seg(spark, d, "file_id", "order_index")
    top = table(spark, d, "segments").agg(F.max("file_id").alias("file_id"))
    return s.join(F.broadcast(top), "file_id").select("id", "order_index").orderBy("order_index", "id").offset(0).limit(200)


@query(f"SELECT id, file_id, order_index FROM {SEG} WHERE contains(lower(source_text), 'invoice') OR contains(lower(target_text), 'invoice')")
def segments_search(spark, d):
    return seg(spark, d, "file_id", "order_index", "source_text", "target_text").where(F.contains(F.lower("source_text"), F.lit("invoice")) | F.contains(F.lower("target_text"), F.lit("invoice"))).select("id", "file_id", "order_index")


@query(f"SELECT file_id, count(*) AS pending, sum(length(source_text))::BIGINT AS chars FROM {SEG} WHERE is_translatable AND NOT is_locked AND coalesce({collapse('target_text')}, '') = '' GROUP BY file_id")
def pending_segments(spark, d):
    s = seg(spark, d, "file_id", "source_text", "target_text", "is_locked", "is_translatable").where(F.col("is_translatable") & ~F.col("is_locked") & (F.coalesce(T.collapse("target_text"), F.lit("")) == ""))
    return s.groupBy("file_id").agg(F.count(F.lit(1)).alias("pending"), F.sum(F.length("source_text")).alias("chars"))


@query(f"SELECT file_id, count(*) AS total, count(*) FILTER (WHERE is_locked) AS locked, count(*) FILTER (WHERE len(qa_flags) > 0) AS flagged, count(*) FILTER (WHERE edited_by_human) AS edited, count(*) FILTER (WHERE coalesce({collapse('target_text')}, '') <> '') AS answered FROM {SEG} GROUP BY file_id")
def progress_by_file(spark, d):
    s = seg(spark, d, "file_id", "is_locked", "qa_flags", "edited_by_human", "target_text")
    return s.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_locked").alias("locked"), F.count_if(F.coalesce(F.size("qa_flags"), F.lit(0)) > 0).alias("flagged"),
        F.count_if("edited_by_human").alias("edited"), F.count_if(F.coalesce(T.collapse("target_text"), F.lit("")) != "").alias("answered"),
    )


@query(f"SELECT project_id, count(*) AS files, coalesce(sum(char_count), 0)::BIGINT AS chars, coalesce(sum(page_count), 0)::BIGINT AS pages, max(created_at) AS last_created FROM {FILES} GROUP BY project_id")
def project_summary(spark, d):
    f = source_files(spark, d, "project_id", "char_count", "page_count", "created_at")
    zero = F.lit(0).cast("long")
    return f.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("char_count"), zero).alias("chars"), F.coalesce(F.sum("page_count"), zero).alias("pages"), F.max("created_at").alias("last_created"))


@query(f"SELECT project_id, max({{'c': created_at, 'i': id}}).i AS latest FROM {FILES} GROUP BY project_id")
def latest_file(spark, d):
    return source_files(spark, d, "project_id", "created_at").groupBy("project_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("latest"))


@query(f"SELECT f.id FROM {FILES} f ANTI JOIN segments s ON s.file_id = f.id")
def files_without_segments(spark, d):
    return source_files(spark, d).join(table(spark, d, "segments").select(F.col("file_id").alias("id")), "id", "left_anti")


@query(f"SELECT id, siblings FROM (SELECT id, count(*) OVER (PARTITION BY file_id, source_hash) - 1 AS siblings FROM {SEG} WHERE source_hash IS NOT NULL) WHERE siblings > 0")
def exact_siblings(spark, d):
    return files.siblings(seg(spark, d, "file_id", "source_hash"))


# ---------------------------------------------------------------- checks


NUM = r"regexp_extract_all({}, '\p{{Nd}}{{1,3}}(?:[.,\x{{00A0}}\x{{202F}} ]\p{{Nd}}{{3}})+(?:[.,]\p{{Nd}}+)?|\p{{Nd}}+[.,]\p{{Nd}}+|\p{{Nd}}+')"


def _digits(x: str) -> str:
    return f"array_to_string(list_sort(list_transform({NUM.format(visible(x))}, lambda n: regexp_replace(n, '[^\\p{{Nd}}]', '', 'g'))), ' ')"


def _share(x: str, script: str) -> str:
    letters = f"regexp_replace({x}, '[^\\p{{L}}]', '', 'g')"
    own = " ".join(f"WHEN '{k}' THEN length(regexp_replace({letters}, '[^{v[1:]}', '', 'g'))" for k, v in T.SCRIPTS.items())
    return f"coalesce(CASE {script} {own} ELSE 0 END / nullif(length({letters}), 0)::DOUBLE, 0)"


def _script(language: str) -> str:
    return f"CASE lower(split_part({language}, '-', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.SCRIPT_OF.items()) + " END"


RUNS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')"


def _repeats(w: str) -> str:
    return f"len(list_filter(range(1, len({w})), lambda i: {w}[i] = {w}[i + 1] AND length({w}[i]) <= 4)) > 0"


QA_SQL = f"""WITH p AS (SELECT s.id, {visible("coalesce(source_text, '')")} AS s, {visible('target_text')} AS t, source_lang, target_lang,
list_sort(list_distinct(regexp_extract_all(coalesce(source_text, ''), '</?g(\\p{{Nd}}+)>', 1))) AS a, list_sort(list_distinct(regexp_extract_all(coalesce(target_text, ''), '</?g(\\p{{Nd}}+)>', 1))) AS b
FROM {SEG} s JOIN {FILES} f ON f.id = s.file_id),
q AS (SELECT *, list_filter(a, lambda x: NOT list_contains(b, x)) AS gone, list_filter(b, lambda x: NOT list_contains(a, x)) AS extra, list_sort({NUM.format('s')}) AS rs, list_sort({NUM.format('t')}) AS rt,
regexp_extract_all(s, '(\\p{{Nd}}+\\.\\p{{Nd}}{{3}})(?:[^\\p{{Nd}}]|$)', 1) AS amb, {_script('source_lang')} AS ss, {_script('target_lang')} AS st, {RUNS.format('s')} AS ws, {RUNS.format('t')} AS wt, length(t) / greatest(length(s), 1)::DOUBLE AS ratio FROM p),
r AS (SELECT *, list_sort(list_transform(rs, lambda n: regexp_replace(n, '[^\\p{{Nd}}]', '', 'g'))) AS ds, list_sort(list_transform(rt, lambda n: regexp_replace(n, '[^\\p{{Nd}}]', '', 'g'))) AS dt FROM q)
SELECT id, flags FROM (SELECT id, CASE WHEN coalesce(t, '') = '' THEN 'empty' ELSE array_to_string(list_filter([
CASE WHEN len(gone) > 0 THEN 'tags_missing:' || array_to_string(gone, ',') END, CASE WHEN len(extra) > 0 THEN 'tags_extra:' || array_to_string(extra, ',') END,
CASE WHEN ds <> dt THEN 'numbers_mismatch' WHEN rs <> rt THEN 'separator_changed' END, CASE WHEN len(amb) > 0 THEN 'ambiguous_separator:' || array_to_string(amb[1:3], ',') END,
CASE WHEN ss <> st AND {_share('t', 'ss')} > 0.3 THEN 'untranslated' WHEN ss <> st AND {_share('t', 'st')} < 0.3 AND length(t) > 12 THEN 'wrong_script' END,
CASE WHEN {_repeats('wt')} AND NOT {_repeats('ws')} THEN 'duplicated_word' END,
CASE WHEN length(s) >= 25 AND ratio < 0.4 THEN 'too_short' WHEN length(s) >= 25 AND ratio > 3 THEN 'too_long' END], lambda x: x IS NOT NULL), '|') END AS flags FROM r) WHERE flags <> ''"""


@query(QA_SQL)
def qa_flags(spark, d):
    s = with_languages(spark, d, "source_text", "target_text")
    return s.select("id", F.array_join(checks.flags(F.col("source_text"), F.col("target_text"), F.col("source_lang"), F.col("target_lang")), "|").alias("flags")).where("flags <> ''")


@query(f"SELECT id, {_digits('source_text')} AS source_numbers, {_digits('target_text')} AS target_numbers FROM {SEG} WHERE {_digits('source_text')} <> {_digits('target_text')}")
def number_multiset_check(spark, d):
    a, b = (F.array_join(T.number_digits(T.visible(c)), " ") for c in ("source_text", "target_text"))
    s = seg(spark, d, "source_text", "target_text").select("id", a.alias("source_numbers"), b.alias("target_numbers"))
    return s.where("source_numbers <> target_numbers")


@query(f"SELECT id FROM (SELECT id, regexp_extract_all(lower(target_text), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+') AS w FROM {SEG} WHERE target_text IS NOT NULL) WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND length(w[i]) BETWEEN 1 AND 4)) > 0")
def adjacent_duplicate(spark, d):
    return seg(spark, d, "target_text").where(T.repeats_word("target_text")).select("id")


@query(f"SELECT id, round(length({visible('target_text')})::DOUBLE / length({visible('source_text')}), 4) AS ratio FROM {SEG} WHERE length({visible('source_text')}) >= 25 AND (length({visible('target_text')}) < 0.4 * length({visible('source_text')}) OR length({visible('target_text')}) > 3 * length({visible('source_text')}))")
def length_anomaly(spark, d):
    a, b = F.length(T.visible("source_text")), F.length(T.visible("target_text"))
    return seg(spark, d, "source_text", "target_text").where((a >= 25) & ((b < 0.4 * a) | (b > 3 * a))).select("id", F.round(b / a, 4).alias("ratio"))


@query(f"SELECT file_id, unit_key, round(t / s + 1e-9, 2) AS growth FROM (SELECT file_id, unit_key, sum(length(source_text))::DOUBLE AS s, sum(length(target_text))::DOUBLE AS t FROM {SEG} GROUP BY ALL) WHERE s >= 20 AND t > 1.25 * s")
def overflow_report(spark, d):
    u = seg(spark, d, "file_id", "unit_key", "source_text", "target_text").groupBy("file_id", "unit_key").agg(F.sum(F.length("source_text")).cast("double").alias("s"), F.sum(F.length("target_text")).cast("double").alias("t"))
    return u.where("s >= 20 AND t > 1.25 * s").select("file_id", "unit_key", F.round(F.col("t") / F.col("s") + 1e-9, 2).alias("growth"))


# ---------------------------------------------------------------- batches and files


@query(f"SELECT segment_id FROM (SELECT DISTINCT unnest(segment_ids) AS segment_id FROM {RES}) r ANTI JOIN {SEG} s ON s.id = r.segment_id")
def results_without_segment(spark, d):
    r = table(spark, d, "batch_results").select(F.explode("segment_ids").alias("segment_id")).distinct()
    return r.join(table(spark, d, "segments").select(F.col("id").alias("segment_id")), "segment_id", "left_anti")


@query(f"SELECT r.batch_id, count(*) AS sent, count(*) FILTER (WHERE coalesce({collapse('s.target_text')}, '') = '') AS unanswered FROM (SELECT batch_id, unnest(segment_ids) AS id FROM {RES}) r JOIN {SEG} s USING (id) GROUP BY r.batch_id")
def unanswered_by_batch(spark, d):
    r = first_delivery(table(spark, d, "batch_results").select("batch_id", "segment_ids"), "batch_id").select("batch_id", F.explode("segment_ids").alias("id"))
    s = seg(spark, d, "target_text")
    return r.join(s, "id").groupBy("batch_id").agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.coalesce(T.collapse("target_text"), F.lit("")) == "").alias("unanswered"))


@query(
    f"""WITH RECURSIVE o AS (SELECT id, file_id, coalesce(length(source_text), 0) AS n, row_number() OVER (PARTITION BY file_id ORDER BY order_index, id) AS k FROM {SEG} WHERE is_translatable AND NOT is_locked),
f AS (SELECT file_id, id, k, 0 AS batch_no, n AS used, 1 AS held FROM o WHERE k = 1
UNION ALL SELECT o.file_id, o.id, o.k, CASE WHEN f.used + o.n > 6000 OR f.held >= 40 THEN f.batch_no + 1 ELSE f.batch_no END,
CASE WHEN f.used + o.n > 6000 OR f.held >= 40 THEN o.n ELSE f.used + o.n END, CASE WHEN f.used + o.n > 6000 OR f.held >= 40 THEN 1 ELSE f.held + 1 END
FROM f JOIN o ON o.file_id = f.file_id AND o.k = f.k + 1) SELECT file_id, id, batch_no FROM f"""
)
def greedy_batches(spark, d):
    s = seg(spark, d, "file_id", "order_index", "source_text", "is_translatable", "is_locked").where(F.col("is_translatable") & ~F.col("is_locked"))
    return files.greedy_batches(s)


PLAIN = TAGS.format("coalesce(source_text, '')")


@query(
    f"""SELECT id, right(coalesce(string_agg(p, ' ') OVER (PARTITION BY file_id ORDER BY order_index, id ROWS BETWEEN 221 PRECEDING AND 1 PRECEDING), ''), 220) AS before,
left(coalesce(string_agg(p, ' ') OVER (PARTITION BY file_id ORDER BY order_index, id ROWS BETWEEN 1 FOLLOWING AND 221 FOLLOWING), ''), 220) AS after FROM (SELECT *, {PLAIN} AS p FROM {SEG})"""
)
def context_around(spark, d):
    return files.context(seg(spark, d, "file_id", "order_index", "source_text"))


@query(f"SELECT file_id, unit_key, string_agg(CASE WHEN coalesce({collapse('target_text')}, '') <> '' THEN target_text ELSE coalesce(source_text, '') END || coalesce(trailing_ws, ''), '' ORDER BY unit_order, id) AS text FROM {SEG} GROUP BY ALL")
def assemble_units(spark, d):
    return files.assembled(seg(spark, d, "file_id", "unit_key", "unit_order", "source_text", "target_text", "trailing_ws"))


@query(f"SELECT id, (row_number() OVER (PARTITION BY file_id ORDER BY order_index, id) - 1)::INT AS file_place, (row_number() OVER (PARTITION BY file_id, unit_key ORDER BY unit_order, id) - 1)::INT AS unit_place FROM {SEG}")
def order_index(spark, d):
    return files.numbered(seg(spark, d, "file_id", "unit_key", "order_index", "unit_order"))


@query()
def unit_sentences(spark, d):
    u = first_delivery(table(spark, d, "text_units").select("unit_id", "text"), "unit_id")
    return files.sentences(u, ["unit_id"])


@query("SELECT pair_id, (s.i - 1)::INT AS place, s.x AS source_text, t.x AS target_text FROM (SELECT DISTINCT ON (pair_id) * FROM alignments) a, LATERAL (SELECT unnest(source_texts) AS x, generate_subscripts(source_texts, 1) AS i) s, LATERAL (SELECT unnest(target_texts) AS x, generate_subscripts(target_texts, 1) AS i) t WHERE s.i = t.i")
def positional_alignment(spark, d):
    a = first_delivery(table(spark, d, "alignments").select("pair_id", "source_texts", "target_texts"), "pair_id")
    n = F.least(F.size("source_texts"), F.size("target_texts"))
    z = F.arrays_zip(F.slice("source_texts", 1, n).alias("source_text"), F.slice("target_texts", 1, n).alias("target_text"))
    return a.select("pair_id", F.posexplode(z).alias("place", "p")).select("pair_id", "place", F.col("p.source_text").alias("source_text"), F.col("p.target_text").alias("target_text"))


# ---------------------------------------------------------------- pages


@query(f"SELECT file_id, page, count(*) AS lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max({{'w': x1 - x0, 'o': -order_no, 'f': font}}).f AS font FROM {SPAN} GROUP BY ALL")
def page_boxes(spark, d):
    return files.page_boxes(spans(spark, d, "file_id", "page", "order_no", "x0", "y0", "x1", "y1", "font"))


@query(f"SELECT span_id, row_number() OVER (PARTITION BY file_id, page ORDER BY round_even(y0 / 12.0, 0), x0, span_id)::INT AS place FROM {SPAN}")
def reading_order(spark, d):
    return files.reading_order(spans(spark, d, "file_id", "page", "x0", "y0"))


@query()
def line_blocks(spark, d):
    return files.merge_lines(spans(spark, d, "file_id", "page", "x0", "y0", "x1", "y1"))


@query(f"SELECT file_id, page, c::BIGINT AS chars, p::BIGINT AS private_chars, c >= 40 AND p >= 0.1 * c AS unreliable FROM (SELECT file_id, page, sum(coalesce(length(text), 0)) AS c, sum(coalesce(length(regexp_replace(text, '[^\\x{{E000}}-\\x{{F8FF}}]', '', 'g')), 0)) AS p FROM {SPAN} GROUP BY ALL)")
def page_quality(spark, d):
    return files.page_quality(spans(spark, d, "file_id", "page", "text"))


@query(f"SELECT id, page_count, len(pages_without_text) AS without_text, len(unreliable_pages) AS unreliable, coalesce(len(pages_without_text), 0) > 0.6 * page_count AS scanned, coalesce(len(unreliable_pages), 0) > 0.1 * page_count AS text_unreliable FROM {FILES} WHERE fmt = 'pdf' AND page_count > 0")
def file_diagnosis(spark, d):
    f = source_files(spark, d, "fmt", "page_count", "pages_without_text", "unreliable_pages").where("fmt = 'pdf' AND page_count > 0")
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("long"))
    zero = F.lit(0).cast("long")
    return f.select("id", "page_count", n("pages_without_text").alias("without_text"), n("unreliable_pages").alias("unreliable"), (F.coalesce(n("pages_without_text"), zero) > 0.6 * F.col("page_count")).alias("scanned"), (F.coalesce(n("unreliable_pages"), zero) > 0.1 * F.col("page_count")).alias("text_unreliable"))


# ---------------------------------------------------------------- usage


@query(f"SELECT date_trunc('month', created_at)::TIMESTAMP AS month, source_lang, target_lang, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(coalesce(len(missing), 0))::BIGINT AS missing FROM {RES} GROUP BY ALL")
def usage_by_month(spark, d):
    r = first_delivery(table(spark, d, "batch_results").select("batch_id", "created_at", "source_lang", "target_lang", "input_tokens", "output_tokens", "missing"), "batch_id")
    return r.groupBy(F.date_trunc("month", "created_at").alias("month"), "source_lang", "target_lang").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.coalesce(F.size("missing"), F.lit(0)).cast("long")).alias("missing"))


@query(f"SELECT file_id, count(*) AS calls, round(epoch(max(created_at) - min(created_at)) / (count(*) - 1), 3) AS seconds_a_call FROM {RES} GROUP BY file_id HAVING count(*) >= 2")
def call_latency(spark, d):
    r = first_delivery(table(spark, d, "batch_results").select("batch_id", "file_id", "created_at"), "batch_id")
    span = F.expr("timestampdiff(MICROSECOND, min(created_at), max(created_at))") / 1e6
    return r.groupBy("file_id").agg(F.count(F.lit(1)).alias("calls"), F.round(span / (F.greatest(F.count(F.lit(1)), F.lit(2)) - 1), 3).alias("seconds_a_call")).where("calls >= 2")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR event_type <> b")
def change_feed(spark, d):
    return files.changes(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


# ---------------------------------------------------------------- protected passages


@query()
def protected_spans(spark, d):
    return protected.spans(seg(spark, d, "source_text"), "id", "source_text")


def _verse_letters(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '{T.DIACRITICS}', '', 'g'), '[ء-اىوية]', '', 'g'), '[^ب-ي]', '', 'g')"


@query(
    f"""SELECT DISTINCT s.id, v.verse_key FROM (SELECT id, {_verse_letters('source_text')} AS l FROM {SEG} WHERE regexp_matches(source_text, '[ء-غف-ي]')) s
JOIN (SELECT verse_key, {_verse_letters('arabic')} AS l FROM verse_catalogue) v ON length(v.l) >= 12 AND contains(s.l, v.l)"""
)
def verses_in_segments(spark, d):
    return protected.verses_in(seg(spark, d, "source_text"), "id", "source_text", table(spark, d, "verse_catalogue"))


@query()
def normalized_segments(spark, d):
    s = seg(spark, d, "source_text")
    return protected.normalized(s.withColumn("before", F.col("source_text")), "source_text").where("before <> source_text").select("id", "source_text")


@query()
def batch_payloads(spark, d):
    s = seg(spark, d, "file_id", "order_index", "source_text", "is_translatable", "is_locked").where(F.col("is_translatable") & ~F.col("is_locked"))
    return files.payloads(s, files.greedy_batches(s)).select("file_id", "batch_no", F.length("payload").alias("chars"), F.sha2("payload", 256).alias("payload_hash"))


BULK_SQL = f"""WITH old AS (SELECT source_term, 'general' AS domain, min(target_term) AS o FROM ({TERMS_SQL}) WHERE frequency > 2 GROUP BY ALL),
neu AS (SELECT source_term, 'general' AS domain, max({{'f': frequency, 't': target_term}}).t AS n FROM ({TERMS_SQL}) GROUP BY ALL)
SELECT source_term, domain, coalesce(n, o) AS target_term, CASE WHEN o IS NULL THEN 'added' WHEN n IS NOT NULL AND n <> o THEN 'updated' ELSE 'kept' END AS action FROM old FULL JOIN neu USING (source_term, domain)"""


@query(BULK_SQL)
def term_bulk_actions(spark, d):
    t = term_pairs(spark, d).withColumn("domain", F.lit("general"))
    return terms.bulk(t.where("frequency > 2"), t.withColumnRenamed("frequency", "seq"))


@query(f"SELECT status, fmt, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM {FILES} GROUP BY ALL")
def files_by_status(spark, d):
    return source_files(spark, d, "status", "fmt", "size_bytes").groupBy("status", "fmt").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


@query(f"SELECT lang, kind, count(*) AS units, sum({words('text')})::BIGINT AS words FROM {UNIT} GROUP BY ALL")
def units_by_language(spark, d):
    u = first_delivery(table(spark, d, "text_units").select("unit_id", "lang", "kind", "text"), "unit_id")
    return u.groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("units"), F.sum(T.count_words("text")).alias("words"))

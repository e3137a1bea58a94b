"""Queries on changes to segments, memory and files, registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import checks
from weft.functions import text as T
from weft.operators import upkeep
from weft.operators.dedup import first_delivery
from weft.plans.catalogue import FILES, MEM, SEG, SPAN, TAGS, collapse, mem, query, seg, source_files, spans, term_pairs, visible, words
from weft.plans.catalogue import TERMS_SQL
from weft.session import table
from weft.sources.plain import FORMATS

LETTER = r"regexp_matches({}, '[\p{{L}}\p{{Nl}}\p{{No}}]')"


def translatable(x: str) -> str:
    return f"coalesce(length({visible(x)}) >= 2 AND {LETTER.format(visible(x))}, false)"


@query(
    f"""SELECT file_id, count(*) AS total, count(*) FILTER (WHERE status = 'draft') AS draft, count(*) FILTER (WHERE status = 'translated') AS translated,
count(*) FILTER (WHERE status = 'reviewed') AS reviewed, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE len(coalesce(qa_flags, [])) > 0) AS flagged,
round_even(100 * count(*) FILTER (WHERE status IN ('approved', 'reviewed'))::DOUBLE / count(*), 0)::INT AS done_pct FROM {SEG} GROUP BY file_id"""
)
def status_pivot(spark, d):
    s = seg(spark, d, "file_id", "status", "qa_flags")
    count = lambda *names: F.count_if(F.col("status").isin(*names))
    return s.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("total"), *[count(x).alias(x) for x in ("draft", "translated", "reviewed", "approved")],
        F.count_if(F.coalesce(F.size("qa_flags"), F.lit(0)) > 0).alias("flagged"), F.bround(100.0 * count("approved", "reviewed") / F.count(F.lit(1))).cast("int").alias("done_pct"),
    )


@query(
    f"""SELECT file_id, count(*) FILTER (WHERE {collapse("coalesce(target_text, '')")} <> '') AS translated, count(*) FILTER (WHERE origin = 'tm_exact') AS from_memory,
count(*) FILTER (WHERE {collapse("coalesce(target_text, '')")} = '') AS failed, count(DISTINCT engine_model) AS engines FROM {SEG} GROUP BY file_id"""
)
def translation_stats(spark, d):
    s = seg(spark, d, "file_id", "target_text", "origin", "engine_model")
    there = F.coalesce(T.collapse("target_text"), F.lit("")) != ""
    return s.groupBy("file_id").agg(F.count_if(there).alias("translated"), F.count_if(F.col("origin") == "tm_exact").alias("from_memory"), F.count_if(~there).alias("failed"), F.count_distinct("engine_model").alias("engines"))


@query(f"SELECT id, order_index, total FROM (SELECT id, file_id, order_index, count(*) OVER () AS total FROM {SEG} WHERE file_id = (SELECT min(file_id) FROM segments WHERE order_index >= 60) AND status = 'translated' AND len(coalesce(qa_flags, [])) = 0 AND contains(lower(source_text), '1')) ORDER BY order_index, id LIMIT 50 OFFSET 1")
def segments_page_filtered(spark, d):
    top = table(spark, d, "segments").where("order_index >= 60").agg(F.min("file_id").alias("file_id"))
    wanted = (F.col("status") == "translated") & (F.coalesce(F.size("qa_flags"), F.lit(0)) == 0) & F.contains(F.lower("source_text"), F.lit("1"))
    s = seg(spark, d, "file_id", "order_index", "status", "source_text", "qa_flags").join(F.broadcast(top), "file_id").where(wanted)
    total = s.groupBy("file_id").agg(F.count(F.lit(1)).alias("total"))  # one row
    return s.orderBy("order_index", "id").offset(1).limit(50).join(F.broadcast(total), "file_id").select("id", "order_index", "total")


@query(f"SELECT origin_project_id AS project_id, count(*) + (SELECT count(*) FROM {MEM} WHERE origin_project_id IS NULL) AS entries FROM {MEM} WHERE origin_project_id IS NOT NULL GROUP BY ALL")
def memory_scope(spark, d):
    """Entries each project sees: its own and those of no project."""
    m = mem(spark, d, "origin_project_id").groupBy(F.col("origin_project_id").alias("project_id")).agg(F.count(F.lit(1)).alias("n"))
    shared = m.where("project_id IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shared")).withColumn("one", F.lit(1))
    own = m.where("project_id IS NOT NULL").withColumn("one", F.lit(1))
    return own.join(F.broadcast(shared), "one").select("project_id", (F.col("n") + F.col("shared")).alias("entries"))


@query(
    f"""SELECT source_term, target_term, domain FROM (SELECT source_term, target_term, domain, min(g) AS g FROM (SELECT {visible('source_text')} AS source_term, {visible('target_text')} AS target_term, domain,
origin_project_id IS NULL AS g FROM {MEM}) WHERE domain = 'legal' AND length(source_term) <= 60 GROUP BY ALL) ORDER BY g DESC, length(source_term) DESC, source_term, target_term LIMIT 300"""
)
def glossary_listing(spark, d):
    """Short entries of a domain as a glossary: those of all projects first, then the longest."""
    m = mem(spark, d, "source_text", "target_text", "domain", "origin_project_id").where(F.col("domain") == "legal")
    t = m.select(T.visible("source_text").alias("source_term"), T.visible("target_text").alias("target_term"), "domain", F.col("origin_project_id").isNull().alias("general")).where(F.length("source_term") <= 60)
    listed = t.groupBy("source_term", "target_term", "domain").agg(F.min("general").alias("general"))
    return listed.orderBy(F.desc("general"), F.length("source_term").desc(), "source_term", "target_term").limit(300).select("source_term", "target_term", "domain")


@query(f"SELECT id, array_to_string(list_filter(qa_flags, lambda f: regexp_matches(f, '^(too|wrong)_')), '|') AS flags FROM {SEG} WHERE len(list_filter(coalesce(qa_flags, []), lambda f: regexp_matches(f, '^(too|wrong)_'))) > 0")
def flags_by_prefix(spark, d):
    kept = F.filter("qa_flags", lambda f: f.rlike("^(too|wrong)_"))
    return seg(spark, d, "qa_flags").where(F.size(kept) > 0).select("id", F.array_join(kept, "|").alias("flags"))


@query(
    f"""SELECT s.id, CASE WHEN NOT {translatable('source_text')} THEN 'approved' WHEN m.t IS NOT NULL THEN 'translated' ELSE 'draft' END AS status,
CASE WHEN NOT {translatable('source_text')} THEN source_text ELSE m.t END AS target_text, CASE WHEN NOT {translatable('source_text')} THEN 'source' WHEN m.t IS NOT NULL THEN 'tm_exact' END AS origin,
NOT {translatable('source_text')} AS is_locked FROM {SEG} s LEFT JOIN (SELECT source_hash, arg_min(target_text, id) AS t FROM {MEM} WHERE source_hash IS NOT NULL AND target_text IS NOT NULL GROUP BY 1) m USING (source_hash)"""
)
def segments_as_inserted(spark, d):
    best = mem(spark, d, "source_hash", "target_text").where("source_hash IS NOT NULL AND target_text IS NOT NULL").groupBy("source_hash").agg(F.min_by("target_text", "id").alias("memory_text"))
    s = seg(spark, d, "source_text", "source_hash")
    return upkeep.derived(s, s.join(best, "source_hash").select("id", "memory_text"))


@query(f"SELECT source_term, target_term FROM ({TERMS_SQL}) WHERE frequency <= 2 AND source_term NOT IN (SELECT source_term FROM ({TERMS_SQL}) WHERE frequency > 2)")
def terms_to_import(spark, d):
    t = term_pairs(spark, d)
    return upkeep.without(t.where("frequency <= 2"), t.where("frequency > 2"), "source_term").select("source_term", "target_term")


@query(f"SELECT id, source_length AS old_length, coalesce(length({visible('source_text')}), 0)::INT AS source_length FROM {MEM} WHERE source_length IS DISTINCT FROM coalesce(length({visible('source_text')}), 0)")
def memory_reindex(spark, d):
    return upkeep.reindexed(mem(spark, d, "source_text", "source_length"))


@query(f"SELECT file_id, count(*) AS segments FROM {SEG} WHERE file_id NOT IN (SELECT id FROM {FILES} WHERE project_id IN (SELECT min(project_id) FROM source_files)) GROUP BY file_id")
def segments_after_delete(spark, d):
    """Segments a file keeps once the first project is deleted with its files and their segments."""
    f = source_files(spark, d, "project_id")
    first = f.agg(F.min("project_id").alias("project_id"))
    gone = f.join(F.broadcast(first), "project_id").select(F.col("id").alias("file_id"))
    return upkeep.without(seg(spark, d, "file_id"), gone, "file_id").groupBy("file_id").agg(F.count(F.lit(1)).alias("segments"))


EDITS = f"(SELECT file_id, source_hash, max({{'u': updated_at, 'i': id, 't': target_text}}) AS e FROM {SEG} WHERE edited_by_human AND source_hash IS NOT NULL AND target_text IS NOT NULL GROUP BY ALL)"
SIBLINGS = f"SELECT s.id, e.t AS proposal FROM {SEG} s JOIN {EDITS} USING (file_id, source_hash) WHERE NOT edited_by_human AND s.target_text IS DISTINCT FROM e.t"


@query(SIBLINGS)
def edit_proposals(spark, d):
    return upkeep.sibling_proposals(seg(spark, d, "file_id", "source_hash", "target_text", "edited_by_human", "updated_at"))


RENAMED = f"SELECT id, regexp_replace(target_text, '(?i)\\binvoice\\b', 'bill', 'g') AS proposal FROM {SEG} WHERE regexp_matches(target_text, '(?i)\\binvoice\\b')"


@query(f"SELECT s.id, s.target_text AS old_text, proposal AS target_text, CASE WHEN status = 'draft' THEN 'translated' ELSE status END AS status FROM {SEG} s JOIN ({RENAMED}) p USING (id) WHERE NOT coalesce(is_locked, false) AND proposal IS DISTINCT FROM s.target_text")
def proposals_applied(spark, d):
    from weft.operators import terms

    s = seg(spark, d, "target_text", "status", "is_locked")
    proposals = s.where(F.col("target_text").rlike(terms.whole_word("invoice"))).select("id", terms.replace_term(F.col("target_text"), "invoice", "bill").alias("proposal"))
    return upkeep.apply_proposals(s, proposals)


@query(f"SELECT id, NOT coalesce(origin IN ('echo', 'source'), false) AND NOT starts_with(target_text, '[EN] ') AS remembered FROM {SEG} WHERE status IN ('translated', 'reviewed') AND {collapse("coalesce(target_text, '')")} <> ''")
def approve_all(spark, d):
    return upkeep.approved(seg(spark, d, "status", "origin", "target_text"))


@query(rf"SELECT id, array_to_string(regexp_extract_all({visible('source_text')}, '(\p{{Nd}}+\.\p{{Nd}}{{3}})(?:[^\p{{Nd}}]|$)', 1)[1:3], ',') AS numbers FROM {SEG} WHERE regexp_matches({visible('source_text')}, '\p{{Nd}}+\.\p{{Nd}}{{3}}(?:[^\p{{Nd}}]|$)')")
def ambiguous_separators(spark, d):
    n = T.ambiguous_numbers(T.visible("source_text"))
    return seg(spark, d, "source_text").where(F.size(n) > 0).select("id", F.array_join(n, ",").alias("numbers"))


@query(
    f"""SELECT span_id, max(n)::INT AS longest_run FROM (SELECT span_id, g, h, count(*) AS n FROM (SELECT span_id, p - i AS g, i - row_number() OVER (PARTITION BY span_id, p - i ORDER BY i) AS h
FROM (SELECT span_id, unicode(unnest(l)) AS p, generate_subscripts(l, 1) AS i FROM (SELECT span_id, string_split(regexp_replace(text, '[\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{3000}}]', '', 'g'), '') AS l
FROM {SPAN} WHERE text IS NOT NULL))) GROUP BY ALL) GROUP BY span_id HAVING max(n) >= 3"""
)
def code_point_runs(spark, d):
    run = upkeep.longest_run(F.col("text"))
    return spans(spark, d, "text").select("span_id", run.alias("longest_run")).where("longest_run >= 3")


@query(f"SELECT file_id, sum({words('source_text')})::BIGINT AS words, greatest(1, round_even(sum({words('source_text')}) / 250.0, 0)::INT) AS pages FROM {SEG} GROUP BY file_id")
def pages_by_words(spark, d):
    w = seg(spark, d, "file_id", "source_text").groupBy("file_id").agg(F.sum(T.count_words("source_text")).alias("words"))
    return w.select("file_id", "words", upkeep.pages_from_words(F.col("words")).alias("pages"))


@query(f"SELECT id, (size_bytes + 2) // 3 * 4 AS encoded_bytes FROM {FILES} WHERE size_bytes IS NOT NULL")
def encoded_sizes(spark, d):
    return source_files(spark, d, "size_bytes").where("size_bytes IS NOT NULL").select("id", upkeep.encoded_bytes(F.col("size_bytes")).alias("encoded_bytes"))


LISTED = ", ".join(f"'{x}'" for x in sorted(FORMATS))


@query(f"SELECT id, lower(regexp_extract(original_filename, '(\\.[^./]+)$', 1)) AS extension, lower(regexp_extract(original_filename, '(\\.[^./]+)$', 1)) IN ({LISTED}) AS supported FROM {FILES} WHERE original_filename IS NOT NULL")
def supported_files(spark, d):
    extension = F.lower(F.regexp_extract("original_filename", r"(\.[^./]+)$", 1))
    return source_files(spark, d, "original_filename").where("original_filename IS NOT NULL").select("id", extension.alias("extension"), extension.isin(*FORMATS).alias("supported"))


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_concat(coalesce(qa_flags, []), CASE WHEN {collapse("coalesce(target_text, '')")} = '' THEN ['empty'] ELSE [] END))), '|') AS flags FROM {SEG}")
def flags_united(spark, d):
    blank = F.coalesce(T.collapse("target_text"), F.lit("")) == ""
    none = F.array().cast("array<string>")
    united = F.array_union(F.coalesce("qa_flags", none), F.when(blank, F.array(F.lit("empty"))).otherwise(none))
    return seg(spark, d, "qa_flags", "target_text").select("id", F.array_join(F.array_sort(united), "|").alias("flags"))


@query("SELECT verse_key, chapter || ':' || greatest(1, verse - 2) AS first_key, chapter || ':' || (verse + 2) AS last_key, len(range(greatest(1, verse - 2), verse + 3))::INT AS keys FROM verse_catalogue")
def verse_windows(spark, d):
    v = table(spark, d, "verse_catalogue").select("verse_key", F.sequence(F.greatest(F.lit(1), F.col("verse") - 2), F.col("verse") + 2).alias("n"), "chapter")
    key = lambda n: F.concat_ws(":", "chapter", n)
    return v.select("verse_key", key(F.element_at("n", 1)).alias("first_key"), key(F.element_at("n", -1)).alias("last_key"), F.size("n").alias("keys"))


@query("SELECT file_id, page, string_agg(text, chr(10) ORDER BY order_index, unit_id) AS text FROM (SELECT DISTINCT ON (unit_id) *, coalesce(TRY_CAST(map_extract(meta, 'page')[1] AS INT), 1) AS page FROM text_units) WHERE trim(coalesce(text, '')) <> '' GROUP BY file_id, page")
def texts_by_page(spark, d):
    """Texts of every page of a file in order; units without page stand on the first."""
    u = first_delivery(table(spark, d, "text_units").select("unit_id", "file_id", "text", "order_index", F.coalesce(F.expr("try_cast(meta['page'] AS INT)"), F.lit(1)).alias("page")), "unit_id")
    parts = F.array_sort(F.collect_list(F.struct("order_index", "unit_id", "text")))
    return u.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("file_id", "page").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))

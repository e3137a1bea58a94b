"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm import alignment, encoding, leaks, lookalike, mixing, packing, pairs, quality, scanned, sentences
from weft.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned.found(table(spark, d, "ocr_blocks"))


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scanned.paragraphs(table(spark, d, "ocr_blocks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "segments"), table(spark, d, "batch_results"), table(spark, d, "tm_entries"))


def p2_missing(spark: SparkSession, d: str) -> DataFrame:
    return pairs.missing(table(spark, d, "batch_results"), p2_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align(table(spark, d, "alignments"), table(spark, d, "tm_entries"), table(spark, d, "segments"), table(spark, d, "batch_results"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return alignment.counts(table(spark, d, "alignments"), p3_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.found(table(spark, d, "text_spans"))


def p4_pages(spark: SparkSession, d: str) -> DataFrame:
    return encoding.pages(encoding.restore(table(spark, d, "text_spans")), table(spark, d, "source_files"))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore(table(spark, d, "text_spans")).where("affected").select("span_id", "restored", "complete")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.found(table(spark, d, "text_units"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found(table(spark, d, "segments"), table(spark, d, "tm_entries"), table(spark, d, "verse_catalogue"))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.groups(table(spark, d, "tm_entries"))


def p7_batches(spark: SparkSession, d: str) -> DataFrame:
    return packing.batches(table(spark, d, "segments"), table(spark, d, "batch_settings"))


def p7_use(spark: SparkSession, d: str) -> DataFrame:
    settings = table(spark, d, "batch_settings")
    return packing.use_of_budget(packing.batches(table(spark, d, "segments"), settings), settings)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    counts, targets = cut(mixing.token_counts(table(spark, d, "documents"))), table(spark, d, "mix_targets")
    return mixing.shares_reached(mixing.records(counts, targets), counts, targets)


def p9_records(spark: SparkSession, d: str) -> DataFrame:
    return mixing.records(cut(mixing.token_counts(table(spark, d, "documents"))), table(spark, d, "mix_targets")).drop("bound")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.found(table(spark, d, "documents"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.percentiles(cut(quality.statistics(table(spark, d, "documents"))))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_paragraphs, p2_found, p2_missing, p3_found, p3_counts, p4_found, p4_pages, p4_restored, p5_found, p6_found, p6_forms, p7_batches, p7_use, p8_found, p8_report, p9_records, p9_mix, p10_found, p10_statistics)}
SQL: dict[str, str] = {}

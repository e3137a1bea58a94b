"""Plain text files: decoding, line units, write-back; term tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import text as T

# Formats by extension, encodings tried in turn, names that mark a header row, limits of a term table.
FORMATS = {".txt": "plain", ".md": "plain", ".csv": "plain", ".docx": "docx", ".xlsx": "xlsx", ".pptx": "pptx", ".pdf": "pdf"}
ENCODINGS = ("utf-8-sig", "utf-8", "cp1256", "latin-1")
HEADERS = frozenset("source target term translation src tgt source_term target_term english arabic المصدر الهدف المصطلح الترجمة".split())
LONGEST_TERM, MOST_TERMS = 120, 5000


def file_format(path) -> F.Column:
    """Format of a path by its extension, null for others."""
    return T.lookup(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), FORMATS)


def decode(data: bytes | None) -> str | None:
    """Text of a file under the first encoding that fits; null stays null."""
    if data is None:
        return None
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def read_files(spark: SparkSession, path: str, most_bytes: int = 200 * 1024 * 1024) -> DataFrame:
    """(path, fmt, size_bytes, sha256, content) of the files under a path; larger ones are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.where(F.col("length") <= most_bytes).select("path", file_format(F.col("path")).alias("fmt"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def plain_units(files: DataFrame) -> DataFrame:
    """(path, unit_key, line_no, text, ending) of all lines of plain files, blank ones too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                for no, line in enumerate((decode(content) or "").splitlines(keepends=True)):
                    body = line.splitlines()[0] if line.splitlines() else ""
                    rows.append((path, f"plain:line:{no:06d}", no, body, line[len(body) :]))
            yield pd.DataFrame(rows, columns=["path", "unit_key", "line_no", "text", "ending"]).astype({"line_no": "int32"})

    return files.where("fmt = 'plain'").select("path", "content").mapInPandas(run, "path string, unit_key string, line_no int, text string, ending string")


def rebuilt(units: DataFrame, translations: DataFrame) -> DataFrame:
    """(path, text): plain files with translated lines put back; ``translations(path, unit_key, target)``; other lines stay."""
    joined = units.join(translations, ["path", "unit_key"], "left")
    piece = F.concat(F.coalesce("target", "text"), "ending")
    parts = F.array_sort(F.collect_list(F.struct("line_no", piece.alias("p"))))
    return joined.groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x["p"]), "").alias("text"))


def term_rows(data: bytes) -> list[tuple[int, str, str, str | None]]:
    """(line, source, target, note) of a delimited table: delimiter by count, header left out."""
    text = decode(data) or ""
    first = next((x for x in text.splitlines() if x.strip()), "")
    mark = max(",;\t", key=first.count)
    out = []
    for no, row in enumerate(csv.reader(io.StringIO(text), delimiter=mark)):
        cells = [c.strip() for c in row]
        if no == 0 and HEADERS & {c.lower() for c in cells}:
            continue
        if len(cells) >= 2:
            out.append((no, cells[0], cells[1], cells[2] if len(cells) > 2 and cells[2] else None))
    return out


def term_table(files: DataFrame) -> DataFrame:
    """(path, source_term, target_term, note): rows with both sides, neither over the limit, each pair once, the first MOST_TERMS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r) for p, c in zip(pdf["path"], pdf["content"]) for r in term_rows(c)]
            yield pd.DataFrame(rows, columns=["path", "line", "source_term", "target_term", "note"]).astype({"line": "int32"})

    rows = files.select("path", "content").mapInPandas(run, "path string, line int, source_term string, target_term string, note string")
    good = rows.where((F.col("source_term") != "") & (F.col("target_term") != "") & (F.length("source_term") <= LONGEST_TERM) & (F.length("target_term") <= LONGEST_TERM))
    once = good.groupBy("path", "source_term", "target_term").agg(F.min(F.struct("line", "note")).alias("r"))
    w = Window.partitionBy("path").orderBy("r.line")
    return once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MOST_TERMS).select("path", "source_term", "target_term", F.col("r.note").alias("note"))

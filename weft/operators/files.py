"""Files in pieces: order, batches, context, reassembly, siblings, diagnosis, geometry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions.segment import split_udf

#: What splits a text into lines, and the sizes of batch and context.
LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
BUDGET, MOST, CONTEXT = 6000, 40, 220


def line_units(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, unit_no, text): the non-blank lines with their number in the text."""
    lines = docs.select(key, F.posexplode(F.split("text", LINES)).alias("unit_no", "text"))
    return lines.where(F.coalesce(T.collapse("text"), F.lit("")) != "")


def sentences(units: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Sentences of units: key columns, unit_order, sentence, trailing; blank pieces are left out but counted in unit_order."""
    cut = units.select(*key, F.posexplode(split_udf(F.col(text))).alias("unit_order", "s"))
    return cut.select(*key, "unit_order", F.col("s.text").alias("sentence"), F.col("s.trailing").alias("trailing")).where(T.collapse("sentence") != "")


def numbered(segments: DataFrame) -> DataFrame:
    """Running number of each segment in its file and place in its unit."""
    whole = Window.partitionBy("file_id").orderBy("order_index", "id")
    unit = Window.partitionBy("file_id", "unit_key").orderBy("unit_order", "id")
    return segments.select("id", (F.row_number().over(whole) - 1).alias("file_place"), (F.row_number().over(unit) - 1).alias("unit_place"))


def greedy_batches(segments: DataFrame, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """(file_id, id, batch_no): segments of each file in order, a batch closed before it passes the budget or holds ``most``.

    The fold resets at every batch, so it runs by file; only ids and lengths travel, 40 bytes a segment.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order_index", "id"])
        no, used, count, out = 0, 0, 0, []
        for n in pdf["size"]:
            if count and (used + n > budget or count >= most):
                no, used, count = no + 1, 0, 0
            used += n
            count += 1
            out.append(no)
        return pd.DataFrame({"file_id": pdf["file_id"], "id": pdf["id"], "batch_no": pd.Series(out, dtype="int32", index=pdf.index)})

    slim = segments.select("file_id", "id", "order_index", F.coalesce(F.length("source_text"), F.lit(0)).alias("size"))
    return slim.groupBy("file_id").applyInPandas(run, "file_id string, id string, batch_no int")


def context(segments: DataFrame, size: int = CONTEXT) -> DataFrame:
    """(id, before, after): the text around each segment in its file, cut to ``size`` characters."""
    w = Window.partitionBy("file_id").orderBy("order_index", "id")
    plain = F.coalesce(T.strip_tags("source_text"), F.lit(""))
    # no more than ``size`` characters of a neighbour can count, so no more are kept for the window
    near = F.concat_ws(" ", F.collect_list("__end").over(w.rowsBetween(-size - 1, -1)))
    far = F.concat_ws(" ", F.collect_list("__start").over(w.rowsBetween(1, size + 1)))
    slim = segments.select("id", "file_id", "order_index", F.right(plain, F.lit(size)).alias("__end"), F.left(plain, F.lit(size)).alias("__start"))
    return slim.select("id", F.right(near, F.lit(size)).alias("before"), F.left(far, F.lit(size)).alias("after"))


def assembled(segments: DataFrame) -> DataFrame:
    """(file_id, unit_key, text): the pieces of every unit in order, each with the white space after it; untranslated ones in the source."""
    piece = F.concat(F.when(F.coalesce(T.collapse("target_text"), F.lit("")) != "", F.col("target_text")).otherwise(F.coalesce("source_text", F.lit(""))), F.coalesce("trailing_ws", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("unit_order", "id", piece.alias("p"))))
    return segments.groupBy("file_id", "unit_key").agg(F.array_join(F.transform(parts, lambda x: x["p"]), "").alias("text"))


def siblings(segments: DataFrame) -> DataFrame:
    """(id, siblings): how many other segments of the file have the same source hash; segments alone are left out."""
    n = segments.where(F.col("source_hash").isNotNull()).groupBy("file_id", "source_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return segments.join(n, ["file_id", "source_hash"]).select("id", (F.col("n") - 1).alias("siblings"))


def page_boxes(spans: DataFrame) -> DataFrame:
    """(file_id, page, lines, x0, y0, x1, y1, font): bounding box and widest-used font of every page."""
    return spans.groupBy("file_id", "page").agg(
        F.count(F.lit(1)).alias("lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max_by("font", F.struct(F.col("x1") - F.col("x0"), -F.col("order_no"))).alias("font"),
    )


def reading_order(spans: DataFrame, row: float = 12.0) -> DataFrame:
    """Place of every span on its page: rows of about ``row`` points, then from the left."""
    w = Window.partitionBy("file_id", "page").orderBy(F.bround(F.col("y0") / row), "x0", "span_id")
    return spans.select("span_id", F.row_number().over(w).alias("place"))


def merge_lines(spans: DataFrame, gap: float = 0.8, overlap: float = 0.25) -> DataFrame:
    """(file_id, page, block_no, span_id): lines of a page put together to blocks.

    A line joins the block before it where the space between is at most ``gap`` of the median height and
    it overlaps the width of the block as grown so far by ``overlap`` of the narrower.  Pages are bounded,
    so one page is one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y0", "x0", "span_id"])
        heights = sorted(pdf["y1"] - pdf["y0"])
        middle = heights[len(heights) // 2]
        no, out, box = -1, [], None
        for x0, y0, x1, y1 in zip(pdf["x0"], pdf["y0"], pdf["x1"], pdf["y1"]):
            joins = False
            if box is not None:
                shared = min(box[2], x1) - max(box[0], x0)
                joins = y0 - box[3] <= gap * middle and shared >= overlap * max(1e-9, min(box[2] - box[0], x1 - x0))
            if joins:
                box = [min(box[0], x0), min(box[1], y0), max(box[2], x1), max(box[3], y1)]
            else:
                no += 1
                box = [x0, y0, x1, y1]
            out.append(no)
        return pd.DataFrame({"file_id": pdf["file_id"], "page": pdf["page"], "block_no": pd.Series(out, dtype="int32", index=pdf.index), "span_id": pdf["span_id"]})

    return spans.select("file_id", "page", "span_id", "x0", "y0", "x1", "y1").dropna().groupBy("file_id", "page").applyInPandas(run, "file_id string, page int, block_no int, span_id long")


def page_quality(spans: DataFrame) -> DataFrame:
    """(file_id, page, chars, private_chars, unreliable): pages whose text is mostly private characters of symbol fonts."""
    private = F.length(F.regexp_replace("text", r"[^\x{E000}-\x{F8FF}]", ""))
    g = spans.groupBy("file_id", "page").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.sum(F.coalesce(private, F.lit(0))).alias("private_chars"))
    return g.withColumn("unreliable", (F.col("chars") >= 40) & (F.col("private_chars") >= 0.1 * F.col("chars")))


def changes(events: DataFrame, key: str, order: list[str], payload: str) -> DataFrame:
    """Events that differ from the one before them of the same key: what a change feed emits."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("__before", F.lag(payload).over(w)).where(~F.col(payload).eqNullSafe(F.col("__before")) | F.col("__before").isNull()).drop("__before")


def payloads(segments: DataFrame, batches: DataFrame) -> DataFrame:
    """(file_id, batch_no, payload): what each batch sends, a JSON list of id and text in order; a batch holds MOST segments at most."""
    row = F.struct("order_index", "id", F.coalesce("source_text", F.lit("")).alias("text"))
    joined = segments.join(batches.select("id", "batch_no"), "id")
    return joined.groupBy("file_id", "batch_no").agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text")))).alias("payload"))


def drift(layout: DataFrame, units: DataFrame, prefix: int = 40) -> DataFrame:
    """(file_id, units, differing, drift): share of a file's units whose beginning differs from the layout entry of the same place.

    Both sides have file_id, place and text; units without an entry count as different.
    """
    a = layout.select("file_id", "place", T.collapse("text").alias("a"))
    b = units.select("file_id", "place", T.collapse("text").alias("b"))
    n = F.least(F.length("a"), F.length("b"), F.lit(prefix))
    differs = F.coalesce(F.left("a", n) != F.left("b", n), F.lit(True))
    return b.join(a, ["file_id", "place"], "left").groupBy("file_id").agg(F.count(F.lit(1)).alias("units"), F.count_if(differs).alias("differing"), F.round(F.avg(differs.cast("int")), 4).alias("drift"))


def boxes_for_texts(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, page, text_no, x0, y0, x1, y1): where each text of a page goes when there are fewer texts than boxes.

    Text i of m takes the union of boxes round(i * n / m) to round((i + 1) * n / m) of the n, rounded half to
    even, the last box where that is empty.  ``boxes`` has box_no, ``texts`` text_no, both from 0 per page.
    """
    key = ["file_id", "page"]
    n = boxes.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    m = texts.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    t = texts.select(*key, "text_no").join(n, key).join(m, key)
    first = F.bround(F.col("text_no") * F.col("n") / F.col("m")).cast("int")
    last = F.bround((F.col("text_no") + 1) * F.col("n") / F.col("m")).cast("int") - 1
    ranged = t.select(*key, "text_no", F.least(first, F.col("n") - 1).alias("a"), F.greatest(last, F.least(first, F.col("n") - 1)).alias("b"))
    each = ranged.select(*key, "text_no", F.explode(F.sequence("a", "b")).alias("box_no")).withColumn("box_no", F.col("box_no").cast("int"))
    return each.join(boxes, [*key, "box_no"]).groupBy(*key, "text_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))

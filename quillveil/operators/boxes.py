"""Spans met with word boxes of laid-out documents.

Reading and rewriting page files needs a page library, which is optional; the arithmetic of offsets
and rectangles is here and needs none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How far a rectangle keeps from its box's edges, at most a quarter of its size.
INSET_X, INSET_Y = 0.5, 2.0
WORD_GAP, PAGE_GAP = 1, 2


def word_ranges(words: DataFrame) -> DataFrame:
    """doc_id, page, pos, word (+ any) -> start, end in the text of words joined by spaces, pages by blank lines.

    Pages that hold no word still add their gap through ``page`` numbers.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    gap = F.when(F.col("page") != F.lag("page").over(order), PAGE_GAP * (F.col("page") - F.lag("page").over(order))).when(F.lag("page").over(order).isNull(), PAGE_GAP * F.col("page")).otherwise(WORD_GAP)
    length = F.char_length("word")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return words.withColumn("_step", gap + length).withColumn("end", F.sum("_step").over(upto).cast("int")).withColumn("start", (F.col("end") - length).cast("int")).drop("_step")


def span_rectangles(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every box a span meets, with the inset rectangle: doc_id, start, end, entity_type, page, x0, y0, x1, y1.

    An equi-join on the document with the overlap as its further condition.
    """
    s, b = spans.alias("s"), boxes.alias("b")
    dx = F.least(F.lit(INSET_X), (F.col("b.x1") - F.col("b.x0")) / 4)
    dy = F.least(F.lit(INSET_Y), (F.col("b.y1") - F.col("b.y0")) / 4)
    on = (F.col("s.doc_id") == F.col("b.doc_id")) & (F.col("s.start") < F.col("b.end")) & (F.col("b.start") < F.col("s.end"))
    return s.join(b, on).select(
        "s.doc_id", "s.start", "s.end", "s.entity_type", "b.page",
        (F.col("b.x0") + dx).alias("x0"), (F.col("b.y0") + dy).alias("y0"), (F.col("b.x1") - dx).alias("x1"), (F.col("b.y1") - dy).alias("y1"),
    )


def span_pages(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each span with the page of the first box it meets, or null."""
    s, b = spans.alias("s"), boxes.alias("b")
    on = (F.col("s.doc_id") == F.col("b.doc_id")) & (F.col("s.start") < F.col("b.end")) & (F.col("b.start") < F.col("s.end"))
    return s.join(b, on, "left").groupBy("s.doc_id", "s.start", "s.end", "s.entity_type").agg(F.min_by("b.page", "b.start").alias("page"))


def unplaced(spans: DataFrame, boxes: DataFrame, public: tuple[str, ...]) -> DataFrame:
    """Spans to hide that meet no box; writing a copy in spite of one would leak it."""
    s, b = spans.filter(~F.col("entity_type").isin(*public)).alias("s"), boxes.alias("b")
    on = (F.col("s.doc_id") == F.col("b.doc_id")) & (F.col("s.start") < F.col("b.end")) & (F.col("b.start") < F.col("s.end"))
    return s.join(b, on, "left_anti")


def require_placed(spans: DataFrame, boxes: DataFrame, public: tuple[str, ...]) -> DataFrame:
    """The rectangles; fails where a span to hide has none."""
    lost = unplaced(spans, boxes, public).agg(F.count(F.lit(1)).alias("n"))
    checked = lost.select(F.assert_true(F.col("n") == 0, F.concat(F.col("n").cast("string"), F.lit(" spans cannot be located on any page"))))
    checked.collect()  # one row
    return span_rectangles(spans.filter(~F.col("entity_type").isin(*public)), boxes)

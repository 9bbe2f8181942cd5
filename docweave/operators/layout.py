"""Text of pages in two columns, from the boxes of a layout analysis.

A box that is wide and crosses the middle of its page spans both columns; any other belongs to the column its centre is in. Reading goes from the top: before each
spanning box come the boxes of the left and then of the right column that begin above it, at the end what is left of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as T

#: Share of the page's width from which a box counts as spanning (fixed value).
SPANNING = 0.65


def column_of(x0: Column, x1: Column, width: Column) -> Column:
    """span, left or right."""
    middle = width / 2
    span = (x1 - x0 > width * SPANNING) & (x0 < middle) & (middle < x1)
    return F.when(span, "span").when((x0 + x1) / 2 < middle, "left").otherwise("right")


def page_order(boxes: DataFrame, doc: str = "doc_id", page: str = "page", order: str = "ord") -> DataFrame:
    """boxes with `kind` (see column_of()) and `place`, the position of each on its page from 1 in reading order.

    boxes: doc, page, order (the order of the analysis, for equals), x0, x1, y1 (top, upwards), page_width. The merge of the three sorted runs needs no loop: a box
    in a column follows as many spanning boxes as are at its height or above it, so that this number, the column and the height are its key.
    """
    kind = column_of(F.col("x0"), F.col("x1"), F.col("page_width"))
    by = Window.partitionBy(doc, page)
    span = (F.col("kind") == "span").cast("int")
    above = F.sum(span).over(by.orderBy(F.desc("y1")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    number = F.sum(span).over(by.orderBy(F.desc("y1"), order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slot = F.when(F.col("kind") == "span", F.col("__number") - 1).otherwise(F.col("__above"))
    side = F.when(F.col("kind") == "left", 0).when(F.col("kind") == "right", 1).otherwise(2)
    # the order of the first window serves the second
    counted = boxes.withColumn("kind", kind).withColumn("__number", number).withColumn("__above", above)
    keyed = counted.withColumn("__slot", slot).drop("__number", "__above").withColumn("__side", side)
    return keyed.withColumn("place", F.row_number().over(by.orderBy("__slot", "__side", F.desc("y1"), order))).drop("__slot", "__side")


def page_texts(boxes: DataFrame, doc: str = "doc_id", page: str = "page", order: str = "ord", text: str = "text") -> DataFrame:
    """doc, page and text: the stripped texts of a page's boxes in reading order, one a line. A page without boxes has no row."""
    placed = page_order(boxes, doc, page, order).groupBy(doc, page).agg(F.sort_array(F.collect_list(F.struct("place", T.strip(F.coalesce(F.col(text), F.lit(""))).alias("t")))).alias("rows"))
    return placed.select(doc, page, F.array_join(F.transform("rows", lambda r: r["t"]), "\n").alias("text"))


def document_texts(boxes: DataFrame, doc: str = "doc_id", page: str = "page", order: str = "ord", text: str = "text") -> DataFrame:
    """doc and text: the pages of each document in order, a blank line between them."""
    pages = page_texts(boxes, doc, page, order, text).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(page, "text"))).alias("pages"))
    return pages.select(doc, F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n").alias("text"))

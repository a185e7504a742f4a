"""Reading order and running margins of page blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .filters import page_number_block

#: Share of the page width by which a block must pass the middle on both sides, or which it must fill, to be full width.
MIDDLE, FULL = 0.07, 0.72
TOP, BOTTOM = 0.15, 0.90
MARGIN_SHARE, MARGIN_PAGES, MARGIN_CHARS = 0.30, 2, 180
PAGE = ("source_id", "page")


def is_margin(y0="y0", y1="y1", height="page_height") -> Column:
    return (F.col(y1) <= TOP * F.col(height)) | (F.col(y0) >= BOTTOM * F.col(height))


def repeated_margins(blocks: DataFrame) -> DataFrame:
    """(source_id, signature): margin lines found on at least two pages and 30 % of a source's pages."""
    pages = blocks.groupBy("source_id").agg(F.countDistinct("page").alias("pages"))
    s = blocks.where(is_margin()).select("source_id", "page", X.margin_signature("text").alias("signature")).where((F.length("signature") > 0) & (F.length("signature") <= MARGIN_CHARS))
    on = s.groupBy("source_id", "signature").agg(F.countDistinct("page").alias("on"))
    return on.join(pages, "source_id").where(F.col("on") >= F.greatest(F.lit(MARGIN_PAGES), F.ceil(F.col("pages") * F.lit(30) / F.lit(100)))).select("source_id", "signature")


def drop_margins(blocks: DataFrame) -> DataFrame:
    """Blocks without repeated margins and without those that are nothing but a number, wherever they stand."""
    marked = blocks.withColumn("signature", F.when(is_margin(), X.margin_signature("text")))
    kept = marked.join(repeated_margins(blocks), ["source_id", "signature"], "left_anti").drop("signature")
    return kept.where(~page_number_block("text"))


def single_column_order(blocks: DataFrame) -> DataFrame:
    """Blocks with ``position`` on their page: by top, left and number."""
    w = Window.partitionBy(*PAGE).orderBy(F.bround("y0", 1), F.bround("x0", 1), "block_no")
    return blocks.withColumn("position", F.row_number().over(w))


def two_column_order(blocks: DataFrame) -> DataFrame:
    """Blocks with ``position`` on their page: full-width blocks divide it into zones; in each, left column, then right.

    A column block belongs to the first zone whose lower full-width block starts
    below its centre and whose upper edge, the lowest bottom of the full-width
    blocks above, is not below it; what belongs to none comes last.
    """
    mid, width = F.col("page_width") / 2, F.col("x1") - F.col("x0")
    full = ((F.col("x0") < mid - MIDDLE * F.col("page_width")) & (F.col("x1") > mid + MIDDLE * F.col("page_width"))) | (width >= FULL * F.col("page_width"))
    x = blocks.withColumn("_full", full)
    order = Window.partitionBy(*PAGE).orderBy(F.bround("y0", 1), F.bround("x0", 1), "block_no")
    bars = x.where("_full").withColumn("zone", F.row_number().over(order)).withColumn("top", F.coalesce(F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("-inf"))))
    last = bars.groupBy(*PAGE).agg((F.max("zone") + 1).alias("zone"), F.max("y1").alias("top")).withColumn("bottom", F.lit(float("inf")))
    zones = bars.select(*PAGE, "zone", "top", F.col("y0").alias("bottom")).unionByName(last)
    centre = (F.col("y0") + F.col("y1")) / 2
    columns = x.where(~F.col("_full")).withColumn("_cy", centre).withColumn("_right", ((F.col("x0") + F.col("x1")) / 2 >= mid).cast("int"))
    found = columns.join(zones, list(PAGE), "left").groupBy(*PAGE, "block_no").agg(
        F.min(F.when((F.col("top") <= F.col("_cy")) & (F.col("_cy") < F.col("bottom")), F.col("zone"))).alias("zone"), F.count("zone").alias("zones"))
    # Pages without full-width blocks are one zone; leftovers go behind everything.
    columns = columns.join(found, [*PAGE, "block_no"]).withColumn("zone", F.coalesce("zone", F.when(F.col("zones") == 0, F.lit(1)), F.lit(2**31 - 1)))
    both = columns.select(*blocks.columns, "zone", F.lit(0).alias("_bar"), "_right").unionByName(bars.select(*blocks.columns, "zone", F.lit(1).alias("_bar"), F.lit(0).alias("_right")))
    w = Window.partitionBy(*PAGE).orderBy("zone", "_bar", "_right", F.bround("y0", 1), F.bround("x0", 1), "block_no")
    return both.withColumn("position", F.row_number().over(w)).drop("zone", "_bar", "_right")


def assemble_pages(blocks: DataFrame, language: str = "language", strip_numbers: str = "strip_line_numbers") -> DataFrame:
    """(source_id, page, text, counts): blocks in order, each cleaned and unwrapped, a blank line between them."""
    cleaned = F.when(F.col(strip_numbers), X.strip_line_numbers("text")).otherwise(F.col("text"))
    x = blocks.withColumn("_t", X.join_wrapped_lines(cleaned, language)).where("_t <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "_t"))), lambda b: b["_t"]), "\n\n")
    out = x.groupBy(*PAGE).agg(text.alias("text"), F.count("*").alias("text_block_count"))
    return out.withColumn("text_character_count", F.length("text"))

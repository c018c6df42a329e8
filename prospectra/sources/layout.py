"""Page layout tables to text: printed tables, and blocks merged with the tables that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.functions.columns import strip

TABLE_KEY = ["doc_id", "page", "table_no"]


def render_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, row_no, col, text) to one text per printed table."""
    rows = (cells.groupBy(*TABLE_KEY, "row_no")
            .agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))).alias("c"))
            .select(*TABLE_KEY, "row_no", F.array_join("c.text", " | ").alias("line")))
    return (rows.groupBy(*TABLE_KEY).agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("r"))
            .select(*TABLE_KEY, F.concat(F.lit("[TABLE]\n"), F.array_join("r.line", "\n"), F.lit("\n[/TABLE]")).alias("text")))


def merge_page_blocks(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Page text in block order; blocks centred in a table give way to that table, once.

    blocks: doc_id, page, block_no, x0, y0, x1, y1, block_type, text. tables: doc_id, page,
    table_no, x0, y0, x1, y1, text. The boxes of a page travel to its blocks as one small
    array, so the point-in-box test is an equi-join on the page followed by a filter.
    """
    page = ["doc_id", "page"]
    boxes = tables.groupBy(*page).agg(F.array_sort(F.collect_list(
        F.struct("table_no", "x0", "y0", "x1", "y1"))).alias("boxes"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = F.get(F.filter("boxes", lambda b: (b["x0"] <= x) & (x < b["x1"]) & (b["y0"] <= y) & (y < b["y1"])), F.lit(0))
    held = (blocks.where("block_type = 0").join(boxes, page, "left")
            .select(*page, "block_no", "text", inside["table_no"].alias("table_no")))
    loose = held.where("table_no IS NULL").select(*page, F.struct(F.lit(0).alias("late"), F.col("block_no").cast("long").alias("at"), "text").alias("piece"))
    first = held.where("table_no IS NOT NULL").groupBy(*page, "table_no").agg(F.min("block_no").cast("long").alias("at"))
    placed = tables.join(first, [*page, "table_no"], "left").select(*page, F.struct(
        F.col("at").isNull().cast("int").alias("late"), F.coalesce("at", F.col("table_no").cast("long")).alias("at"),
        F.concat(F.lit("\n"), "text", F.lit("\n")).alias("text")).alias("piece"))
    return (loose.unionByName(placed).groupBy(*page)
            .agg(F.array_sort(F.collect_list("piece")).alias("p"))
            .select(*page, strip(F.array_join("p.text", "")).alias("text")))

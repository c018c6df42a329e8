"""Statement extraction from printed tables: periods, line items, units, and checks on the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import computed, exact_round, first_match, lit_array, lookup
from prospectra.functions.text import PERIOD_TYPE, looks_like_year, match_line_item, parse_periods, parse_value

TABLE = ["doc_id", "page", "table_no"]


def statement_of_page(pages: DataFrame) -> DataFrame:
    """Adds `statement`: named at the top of the page, else the one of the page before (pages of one section)."""
    top = F.substring("text", 1, V.STATEMENT_TITLE_CHARS)
    named = first_match([(top.rlike(pattern), name) for name, pattern in V.STATEMENTS.items()])
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("__n", named).withColumn("statement", F.last("__n", ignorenulls=True).over(before)).drop("__n")


def first_pages(pages_with_statement: DataFrame) -> DataFrame:
    """The page each statement starts on."""
    return (pages_with_statement.where("statement IS NOT NULL").groupBy("doc_id", "statement")
            .agg(F.min("page").alias("page")))


def gather_tables(cells: DataFrame) -> DataFrame:
    """One row per printed table: `rows`, an ordered rectangular array of arrays of cell texts."""
    text = F.trim(F.translate(F.coalesce("text", F.lit("")), "\n", " "))
    rows = cells.groupBy(*TABLE, "row_no").agg(F.collect_list(F.struct("col", text.alias("text"))).alias("c"), F.max("col").alias("last"))
    gathered = rows.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("row_no", "c"))).alias("r"), F.max("last").alias("last"))

    def at(row: Column, col: Column) -> Column:
        return F.coalesce(F.get(F.filter(row["c"], lambda x: x["col"] == col), F.lit(0))["text"], F.lit(""))

    return gathered.select(*TABLE, F.transform("r", lambda row: F.transform(
        F.sequence(F.lit(0), F.col("last")), lambda col: at(row, col))).alias("rows"))


def with_values(tables: DataFrame) -> DataFrame:
    """Replaces `rows` by structs (cells, values, label); label is the first non-empty cell that is not a number."""
    def read(cells: Column) -> Column:
        values = F.array_compact(F.transform(cells, parse_value))
        label = F.get(F.filter(cells, lambda c: (c != "") & parse_value(c).isNull()), F.lit(0))
        return F.struct(cells.alias("cells"), values.alias("values"), F.coalesce(label, F.lit("")).alias("label"))

    return computed(tables.withColumnRenamed("rows", "__rows"), rows=F.transform("__rows", read)).drop("__rows")


def with_header(tables: DataFrame) -> DataFrame:
    """Adds `header_rows`, the number of rows before the first with two numbers that are not all years."""
    numeric = F.transform("rows", lambda r: (F.size(r["values"]) >= 2) & ~F.forall(r["values"], looks_like_year))
    return computed(tables, header_rows=F.greatest(F.array_position(numeric, F.lit(True)) - 1, F.lit(0)).cast("int"))


def with_periods(tables: DataFrame) -> DataFrame:
    """Adds `periods`, read left to right from the header cells joined column by column."""
    header = F.slice(F.col("rows"), F.lit(1), F.col("header_rows"))
    width = F.size(F.get("rows", F.lit(0))["cells"])
    columns = F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.array_join(
        F.transform(header, lambda r: F.coalesce(F.get(r["cells"], c), F.lit(""))), " "))
    return computed(tables, periods=parse_periods(F.array_join(columns, " ")))


def table_entries(tables: DataFrame) -> DataFrame:
    """Adds `entries` (label, values, parent): an ordered fold over the body rows of one printed table."""
    body = F.slice(F.col("rows"), F.col("header_rows") + 1, F.size("rows"))
    entry_type = "array<struct<label:string,values:array<double>,parent:string>>"

    def state(entries: Column, pending: Column, parent: Column) -> Column:
        return F.struct(entries.alias("entries"), pending.alias("pending"), parent.alias("parent"))

    def entry(label: Column, values: Column, parent: Column) -> Column:
        return F.array(F.struct(label.alias("label"), values.alias("values"), parent.alias("parent")))

    def lower_start(label: Column) -> Column:
        return label.rlike(r"^\p{Ll}")

    def step(s: Column, r: Column) -> Column:
        label = r["label"]
        joined = F.when((s["pending"] != "") & ((label == "") | lower_start(label)),
                        F.trim(F.concat_ws(" ", s["pending"], label))).otherwise(label)
        added = state(F.concat(s["entries"], entry(joined, r["values"], s["parent"])), F.lit(""), s["parent"])
        last = F.try_element_at(s["entries"], F.lit(-1))
        wrapped = state(F.concat(F.slice(s["entries"], F.lit(1), F.size(s["entries"]) - 1),
                                 entry(F.concat_ws(" ", last["label"], label), last["values"], last["parent"])),
                        s["pending"], s["parent"])
        return first_match([
            (F.size(r["values"]) > 0, added),
            ((label != "") & (F.size(s["entries"]) > 0) & (lower_start(label) | label.startswith(")")), wrapped),
            (label != "", state(s["entries"], label, label))], s)

    start = state(F.array().cast(entry_type), F.lit(""), F.lit(""))
    return computed(tables, entries=F.aggregate(body, start, step, lambda s: s["entries"]))


def read_tables(cells: DataFrame) -> DataFrame:
    """Printed tables with header_rows, periods and entries."""
    return table_entries(with_periods(with_header(with_values(gather_tables(cells)))))


def match_values(tables: DataFrame) -> DataFrame:
    """(keys, entry_no, label, parent, period, value): the last values of a row, in order, one per period."""
    n = F.size("periods")
    full = F.filter(F.transform("entries", lambda e, i: F.struct(i.alias("entry_no"), e.alias("e"))), lambda x: F.size(x["e"]["values"]) >= n)
    rows = F.flatten(F.transform(full, lambda x: F.transform(F.col("periods"), lambda p, i: F.struct(
        x["entry_no"].alias("entry_no"), x["e"]["label"].alias("label"), x["e"]["parent"].alias("parent"), p["label"].alias("period"),
        F.get(x["e"]["values"], F.size(x["e"]["values"]) - n + i).alias("value")))))
    keep = [c for c in tables.columns if c not in ("rows", "periods", "entries", "header_rows")]
    return tables.where(n > 0).select(*keep, F.inline(rows))


def assemble_items(values: DataFrame) -> DataFrame:
    """(doc_id, item, period, value) in million.

    `values` has doc_id, page, table_no, entry_no, statement, unit, label, parent, period, value. The first
    printed row of an item counts; borrowings add up over all their rows, in printed order.
    """
    item = match_line_item(F.col("statement"), F.col("label"), F.col("parent"))
    factor = F.when(F.col("item").isin(*V.PER_SHARE_ITEMS), 1.0).otherwise(lookup(F.col("unit"), V.UNITS_TO_MILLION))
    read = (values.withColumn("item", item).where("item IS NOT NULL")
            .withColumn("value", exact_round(F.col("value") * factor, 2)))
    at = F.struct("page", "table_no", "entry_no")
    one_row = read.groupBy("doc_id", "item", "page", "table_no", "entry_no").agg(F.collect_list(F.struct("period", "value")).alias("v"))
    summed = F.col("item").isin(*V.SUMMED_ITEMS)
    packed = one_row.groupBy("doc_id", "item").agg(
        F.min_by("v", at).alias("v"), F.array_sort(F.collect_list(F.when(summed, F.struct(at.alias("at"), "v")))).alias("rows"))

    def total(period: Column) -> Column:
        found = F.filter("all", lambda x: x["period"].eqNullSafe(period) & x["value"].isNotNull())
        added = F.aggregate(found, F.lit(0.0), lambda sum, x: sum + x["value"])
        return F.struct(period.alias("period"), F.when(F.size(found) > 0, exact_round(added, 2)).alias("value"))

    added = packed.withColumn("all", F.flatten("rows.v"))
    return added.select("doc_id", "item", F.inline(F.when(summed, F.transform(F.array_distinct("all.period"), total)).otherwise(F.col("v"))))


def order_periods(tables: DataFrame) -> DataFrame:
    """(doc_id, place, period, full_year, y, m): the first definition of every label, newest first."""
    seen = (tables.select("doc_id", "page", "table_no", F.posexplode(F.col("periods").cast(PERIOD_TYPE)).alias("i", "p"))
            .groupBy("doc_id", F.col("p.label").alias("period"))
            .agg(F.min_by("p", F.struct("page", "table_no", "i")).alias("p"), F.min(F.struct("page", "table_no", "i")).alias("at")))
    packed = F.struct(F.negative("p.y").alias("y"), F.negative("p.m").alias("m"), "at", "period", F.col("p.full_year").alias("full_year"))
    ordered = seen.groupBy("doc_id").agg(F.array_sort(F.collect_list(packed)).alias("a"))
    return ordered.select("doc_id", F.posexplode("a").alias("place", "x")).select(
        "doc_id", (F.col("place") + 1).alias("place"), "x.period", "x.full_year", F.negative("x.y").alias("y"), F.negative("x.m").alias("m"))


def missing_items(present: DataFrame) -> DataFrame:
    """(doc_id, item): expected line items no table gave."""
    expected = lit_array(i for items in V.LINE_ITEMS.values() for i in items)
    found = present.groupBy("doc_id").agg(F.collect_set("item").alias("found"))
    return found.select("doc_id", F.explode(F.array_except(expected, F.col("found"))).alias("item"))


def identity_check(wide: DataFrame) -> DataFrame:
    """Periods whose total income is off from revenue plus other income by more than one percent."""
    c = F.col
    gap = F.try_divide(F.abs(c("total_income") - (c("revenue_from_operations") + c("other_income"))), F.abs("total_income"))
    return wide.where(gap > V.IDENTITY_TOLERANCE)


def net_worth(facts: DataFrame, periods: DataFrame) -> DataFrame:
    """Total equity at the newest period of any kind; null when that period has none."""
    newest = periods.groupBy("doc_id").agg(F.max_by("period", F.struct("y", "m")).alias("period"))
    equity = facts.where("item = 'total_equity'").select("doc_id", "period", F.col("value").alias("net_worth"))
    return newest.join(equity, ["doc_id", "period"], "left").select("doc_id", "net_worth")

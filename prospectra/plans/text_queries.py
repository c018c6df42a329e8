"""Text functions over the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions import text as T
from prospectra.plans.inputs import check_sql, derived, table
from prospectra.plans.registry import Registry


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


# lines of every document, numbered from 0
LINES_SQL = """lines AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def document_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


TOKENS_SQL = f"""list_transform(list_filter(regexp_extract_all(lower({{text}}), '[a-z0-9]+'),
  lambda w: w NOT IN ({sql_list(V.STOPWORDS)})),
  lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END)"""


def register(r: Registry) -> None:
    def documents(expression, out="result", check=None, name=None):
        r.add(name, lambda spark, sf: table(spark, sf, "documents").select("doc_id", expression(F.col("text")).alias(out)),
              f"SELECT doc_id, {check} AS {out} FROM documents")

    documents(T.collapse_ws, check=r"trim(regexp_replace(text, '\s+', ' ', 'g'))", name="collapse_ws")
    documents(T.estimate_tokens, name="estimate_tokens",
              check="(length(text) - length(regexp_replace(text, '[^0-9]', '', 'g'))) // 4"
                    " + length(regexp_replace(text, '[^0-9]', '', 'g')) + 1")
    documents(T.shorten, name="shorten_headline", check=r"""
      array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:14], ' ')
      || CASE WHEN len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) > 14 THEN '…' ELSE '' END""")
    documents(T.figures, name="figures",
              check=r"list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda f: replace(f, ',', ''))")
    documents(lambda t: F.array_join(T.tokenise(t), " "), name="tokenise",
              check=f"array_to_string({TOKENS_SQL.format(text='text')}, ' ')")
    documents(T.normalise_title, name="normalise_title",
              check=r"replace(upper(trim(regexp_replace(translate(text, '’‘–—', '''''--'), '\s+', ' ', 'g'))), 'ẞ', 'SS')")

    r.add("previews", lambda spark, sf: table(spark, sf, "documents").select(
        "doc_id", T.preview(F.col("text")).alias("citation"), T.preview(F.col("text"), V.HEADING_CHARS).alias("heading"),
        T.preview(F.col("text"), V.PAGE_EXCERPT_CHARS).alias("page"), T.preview(F.col("text"), V.HISTORY_CHARS).alias("turn"),
        T.preview(F.col("text"), V.CLASSIFY_SAMPLE_CHARS).alias("sample")),
        """SELECT doc_id, left(text, 200) AS citation, left(text, 1200) AS heading, left(text, 4000) AS page,
                  left(text, 1500) AS turn, left(text, 5000) AS sample FROM documents""")

    r.add("looks_like_heading", lambda spark, sf: document_lines(spark, sf).select(
        "doc_id", "line_no", T.looks_like_heading(F.when(F.col("line_no") % 3 == 0, F.upper("line"))
                                                  .otherwise(F.col("line"))).alias("heading")),
        rf"""WITH {LINES_SQL},
        cased AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN upper(line) ELSE line END AS line FROM lines),
        counted AS (SELECT doc_id, line_no, length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) AS letters,
                    length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS capitals FROM cased)
        SELECT doc_id, line_no, letters >= 3 AND capitals > 0.8 * letters AS heading FROM counted""")

    r.add("section_key", lambda spark, sf: derived(spark, sf, "titles").select(
        "doc_id", "pos", "title", T.section_key(F.col("title")).alias("key"),
        T.is_skipped_section(F.col("title")).alias("skipped")), f"""
        WITH {check_sql('titles')},
        named AS (SELECT *, upper(trim(regexp_replace(translate(regexp_replace(title,
             '^SECTION\\s+[IVXL]+\\s*[-–—:]?\\s*', '', 'i'), '’‘–—', '''''--'), '\\s+', ' ', 'g'))) AS name FROM titles)
        SELECT doc_id, pos, title, {SECTION_KEY_SQL.format(name='name')} AS key,
               title IS NULL OR regexp_matches(name, '{V.SKIPPED_SECTIONS}') AS skipped FROM named""")

    r.add("clean_label", lambda spark, sf: derived(spark, sf, "cells").where("col = 0").select(
        "doc_id", "page", "row_no", T.clean_label(F.col("text")).alias("label")), rf"""
        WITH {check_sql('cells')}
        SELECT doc_id, page, row_no, regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))),
          '^((\(?[a-z0-9]{{1,4}}[.)])\s*|[-•]\s*)+', '') AS label FROM cells WHERE col = 0""")

    r.add("parse_value", lambda spark, sf: derived(spark, sf, "cells").select(
        "doc_id", "page", "row_no", "col", T.parse_value(F.col("text")).alias("value")), f"""
        WITH {check_sql('cells')}
        SELECT doc_id, page, row_no, col, {PARSE_VALUE_SQL.format(cell='text')} AS value FROM cells""")

    r.add("parse_periods", lambda spark, sf: derived(spark, sf, "period_texts").select(
        "doc_id", "y", F.posexplode(T.parse_periods(F.col("text"))).alias("pos", "p")).select(
        "doc_id", "y", "pos", "p.label", "p.full_year", F.col("p.y").alias("year"), F.col("p.m").alias("month")), rf"""
        WITH {check_sql('period_texts')},
        hits AS (SELECT doc_id, y, unnest(h) AS hit, CAST(unnest(range(len(h))) AS INT) AS pos FROM (
          SELECT doc_id, y, regexp_extract_all(text, '(?i)(?:{MONTHS_RE})\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS_RE}),?\s+\d{{4}}|Fiscal\s+\d{{4}}') AS h
          FROM period_texts)),
        parts AS (SELECT *, CAST(regexp_extract(hit, '(\d{{4}})$', 1) AS INT) AS yr, lower(regexp_extract(hit, '(?i)({MONTHS_RE})', 1)) AS mon,
          CASE WHEN regexp_matches(hit, '^\d') THEN regexp_extract(hit, '^(\d+)', 1) ELSE regexp_extract(hit, '^[A-Za-z]+\s+(\d+)', 1) END AS day FROM hits),
        flagged AS (SELECT *, mon = '' OR (mon = 'march' AND day = '31') AS full_year FROM parts)
        SELECT doc_id, y, pos, CASE WHEN full_year THEN 'FY' || yr ELSE upper(mon[1:1]) || mon[2:3] || ' ' || day || ', ' || yr END AS label,
          full_year, yr AS year, CAST(CASE WHEN full_year THEN 3 ELSE list_position([{sql_list(m.lower() for m in V.MONTHS)}], mon) END AS INT) AS month
        FROM flagged""")

    r.add("strip_inline_ids", lambda spark, sf: derived(spark, sf, "cited_texts").select(
        "doc_id", T.strip_inline_ids(F.col("text")).alias("text")), f"""
        WITH {check_sql('cited_texts')}
        SELECT doc_id, regexp_replace(regexp_replace(text, '\\s*\\((?:[FRBOL][0-9]+[,;\\s]*)+\\)', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text
        FROM cited_texts""")

    r.add("to_million", lambda spark, sf: derived(spark, sf, "cases").select(
        "doc_id", "ord", T.to_million(F.col("amount"), F.col("unit")).alias("amount_million"),
        (F.col("amount").isNotNull() & F.col("unit").isNull()).alias("unit_missing")), f"""
        WITH {check_sql('cases')}, units(unit, factor) AS (VALUES ('rupees', 1e-6), ('thousand', 1e-3), ('lakh', 0.1E0), ('million', 1.0E0), ('crore', 10.0E0))
        SELECT doc_id, ord, amount * factor AS amount_million, amount IS NOT NULL AND cases.unit IS NULL AS unit_missing
        FROM cases LEFT JOIN units ON units.unit = cases.unit""")

    r.add("detect_unit", lambda spark, sf: derived(spark, sf, "statement_pages").groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), " ").alias("t")
    ).select("doc_id", T.detect_unit(F.col("t")).alias("unit")), f"""
        WITH {check_sql('statement_pages')}
        SELECT doc_id, CASE WHEN max(CAST(contains(lower(text), 'in million') AS INT)) = 1 THEN 'million'
          WHEN max(CAST(contains(lower(text), 'in crore') AS INT)) = 1 THEN 'crore'
          WHEN max(CAST(contains(lower(text), 'in lakh') AS INT)) = 1 THEN 'lakh' ELSE 'million' END AS unit
        FROM statement_pages GROUP BY doc_id""")

    r.add("page_link", lambda spark, sf: derived(spark, sf, "cases").select(
        "doc_id", "ord", T.page_link(F.col("page"), F.col("doc_id") % 7).alias("viewer_page")), f"""
        WITH {check_sql('cases')} SELECT doc_id, ord, page + doc_id % 7 + 1 AS viewer_page FROM cases""")

    r.add("match_line_item", lambda spark, sf: derived(spark, sf, "cells").where("col = 0 AND row_no >= 2").select(
        "doc_id", "page", "row_no", T.match_line_item(
            F.when(F.col("page") == 59, "profit_and_loss").when(F.col("page") == 60, "balance_sheet").otherwise("cash_flow"),
            F.col("text"), F.when(F.col("row_no").isin(4, 5), "Trade receivables").otherwise("")).alias("item")), rf"""
        WITH {check_sql('cells')},
        labels2 AS (SELECT doc_id, page, row_no, CASE page WHEN 59 THEN 'profit_and_loss' WHEN 60 THEN 'balance_sheet' ELSE 'cash_flow' END AS statement,
           {CLEAN_SQL.format(x='text')} AS own, CASE WHEN row_no IN (4, 5) THEN {CLEAN_SQL.format(x="'Trade receivables ' || text")} END AS joined
           FROM cells WHERE col = 0 AND row_no >= 2)
        SELECT doc_id, page, row_no, coalesce({MATCH_ITEM_SQL.format(x='own')}, {MATCH_ITEM_SQL.format(x='joined')}) AS item FROM labels2""")

    r.add("similarity_from_distance", lambda spark, sf: table(spark, sf, "events").select(
        "event_id", F.round(T.similarity_from_distance(F.col("value") / 20), 9).alias("similarity")),
        "SELECT event_id, round(least(1.0, greatest(0.0, 1 - value / 20 / 2)), 9) AS similarity FROM events")


MONTHS_RE = "|".join(V.MONTHS)
CLEAN_SQL = r"regexp_replace(lower(trim(regexp_replace({x}, '\s+', ' ', 'g'))), '^((\(?[a-z0-9]{{1,4}}[.)])\s*|[-•]\s*)+', '')"
SECTION_KEY_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches({{name}}, '{p}') THEN '{k}'" for k, p in V.SECTION_PATTERNS.items()) + " END"
PARSE_VALUE_SQL = r"""(CASE
  WHEN lower({cell}) IN ('-', '–', '—', 'nil') THEN 0.0
  WHEN regexp_matches(regexp_replace(regexp_replace({cell}, '[₹ ]', '', 'g'), '[*#^]+$', ''), '^\(?-?(\d{{1,3}}(,\d{{2,3}})+|\d+)(\.\d+)?\)?$')
  THEN CASE WHEN {cell} LIKE '(%' OR {cell} LIKE '-%' THEN -1 ELSE 1 END
       * TRY_CAST(regexp_replace({cell}, '[^0-9.]', '', 'g') AS DOUBLE) END)::DOUBLE"""

# line-item rules without lookahead: (statement, item, must match, must not match)
_ITEM_RULES = (
    ("profit_and_loss", "revenue_from_operations", "^revenue from operations", None),
    ("profit_and_loss", "other_income", "^other income", None),
    ("profit_and_loss", "total_income", "^total (income|revenue)", None),
    ("profit_and_loss", "finance_costs", "^finance cost", None),
    ("profit_and_loss", "depreciation", "^depreciation", None),
    ("profit_and_loss", "total_expenses", "^total expenses", None),
    ("profit_and_loss", "profit_before_tax", "before tax", "exceptional"),
    ("profit_and_loss", "profit_for_period", "^(net )?profit.{{0,12}}for the (year|period)", "for the (year|period).*(continuing|discontinued|attributable)"),
    ("profit_and_loss", "eps_basic", "^basic", None),
    ("balance_sheet", "total_assets", "^total assets", None),
    ("balance_sheet", "total_current_assets", "^total current assets", None),
    ("balance_sheet", "total_current_liabilities", "^total current liabilities", None),
    ("balance_sheet", "total_equity", "^total equity", "^total equity and"),
    ("balance_sheet", "cash_and_equivalents", "^cash (and|&) cash equivalents", None),
    ("balance_sheet", "trade_receivables", "^trade receivables", None),
    ("balance_sheet", "inventories", "^inventories", None),
    ("balance_sheet", "borrowings", "^(non-current |current )?borrowings", None),
    ("cash_flow", "operating_cash_flow", "^net cash.*operating", None),
    ("cash_flow", "investing_cash_flow", "^net cash.*investing", None),
    ("cash_flow", "financing_cash_flow", "^net cash.*financing", None),
    ("cash_flow", "capex", "^[(]?(purchase|acquisition|investments?|payments?)[)]?\\s*(of|in|for)\\s+property,? plant", None),
)
MATCH_ITEM_SQL = "CASE " + " ".join(
    f"WHEN statement = '{s}' AND regexp_matches({{x}}, '{p}')" + (f" AND NOT regexp_matches({{x}}, '{n}')" if n else "") + f" THEN '{i}'"
    for s, i, p, n in _ITEM_RULES) + " END"

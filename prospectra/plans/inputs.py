"""Logical inputs derived from the given tables.

Each derived table is one SQL text that both Spark and the checking engine can read;
a few bracketed tokens stand for functions the two dialects name differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from prospectra.plans.registry import shared

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# Columns of the given tables (no file has to be opened to infer them).
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

DERIVED: dict[str, str] = {}

# ---- statements: one issuer per supplier, one period per shipping year (the last one is a part-year)
DERIVED["fin_rev"] = """
SELECT l_suppkey AS doc_id, CAST(year(l_shipdate) AS INT) AS y,
       round(TOTAL[l_extendedprice * (1 - l_discount)] / 1000.0, 2) AS rev
FROM lineitem GROUP BY l_suppkey, year(l_shipdate)
"""
DERIVED["fin_wide"] = """
SELECT doc_id, y, last_y,
  CASE WHEN y = last_y THEN 'Sep 30, ' || CAST(y AS STRING) ELSE 'FY' || CAST(y AS STRING) END AS period,
  y <> last_y AS full_year,
  CASE WHEN y = last_y THEN 9 ELSE 3 END AS m,
  rev AS revenue_from_operations,
  rev * ((doc_id + 3 * y) % 7) / 200 AS other_income,
  rev * ((2 * doc_id + y) % 6) / 200 AS finance_costs,
  rev * (1 + (doc_id + y) % 4) / 100 AS depreciation,
  rev * ((7 * doc_id + 13 * y) % 11 - 3) / 50 AS profit_before_tax,
  rev * ((7 * doc_id + 13 * y) % 11 - 3) / 50 * 0.75 AS profit_for_period,
  CASE WHEN (doc_id + y) % 17 = 0 THEN -1 ELSE 1 END * rev * (2 + (5 * doc_id + y) % 9) / 10 AS total_equity,
  CASE WHEN (doc_id + y) % 13 = 0 THEN 1.05E0 ELSE 1.0E0 END * (rev + rev * ((doc_id + 3 * y) % 7) / 200) AS total_income,
  rev * ((3 * doc_id + 2 * y) % 10) / 12 AS borrowings,
  rev * (1 + (doc_id + 2 * y) % 6) / 12 AS trade_receivables,
  rev * ((5 * doc_id + y) % 5) / 15 AS inventories,
  rev * (1 + (11 * doc_id + 3 * y) % 8) / 40 AS cash_and_equivalents,
  rev * (1 + (doc_id + 2 * y) % 6) / 12 + rev * ((5 * doc_id + y) % 5) / 15
    + rev * (1 + (11 * doc_id + 3 * y) % 8) / 40 AS total_current_assets,
  rev * (2 + (doc_id + 4 * y) % 7) / 12 AS total_current_liabilities,
  1.5E0 * rev AS total_assets,
  rev * ((5 * doc_id + 9 * y) % 13 - 3) / 100 AS operating_cash_flow,
  CASE WHEN doc_id % 6 = 5 THEN NULL ELSE -rev * ((doc_id + 7 * y) % 6) / 80 END AS capex
FROM (SELECT *, CAST((SELECT max(year(l_shipdate)) FROM lineitem) AS INT) AS last_y FROM fin_rev) AS f
"""
FIN_ITEMS = ("revenue_from_operations", "other_income", "finance_costs", "depreciation", "profit_before_tax",
             "profit_for_period", "total_equity", "total_income", "borrowings", "trade_receivables", "inventories",
             "cash_and_equivalents", "total_current_assets", "total_current_liabilities", "total_assets",
             "operating_cash_flow", "capex")

# ---- printed statement tables: the same figures as cells with headers, notes and wrapped labels
DERIVED["statement_rows"] = """
SELECT * FROM (VALUES
  (0, 'profit_and_loss', 2, 'Revenue from operations', 'revenue_from_operations'),
  (1, 'profit_and_loss', 3, '(a) Other Income', 'other_income'),
  (2, 'profit_and_loss', 4, 'Total income', 'total_income'),
  (3, 'profit_and_loss', 5, 'Expenses', 'none'),
  (4, 'profit_and_loss', 6, 'Finance costs', 'finance_costs'),
  (5, 'profit_and_loss', 7, 'Depreciation and amortisation', 'depreciation'),
  (6, 'profit_and_loss', 8, 'Profit before exceptional items and', 'none'),
  (7, 'profit_and_loss', 9, 'tax before tax effect', 'profit_for_period'),
  (8, 'profit_and_loss', 10, 'Profit before tax', 'profit_before_tax'),
  (9, 'profit_and_loss', 11, 'Net profit for the', 'profit_for_period'),
  (10, 'profit_and_loss', 12, 'year', 'none'),
  (11, 'balance_sheet', 2, 'Non-current borrowings', 'borrowings'),
  (12, 'balance_sheet', 3, 'Trade receivables', 'none'),
  (13, 'balance_sheet', 4, 'Billed', 'trade_receivables'),
  (14, 'balance_sheet', 5, 'Unbilled', 'inventories'),
  (15, 'balance_sheet', 6, 'Inventories', 'inventories'),
  (16, 'balance_sheet', 7, '- Cash & Cash Equivalents', 'cash_and_equivalents'),
  (17, 'balance_sheet', 8, 'Total current assets', 'total_current_assets'),
  (18, 'balance_sheet', 9, '1. Borrowings', 'inventories'),
  (19, 'balance_sheet', 10, 'Total current liabilities', 'total_current_liabilities'),
  (20, 'balance_sheet', 11, 'Total equity and liabilities', 'total_assets'),
  (21, 'balance_sheet', 12, 'Total equity', 'total_equity'),
  (22, 'balance_sheet', 13, 'Total assets', 'total_assets'),
  (23, 'cash_flow', 2, 'Net cash generated from', 'operating_cash_flow'),
  (24, 'cash_flow', 3, 'operating activities', 'none'),
  (25, 'cash_flow', 4, 'Purchase of', 'none'),
  (26, 'cash_flow', 5, 'property, plant and equipment', 'capex')
) AS v(idx, statement, row_no, label, item)
"""
DERIVED["statement_pages"] = """
SELECT doc_id, CAST(page AS INT) AS page,
  CASE WHEN doc_id % 4 = 3 AND page > 58 THEN 'Restated ' ELSE '' END
   || CASE page WHEN 58 THEN 'NOTES' WHEN 59 THEN 'Statement of Profit and Loss' WHEN 60 THEN 'Assets and Liabilities'
        ELSE CASE WHEN doc_id % 8 = 5 THEN 'continued' ELSE 'Summary of Cash Flow' END END
   || ' (amounts in ' || CASE doc_id % 3 WHEN 0 THEN 'million' WHEN 1 THEN 'lakh' ELSE 'crore' END || ')' AS text
FROM (SELECT s_suppkey AS doc_id, RANGE[58; 61] AS page FROM supplier) AS p
"""
DERIVED["statement_values"] = """
SELECT w.doc_id, w.y, w.last_y, r.statement, r.row_no, r.label, r.item,
  CASE r.item WHEN 'revenue_from_operations' THEN revenue_from_operations WHEN 'other_income' THEN other_income
    WHEN 'total_income' THEN total_income WHEN 'finance_costs' THEN finance_costs WHEN 'depreciation' THEN depreciation
    WHEN 'profit_before_tax' THEN profit_before_tax WHEN 'profit_for_period' THEN profit_for_period
    WHEN 'borrowings' THEN borrowings WHEN 'trade_receivables' THEN trade_receivables WHEN 'inventories' THEN inventories
    WHEN 'cash_and_equivalents' THEN cash_and_equivalents WHEN 'total_current_assets' THEN total_current_assets
    WHEN 'total_current_liabilities' THEN total_current_liabilities WHEN 'total_equity' THEN total_equity
    WHEN 'total_assets' THEN total_assets WHEN 'operating_cash_flow' THEN operating_cash_flow WHEN 'capex' THEN capex END AS value
FROM (SELECT *, RANGE[0; 26] AS row_idx FROM fin_wide) AS w JOIN statement_rows r ON r.idx = w.row_idx
"""
DERIVED["cells"] = """
SELECT doc_id, CASE statement WHEN 'profit_and_loss' THEN 59 WHEN 'balance_sheet' THEN 60 ELSE 61 END AS page, 1 AS table_no,
  CAST(CASE kind WHEN 3 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 0 ELSE row_no END AS INT) AS row_no,
  CAST(CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 5 THEN 0 ELSE last_y - y + 2 END AS INT) AS col,
  CASE kind WHEN 0 THEN label
    WHEN 1 THEN CASE WHEN row_no % 3 = 0 AND item <> 'none' THEN CAST(row_no + 10 AS STRING) END
    WHEN 2 THEN CASE WHEN item = 'none' OR value IS NULL THEN '' WHEN value = 0 THEN '-'
         WHEN value < 0 THEN '(' || MONEY[-value] || ')' ELSE '₹ ' || MONEY[value] || CASE WHEN row_no % 5 = 0 THEN '*' ELSE '' END END
    WHEN 3 THEN CASE WHEN statement = 'balance_sheet' AND y <> last_y THEN 'As at 31st March,' WHEN y = last_y THEN 'As at September 30,'
         ELSE 'Year ended March 31,' END
    WHEN 4 THEN CAST(y AS STRING) ELSE 'Particulars' END AS text
FROM (SELECT *, RANGE[0; 5] AS kind FROM statement_values) AS k
WHERE kind = 2 OR kind IN (0, 1) AND y = last_y - 1 OR kind IN (3, 4) AND row_no = 2 OR kind = 5 AND row_no = 2 AND y = last_y - 1
"""

# ---- risk answers: one model answer per labelled document
DERIVED["risk_answers"] = """
SELECT d.doc_id AS item_id, CAST(1 + (l.doc_id + 2 * l.quality + l.toxic) % 5 AS INT) AS score,
  CASE l.doc_id % 7 WHEN 0 THEN 'business' WHEN 1 THEN 'financial' WHEN 2 THEN 'regulatory_legal' WHEN 3 THEN 'litigation'
    WHEN 4 THEN 'management' WHEN 5 THEN 'macroeconomic' ELSE 'offer_shares' END AS category,
  CASE WHEN l.quality = 1 AND l.doc_id % 3 = 0 THEN ' Figure ' || CAST(d.n_chars AS STRING) || ' in ' || d.lang
       ELSE 'Exposure in ' || d.lang || ' ' END AS headline
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
"""

# ---- legal cases: one per event, one document per user
DERIVED["cases"] = """
SELECT doc_id, ord, heading, party, against_party, type, total_row, n AS count, amount, unit, summary, page, source_text FROM (
 SELECT user_id AS doc_id, event_id AS ord, k,
  'Litigation involving our ' || CASE k % 4 WHEN 0 THEN 'Company' WHEN 1 THEN 'Promoters' WHEN 2 THEN 'Directors (except the Promoters)'
      ELSE 'Subsidiaries and Group Companies' END
   || CASE k % 3 WHEN 0 THEN ' > A. Litigation filed by our Promoter' WHEN 1 THEN ' > B. Litigation against the Company' ELSE '' END
   || ' > ' || event_type AS heading,
  CASE (event_id * 7 + k) % 6 WHEN 0 THEN 'company' WHEN 1 THEN 'subsidiary' WHEN 2 THEN 'promoter' WHEN 3 THEN 'director'
    WHEN 4 THEN 'group_company' ELSE 'key_management' END AS party,
  event_id % 3 <> 0 AS against_party,
  CASE event_type WHEN 'view' THEN 'civil' WHEN 'click' THEN 'tax' WHEN 'signup' THEN 'regulatory' WHEN 'error' THEN 'criminal'
    ELSE 'sebi_disciplinary' END AS type,
  event_id % 50 = 0 AS total_row, k % 4 AS n,
  CASE WHEN k % 7 = 0 THEN NULL ELSE value END AS amount,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CASE k % 5 WHEN 0 THEN 'rupees' WHEN 1 THEN 'thousand' WHEN 2 THEN 'lakh' WHEN 3 THEN 'million'
    ELSE 'crore' END END AS unit,
  ' Matter ' || CAST(k % 10 AS STRING) || ' on ' || event_type || ' brought in the district of number ' || CAST(user_id % 3 AS STRING) AS summary,
  300 + k % 9 AS page,
  CASE WHEN k % 13 = 0 THEN 'no amount is stated' ELSE 'an amount of ' || CAST(value AS STRING) || ' is claimed' END AS source_text
 FROM (SELECT user_id, event_id, event_type, value, CAST(JSON[props; k] AS INT) AS k FROM events) AS e ) AS c
"""

# ---- approvals: one record per supplier
DERIVED["approvals"] = """
SELECT s_suppkey AS doc_id,
  CASE s_suppkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS all_material_obtained,
  CAST(s_suppkey % 4 AS INT) AS n_pending, CAST(s_suppkey % 5 AS INT) AS n_not_applied
FROM supplier WHERE s_suppkey % 9 <> 8
"""

# ---- offers: one per order, its lines are the uses of proceeds
DERIVED["offers"] = """
SELECT o_orderkey AS doc_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'million' WHEN '2' THEN 'lakh' WHEN '3' THEN 'crore' WHEN '4' THEN 'million'
    ELSE 'lakh' END AS amount_unit,
  CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_totalprice END AS fresh_issue_amount,
  CASE WHEN o_orderkey % 13 = 5 THEN NULL ELSE o_orderkey % 900 + 100 END AS fresh_issue_shares,
  (o_custkey % 400) * (o_orderkey % 3) AS offer_for_sale_shares,
  o_orderstatus = 'P' AS promoters_selling,
  CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE (o_orderkey % 900 + 100) * 4 + o_custkey % 1000 END AS shares_after_offer,
  CAST(100 + o_custkey % 40 AS INT) AS offer_page
FROM orders
"""
DERIVED["objects"] = """
SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_returnflag = 'R' AS general_purposes,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE l_extendedprice END AS amount,
  CASE WHEN p_name LIKE '%rod' THEN 'Repayment of borrowings for ' || p_name WHEN p_name LIKE '%ring' THEN 'Prepayment of loans on ' || p_name
       ELSE 'Purchase of ' || p_name END AS purpose, CAST(120 + l_partkey % 30 AS INT) AS page
FROM lineitem JOIN part ON p_partkey = l_partkey
"""

# ---- promoters: one profile per customer
DERIVED["promoters"] = """
SELECT c_custkey AS doc_id, c_name AS name,
  CASE WHEN c_custkey % 17 = 16 THEN NULL ELSE (c_custkey * 37 % 10000) / 100.0E0 END AS holding_pct,
  CASE c_custkey % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS shares_pledged,
  CAST(c_custkey % 5 AS INT) AS n_concerns,
  CAST(150 + c_nationkey AS INT) AS holding_page, CAST(180 + c_nationkey % 7 AS INT) AS pledge_page
FROM customer
"""

# ---- the holders who sell in an offer, its listed peers (suppliers of the same nation), approvals not yet received
DERIVED["sellers"] = """
SELECT l_orderkey AS doc_id, l_linenumber AS ord, s_name AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'A'
"""
DERIVED["peers"] = """
SELECT s.s_suppkey AS doc_id, p.low, p.high, CASE WHEN s.s_suppkey % 8 <> 7 THEN p.mean END AS mean, CAST(200 + s.s_suppkey % 5 AS INT) AS page
FROM supplier s JOIN (SELECT s_nationkey, min(pe) / 100.0E0 AS low, max(pe) / 100.0E0 AS high, floor(sum(pe) / CAST(count(*) AS DOUBLE)) / 100.0E0 AS mean
  FROM (SELECT s_nationkey, CAST(floor(abs(s_acctbal)) AS BIGINT) + 100 AS pe FROM supplier) AS a GROUP BY s_nationkey) AS p ON p.s_nationkey = s.s_nationkey
"""
DERIVED["pending"] = """
SELECT s_suppkey AS doc_id, i AS ord, 'Licence ' || CAST(i AS STRING) || ' of ' || s_name AS item, CAST(250 + s_nationkey AS INT) AS page
FROM (SELECT s_suppkey, s_name, s_nationkey, RANGE[1; 3] AS i FROM supplier) AS s WHERE i <= s_suppkey % 4 AND s_suppkey % 9 <> 8
"""
# ---- what the written answers say of a document: its lines
DERIVED["claims"] = """
SELECT doc_id, CAST(ln AS BIGINT) AS ord, CAST(ln DIV 4 + 1 AS INT) AS page, line AS text, CASE WHEN ln = 0 THEN 'description' WHEN ln = 1 THEN 'summary'
    WHEN ln = 2 THEN 'market_position' WHEN ln = 3 THEN 'related_party' WHEN ln = 4 THEN 'executive_summary'
    WHEN ln % 3 = 0 THEN 'strength' WHEN ln % 3 = 1 THEN 'weakness' ELSE 'governance' END AS kind
FROM (SELECT source, doc_id, LINES[text])
"""

# ---- jobs: one job per user, one progress message per event
DERIVED["job_events"] = """
SELECT user_id AS job_id, event_id, ts,
  CASE k % 9 WHEN 0 THEN 'parse' WHEN 1 THEN 'index' WHEN 2 THEN 'risk' WHEN 3 THEN 'financial' WHEN 4 THEN 'legal' WHEN 5 THEN 'business'
    WHEN 6 THEN 'offer' WHEN 7 THEN 'score' ELSE 'synthesis' END AS step,
  CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'waiting' WHEN 'signup' THEN 'started' WHEN 'error' THEN 'failed'
    ELSE 'done' END AS event,
  CASE k % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS model,
  CAST(floor(value * 60) AS BIGINT) AS tokens, CAST(floor(value * 8) AS BIGINT) AS output_tokens, 'message ' || CAST(k AS STRING) AS message
FROM (SELECT user_id, event_id, event_type, value, ts, CAST(JSON[props; k] AS INT) AS k FROM events) AS e
"""

# ---- domain texts: every document with trap words and two or three words of the fixed keyword lists
DERIVED["domain_texts"] = """
SELECT d.doc_id, d.text || ' through syntax flaw ' || w.a || '. ' || upper(w.b) || ', ' || w.c AS text
FROM documents d JOIN (VALUES
  (0, 'contract', 'clause', 'loan'), (1, 'balance sheet', 'tax', 'court'), (2, 'nurse', 'HR', 'health'),
  (3, 'teams', 'clinics', 'taxing'), (4, 'liability', 'risk', 'portfolio'), (5, 'policy', 'annual report', 'memo'),
  (6, 'vaccine', 'FDA', 'interest rate'), (7, 'compliance', 'statute', 'handbook'), (8, 'cash flow', 'audit', 'training'),
  (9, 'dosage', 'tort', 'breach'), (10, 'sheet balance', 'rate', 'report')) AS w(k, a, b, c) ON d.doc_id % 11 = w.k
"""

# ---- titles, dates and cited sentences per supplier, customer or document
DERIVED["titles"] = """
SELECT s_suppkey AS doc_id, pos, CASE WHEN (s_suppkey + pos) % 6 = 0 THEN 'SECTION IV – ' ELSE '' END
  || CASE WHEN (s_suppkey + pos) % 5 = 0 THEN lower(name) ELSE name END AS title
FROM (SELECT s_suppkey, RANGE[0; 27] AS i FROM supplier) AS s JOIN (VALUES
  (0, 'Summary of the Offer Document'), (1, 'RISK FACTORS'), (2, 'SUMMARY OF FINANCIAL INFORMATION'), (3, 'CAPITAL  STRUCTURE'),
  (4, 'OBJECTS OF THE ISSUE'), (5, 'BASIS FOR OFFER PRICE'), (6, 'INDUSTRY OVERVIEW'), (7, 'OUR BUSINESS'), (8, 'OUR MANAGEMENT'),
  (9, 'OUR PROMOTERS AND PROMOTER GROUP'), (10, 'RESTATED CONSOLIDATED FINANCIAL STATEMENTS'), (11, 'OTHER FINANCIAL INFORMATION'),
  (12, 'MANAGEMENT’S DISCUSSION AND ANALYSIS OF RESULTS'), (13, 'FINANCIAL INDEBTEDNESS'), (14, 'OUTSTANDING LITIGATION AND MATERIAL DEVELOPMENTS'),
  (15, 'GOVERNMENT AND OTHER APPROVALS'), (16, 'THE OFFER'), (17, 'GENERAL INFORMATION'), (18, 'SUMMARY OF RELATED PARTY TRANSACTIONS'),
  (19, 'HISTORY AND CERTAIN CORPORATE MATTERS'), (20, 'OUR GROUP COMPANIES'), (21, 'OUR PROMOTERISM'), (22, 'THE OFFER PROCEDURE'),
  (23, 'OFFER PROCEDURE'), (24, 'DEFINITIONS AND ABBREVIATIONS'), (25, 'FORWARD-LOOKING STATEMENTS'), (26, 'DECLARATION'), (27, NULL)
) AS v(pos, name) ON v.pos = s.i
"""
DERIVED["period_texts"] = """
SELECT c_custkey AS doc_id, y, CASE (c_custkey + y) % 6
  WHEN 0 THEN 'As at March 31, ' || CAST(y AS STRING) || ' and March 31 ' || CAST(y - 1 AS STRING)
  WHEN 1 THEN 'Six months ended 30th September, ' || CAST(y AS STRING)
  WHEN 2 THEN 'Fiscal ' || CAST(y AS STRING) || ' Fiscal ' || CAST(y - 1 AS STRING)
  WHEN 3 THEN 'as at 31st march ' || CAST(y AS STRING) || ' and june 5, ' || CAST(y AS STRING)
  WHEN 4 THEN 'March 30, ' || CAST(y AS STRING) || ' Mar 31, ' || CAST(y AS STRING)
  ELSE 'December 1 ' || CAST(y AS STRING) || ' Note 31, ' || CAST(y AS STRING) END AS text
FROM (SELECT c_custkey, CAST(2000 + c_custkey % 25 AS INT) AS y FROM customer) AS c
"""
DERIVED["cited_texts"] = """
SELECT doc_id, '  ' || text || CASE doc_id % 5 WHEN 0 THEN ' (F1)' WHEN 1 THEN ' (B1, F3).' WHEN 2 THEN ' (see page 3)'
  WHEN 3 THEN ' (R2; O1 L12)  and (F7) more' ELSE ' (F)' END AS text
FROM documents
"""
DERIVED["label_replies"] = """
SELECT doc_id, CASE WHEN doc_id % 13 <> 12 THEN CASE doc_id % 7 WHEN 0 THEN 'Legal.' WHEN 1 THEN 'The category is healthcare' WHEN 2 THEN 'legal or finance' WHEN 3 THEN 'none'
    WHEN 4 THEN 'finance, certainly finance' WHEN 5 THEN 'Enterprise2' ELSE source || ' ' || lang END END AS reply,
  CASE WHEN doc_id % 13 = 12 THEN NULL WHEN doc_id % 5 = 0 THEN 'finance' WHEN doc_id % 11 = 3 THEN 'legal' END AS chosen
FROM documents
"""
# ---- files, page blocks, saved results
DERIVED["files"] = """
SELECT doc_id, 'Offer ' || source || ' v.' || CAST(doc_id AS STRING) || CASE doc_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt'
    WHEN 3 THEN '.exe' WHEN 4 THEN '' ELSE '.pdf' END AS name,
  n_chars * CASE WHEN doc_id % 9 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN 40000 ELSE 1 END AS size, text
FROM documents
"""
DERIVED["stored_chunks"] = """
SELECT source AS domain, CAST(doc_id AS STRING) AS filename, doc_id, CAST(ln AS INT) AS chunk_id, CAST(ln DIV 4 + 1 AS INT) AS page, line AS text
FROM (SELECT source, doc_id, LINES[text])
"""
DERIVED["blocks"] = """
SELECT user_id AS doc_id, CAST(event_id % 5 + 1 AS INT) AS page, event_id AS block_no, CAST(k - 5 AS DOUBLE) AS x0, value AS y0,
  CAST(k + 5 AS DOUBLE) AS x1, value + 2 AS y1, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS block_type,
  event_type || ' ' || CAST(k AS STRING) || ' ' AS text
FROM (SELECT user_id, event_id, event_type, value, CAST(JSON[props; k] AS INT) AS k FROM events) AS e
"""
DERIVED["boxes"] = """
SELECT doc_id, page, t AS table_no, CAST(CASE t WHEN 0 THEN 10 WHEN 1 THEN 35 ELSE 500 END AS DOUBLE) AS x0, 0.0E0 AS y0,
  CAST(CASE t WHEN 0 THEN 40 WHEN 1 THEN 60 ELSE 510 END AS DOUBLE) AS x1, 60.0E0 AS y1,
  '[TABLE] ' || CAST(t AS STRING) || ' of ' || CAST(doc_id AS STRING) AS text
FROM (SELECT doc_id, page, RANGE[0; 2] AS t FROM (SELECT DISTINCT doc_id, page FROM blocks) AS p) AS b
"""
DERIVED["agent_results"] = """
SELECT user_id AS doc_id, event_id AS result_id, ts AS saved_at, CASE k % 7 WHEN 0 THEN 'risk' WHEN 1 THEN 'financial' WHEN 2 THEN 'business'
    WHEN 3 THEN 'legal' WHEN 4 THEN 'offer' WHEN 5 THEN 'score' ELSE 'report' END AS agent,
  CASE event_type WHEN 'error' THEN 'failed' ELSE 'done' END AS status, CAST(floor(value * 60) AS BIGINT) AS tokens, k
FROM (SELECT user_id, event_id, event_type, value, ts, CAST(JSON[props; k] AS INT) AS k FROM events) AS e
"""
DERIVED["messages"] = """
SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 13 = 0 THEN '  ' WHEN (conv_id + turn) % 17 = 0 THEN '' ELSE text END AS text,
  CASE WHEN (conv_id * 3 + turn) % 11 = 0 THEN 'failed' END AS error, (conv_id + turn) % 19 = 0 AS stopped
FROM conversations WHERE role <> 'system'
"""
DERIVED["offer_answers"] = """
SELECT *, 'The fresh issue of ' || CASE WHEN doc_id % 4 = 1 THEN 'an amount to be decided' ELSE '₹ ' || COALESCE(MONEY[fresh_issue_amount], 'nil') END
   || ' offers ' || CASE WHEN doc_id % 5 = 2 THEN '[●]' ELSE COALESCE(CAST(fresh_issue_shares AS STRING), '') END
   || ' shares; holders sell ' || CASE WHEN doc_id % 6 = 3 THEN 'some' ELSE CAST(offer_for_sale_shares AS STRING) END
   || ' shares; before it there are ' || CASE WHEN doc_id % 11 = 4 THEN 'fewer' ELSE CAST(shares_before_offer AS STRING) END
   || ' and after it ' || COALESCE(CAST(shares_after_offer + doc_id % 3 - 1 AS STRING), '') || ' shares. General corporate purposes take '
   || CASE WHEN doc_id % 9 = 6 THEN 'the rest' ELSE COALESCE(MONEY[general_corporate_purposes_amount], 'nothing') END || '.' AS source_text
FROM (SELECT doc_id, amount_unit, fresh_issue_amount, CAST(fresh_issue_shares AS BIGINT) AS fresh_issue_shares,
    CAST(offer_for_sale_shares AS BIGINT) AS offer_for_sale_shares, CAST((doc_id % 900 + 100) * 3 AS BIGINT) AS shares_before_offer,
    CAST(shares_after_offer AS BIGINT) AS shares_after_offer, CAST(floor(fresh_issue_amount / 4) AS DOUBLE) AS general_corporate_purposes_amount
  FROM offers) AS o
"""
DERIVED["object_answers"] = """
SELECT doc_id, ord, purpose, amount, 'We will use ' || CASE WHEN (doc_id + ord) % 5 = 1 THEN 'an amount to be decided' ELSE COALESCE(MONEY[amount], 'nothing') END
   || ' for ' || purpose || '.' AS source_text
FROM objects
"""
# ---- spans of printed lines, evidence excerpts, raw answers
DERIVED["spans"] = """
SELECT user_id AS doc_id, event_id DIV 7 AS line_no, repeat('x', CAST(floor(value) AS INT) % 12) || ' ' AS text, event_type IN ('view', 'click', 'signup', 'purchase') AS bold
FROM events
"""
DERIVED["excerpts"] = """
SELECT user_id AS doc_id, event_id AS prio, CASE WHEN event_type = 'view' THEN 'page' ELSE 'hit' END AS kind, k % 30 AS page, k AS chunk_id,
  event_type || ' excerpt ' || CAST(event_id AS STRING) AS text
FROM (SELECT user_id, event_id, event_type, value, CAST(JSON[props; k] AS INT) AS k FROM events) AS e
"""
DERIVED["answer_replies"] = """
SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN '{"number": 3, "head' WHEN doc_id % 10 = 7 THEN 'sorry, no answer' ELSE
  '{"number": ' || CAST(doc_id % 90 + 1 AS STRING) || CASE WHEN doc_id % 9 = 5 THEN '' ELSE ', "headline": "risk in ' || lang || '"' END
  || ', "category": "' || CASE doc_id % 8 WHEN 0 THEN 'business' WHEN 1 THEN 'litigation' WHEN 2 THEN 'weather' ELSE 'financial' END
  || '", "score": ' || CAST(doc_id % 7 AS STRING) || CASE WHEN doc_id % 6 = 1 THEN ', "note": "short"' ELSE '' END || '}' END AS json
FROM documents
"""

DEPENDS = {
    "offer_answers": ("offers",), "object_answers": ("objects",),
    "boxes": ("blocks",),
    "fin_wide": ("fin_rev",), "statement_values": ("fin_rev", "fin_wide", "statement_rows"),
    "cells": ("fin_rev", "fin_wide", "statement_rows", "statement_values"),
}

_RANGE = re.compile(r"RANGE\[([^;\]]*);([^\]]*)\]")
_JSON = re.compile(r"JSON\[([^;\]]*);\s*([^\]]*)\]")
_LINES = re.compile(r"\(SELECT (\w+), (\w+), LINES\[text\]\)")
_MONEY = re.compile(r"MONEY\[([^\]]*)\]")
_TOTAL = re.compile(r"TOTAL\[([^\]]*)\]")
# Decimals add up to the same in any order; amounts that no decimal holds are added as doubles.
EXACT_TOTAL = (r"coalesce(CASE WHEN count(\1) = count(try_cast(\1 AS DECIMAL(38,8))) THEN CAST(try_sum(try_cast(\1 AS DECIMAL(38,8))) AS DOUBLE) END, sum(\1))")


def _chain(name: str) -> list[str]:
    return [*DEPENDS.get(name, ()), name]


def check_sql(*names: str) -> str:
    """The derived tables as common table expressions of the checking engine."""
    ordered: list[str] = []
    for name in names:
        ordered += [n for n in _chain(name) if n not in ordered]
    text = ",\n".join(f"{n} AS ({DERIVED[n].strip()})" for n in ordered)
    text = _RANGE.sub(r"unnest(generate_series(\1,\2))", text)
    text = _JSON.sub(r"json_extract_string(\1, '$.\2')", text)
    text = _LINES.sub(r"(SELECT \1, \2, unnest(range(len(l))) AS ln, unnest(l) AS line FROM "
                      r"(SELECT *, string_split(text, chr(10)) AS l FROM documents))", text)
    text = _TOTAL.sub(r"sum(\1)", _MONEY.sub(r"format('{:,.2f}', \1)", text))
    return text.replace(" DIV ", " // ")


@shared
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a scan with fewer splits than cores, spread by key before costly per-row work.

    A large table already has far more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > 2 * cores else df.repartition(cores, *keys)


@shared
def spread_derived(spark: SparkSession, sf_dir: str, name: str, base: str, key: str) -> DataFrame:
    """A row-by-row derived table, spread by key when the scan of its base table has fewer splits than cores."""
    cores = spark.sparkContext.defaultParallelism
    df = derived(spark, sf_dir, name)
    return df if table(spark, sf_dir, base).rdd.getNumPartitions() > 2 * cores else df.repartition(cores, key)


@shared
def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    text = ",\n".join(f"{n} AS ({DERIVED[n].strip()})" for n in _chain(name))
    text = _RANGE.sub(r"explode(sequence(\1,\2))", text)
    text = _JSON.sub(r"get_json_object(\1, '$.\2')", text)
    text = _LINES.sub(r"(SELECT \1, \2, posexplode(split(text, '\\n')) AS (ln, line) FROM documents)", text)
    text = _TOTAL.sub(EXACT_TOTAL, _MONEY.sub(r"format_number(\1, 2)", text))
    text = text.replace("{", "{{").replace("}", "}}")
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(f"WITH {text} SELECT * FROM {name}", **{t: table(spark, sf_dir, t) for t in used})

"""Ratios, scorecard and flags of every supplier treated as an issuer."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import exact_round, grade
from prospectra.operators import ratios as R
from prospectra.operators import statements as S
from prospectra.plans.inputs import FIN_ITEMS, check_sql, derived
from prospectra.plans.registry import Registry, shared


def long_facts(wide):
    """Long facts; items a period lacks are absent."""
    return (wide.unpivot(["doc_id", "period"], [F.col(i).cast("double").alias(i) for i in FIN_ITEMS], "item", "value")
            .where("value IS NOT NULL"))


def periods_of(wide):
    return wide.select("doc_id", "period", "full_year", "y", "m")


@shared
def facts(spark, sf):
    return long_facts(derived(spark, sf, "fin_wide"))


@shared
def periods(spark, sf):
    return periods_of(derived(spark, sf, "fin_wide"))


@shared
def profiles(spark, sf):
    return R.profile(facts(spark, sf), periods(spark, sf))


METRICS_SQL = f"""{check_sql('fin_wide')},
eb AS (SELECT *, profit_before_tax + finance_costs + depreciation - coalesce(other_income, 0) AS ebitda FROM fin_wide),
mt AS (SELECT *, revenue_from_operations AS revenue, profit_for_period AS pat,
  CASE WHEN revenue_from_operations <> 0 THEN ebitda / revenue_from_operations * 100 END AS ebitda_margin,
  CASE WHEN revenue_from_operations <> 0 THEN profit_for_period / revenue_from_operations * 100 END AS pat_margin,
  CASE WHEN full_year AND total_equity > 0 THEN profit_for_period / total_equity * 100 END AS roe,
  CASE WHEN full_year AND revenue_from_operations <> 0 THEN trade_receivables / revenue_from_operations * 365 END AS receivable_days,
  CASE WHEN full_year AND revenue_from_operations <> 0 THEN inventories / revenue_from_operations * 365 END AS inventory_days,
  CASE WHEN total_equity > 0 THEN borrowings / total_equity END AS debt_to_equity,
  CASE WHEN finance_costs <> 0 THEN (profit_before_tax + finance_costs) / finance_costs END AS interest_coverage,
  CASE WHEN total_current_liabilities <> 0 THEN total_current_assets / total_current_liabilities END AS current_ratio,
  CASE WHEN profit_for_period > 0 THEN operating_cash_flow / profit_for_period END AS cash_conversion,
  operating_cash_flow - abs(capex) AS free_cash_flow,
  CASE WHEN profit_before_tax > 0 THEN other_income / profit_before_tax * 100 END AS other_income_share FROM eb),
grown AS (SELECT *, CASE WHEN full_year THEN lag(revenue) OVER w END AS prev_revenue FROM mt WINDOW w AS (PARTITION BY doc_id, full_year ORDER BY y)),
m AS (SELECT *, CASE WHEN prev_revenue > 0 THEN (revenue / prev_revenue - 1) * 100 END AS revenue_growth FROM grown),
ends AS (SELECT doc_id, min(y) FILTER (full_year) AS fy, max(y) FILTER (full_year) AS ly, max(y) AS ty, count(*) FILTER (full_year) AS nf FROM m GROUP BY doc_id),
g0 AS (SELECT e.doc_id, e.nf, CASE WHEN nf >= 2 THEN ly - fy END AS years, a, b, t, a.period || '→' || b.period AS span,
  (SELECT string_agg(period, ', ' ORDER BY y DESC) FROM m WHERE m.doc_id = e.doc_id AND full_year AND pat < 0) AS loss_years,
  (SELECT string_agg(period, ', ' ORDER BY y DESC) FROM m WHERE m.doc_id = e.doc_id AND full_year AND operating_cash_flow < 0) AS outflow_years,
  (SELECT sum(pat) FROM m WHERE m.doc_id = e.doc_id AND full_year) AS total_pat,
  (SELECT sum(operating_cash_flow) FROM m WHERE m.doc_id = e.doc_id AND full_year) AS total_ocf
  FROM ends e LEFT JOIN m a ON a.doc_id = e.doc_id AND a.y = fy LEFT JOIN m b ON b.doc_id = e.doc_id AND b.y = ly JOIN m t ON t.doc_id = e.doc_id AND t.y = ty),
g AS (SELECT *, {', '.join(f"CASE WHEN a.{s} > 0 AND b.{s} > 0 AND years > 0 THEN (pow(b.{s} / a.{s}, 1.0 / years) - 1) * 100 END AS {s}_cagr" for s in V.GROWTH_SERIES)} FROM g0)"""

GRADE = "CASE WHEN {x} IS NULL THEN 'unknown' WHEN {x} >= {good} THEN 'positive' WHEN {x} < {bad} THEN 'negative' ELSE 'neutral' END"
SCORECARD_SQL = f"""{METRICS_SQL},
card AS (
SELECT doc_id, 1 AS ord, 'growth' AS dimension, {GRADE.format(x='revenue_cagr', good=15, bad=5)} AS signal,
  coalesce('Revenue ' || CASE WHEN revenue_cagr >= 0 THEN 'grew ' ELSE 'shrank ' END || printf('%.1f', abs(revenue_cagr)) || '% a year (' || span || ')',
    'Not enough full years to measure revenue growth') AS reason FROM g
UNION ALL SELECT doc_id, 2, 'profitability', CASE WHEN a.ebitda_margin IS NULL OR b.ebitda_margin IS NULL THEN 'unknown'
    WHEN b.pat < 0 OR b.ebitda_margin - a.ebitda_margin <= -3 THEN 'negative' WHEN loss_years IS NULL AND b.ebitda_margin - a.ebitda_margin >= 1 THEN 'positive' ELSE 'neutral' END,
  coalesce('EBITDA margin ' || printf('%.1f', a.ebitda_margin) || '% → ' || printf('%.1f', b.ebitda_margin) || '% (' || span || '); '
    || coalesce('losses in ' || loss_years, 'profitable every year'), 'Margins couldn''t be calculated') FROM g
UNION ALL SELECT doc_id, 3, 'leverage', CASE WHEN t.debt_to_equity IS NULL THEN 'unknown' WHEN t.debt_to_equity > 1.5 OR b.interest_coverage < 2 THEN 'negative'
    WHEN t.debt_to_equity <= 0.5 AND (b.interest_coverage IS NULL OR b.interest_coverage >= 3) THEN 'positive' ELSE 'neutral' END,
  coalesce('Debt to equity ' || printf('%.2f', t.debt_to_equity) || 'x (' || t.period || ')' || coalesce('; operating profit covers interest ' || printf('%.1f', b.interest_coverage)
    || 'x (' || b.period || ')', ''), 'Debt to equity couldn''t be calculated') FROM g
UNION ALL SELECT doc_id, 4, 'liquidity', {GRADE.format(x='t.current_ratio', good=1.5, bad=1.0)},
  coalesce('Current ratio ' || printf('%.2f', t.current_ratio) || 'x (' || t.period || ')', 'Current ratio couldn''t be calculated') FROM g
UNION ALL SELECT doc_id, 5, 'cash_conversion', CASE WHEN outflow_years IS NOT NULL THEN 'negative' WHEN total_pat > 0 THEN {GRADE.format(x='(total_ocf / total_pat)', good=0.8, bad=0.5)} ELSE 'positive' END,
  CASE WHEN outflow_years IS NOT NULL THEN 'Operating cash flow was negative in ' || outflow_years
    WHEN total_pat > 0 THEN 'Operating cash flow was ' || printf('%.2f', total_ocf / total_pat) || 'x profit after tax over ' || span
    ELSE 'Operating cash flow was positive every year despite accounting losses' END FROM g
UNION ALL SELECT doc_id, 6, 'working_capital', CASE WHEN greatest(b.receivable_days - a.receivable_days, b.inventory_days - a.inventory_days) >= 20 OR b.receivable_days >= 120 THEN 'negative'
    WHEN greatest(b.receivable_days - a.receivable_days, b.inventory_days - a.inventory_days) <= 5 THEN 'positive' ELSE 'neutral' END,
  'Receivable days ' || printf('%.0f', a.receivable_days) || ' → ' || printf('%.0f', b.receivable_days) || '; inventory days ' || printf('%.0f', a.inventory_days) || ' → '
    || printf('%.0f', b.inventory_days) || ' (' || span || ')' FROM g
UNION ALL SELECT doc_id, 7, 'returns', {GRADE.format(x='b.roe', good=15, bad=8)},
  coalesce('Return on equity ' || printf('%.1f', b.roe) || '% (' || b.period || ')', 'Return on equity couldn''t be calculated') FROM g)"""

_JUMP_PARTS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS item_no, '{name}' AS name, period AS newer, y, total_assets AS assets, {item} AS nb, lag({item}) OVER w AS na, lag(period) OVER w AS older "
    f"FROM m {'WHERE full_year' if item in V.FLOW_ITEMS else ''} WINDOW w AS (PARTITION BY doc_id ORDER BY y)"
    for i, (item, name) in enumerate(V.JUMP_ITEMS.items()))
JUMPS_SQL = f"""moves AS ({_JUMP_PARTS}),
sharp AS (SELECT *, nb / na AS ratio FROM moves WHERE na > 0 AND nb > 0 AND (nb / na >= 3 OR nb / na <= 1.0 / 3) AND abs(nb - na) >= 0.05 * assets),
jumps AS (SELECT doc_id, y, 'Unusual changes from ' || older || ' to ' || newer || ': ' || string_agg(name || CASE WHEN ratio > 1 THEN ' up ' || printf('%.1f', ratio) || 'x'
    ELSE ' down ' || printf('%.0f', (1 - ratio) * 100) || '%' END || ' (₹' || format('{{:,.1f}}', na) || ' m → ₹' || format('{{:,.1f}}', nb) || ' m)', '; ' ORDER BY item_no)
    || '. Worth checking in the notes to the accounts' AS message FROM sharp GROUP BY doc_id, y, older, newer)"""

FLAGS_SQL = f"""{METRICS_SQL}, {JUMPS_SQL},
per AS (SELECT doc_id, string_agg(CASE WHEN pat < 0 THEN period || ' (₹' || format('{{:,.1f}}', pat) || ' m)' END, ', ' ORDER BY y DESC) AS loss_list,
  string_agg(CASE WHEN operating_cash_flow < 0 THEN period || ' (₹' || format('{{:,.1f}}', operating_cash_flow) || ' m)' END, ', ' ORDER BY y DESC) AS outflow_list,
  bool_or(operating_cash_flow < 0 AND full_year) AS outflow_full,
  string_agg(CASE WHEN full_year AND other_income_share >= 25 THEN printf('%.0f', other_income_share) || '% in ' || period END, ', ' ORDER BY y DESC) AS heavy_list
  FROM m GROUP BY doc_id),
raw AS (
SELECT doc_id, 1.0 AS o, 'red' AS severity, 'losses' AS code, 'Net loss in ' || loss_list AS message FROM per WHERE loss_list IS NOT NULL
UNION ALL SELECT doc_id, 2, CASE WHEN outflow_full THEN 'red' ELSE 'amber' END, 'negative_cash_flow', 'Operating cash flow was negative in ' || outflow_list FROM per WHERE outflow_list IS NOT NULL
UNION ALL SELECT doc_id, 3, 'amber', 'weak_cash_conversion', 'Only ' || printf('%.0f', total_ocf / total_pat * 100) || '% of profit after tax turned into operating cash (' || span || ')'
  FROM g JOIN per USING (doc_id) WHERE outflow_list IS NULL AND total_pat > 0 AND total_ocf / total_pat < 0.5
UNION ALL SELECT doc_id, 4, CASE WHEN b.ebitda_margin - a.ebitda_margin <= -6 THEN 'red' ELSE 'amber' END, 'falling_margin', 'EBITDA margin fell from ' || printf('%.1f', a.ebitda_margin)
  || '% (' || a.period || ') to ' || printf('%.1f', b.ebitda_margin) || '% (' || b.period || ')' FROM g WHERE b.ebitda_margin - a.ebitda_margin <= -3
UNION ALL SELECT doc_id, 5, CASE WHEN t.debt_to_equity > 1.5 THEN 'red' ELSE 'amber' END, 'high_debt', 'Debt is ' || printf('%.2f', t.debt_to_equity) || 'x equity (' || t.period || ')' FROM g WHERE t.debt_to_equity > 1.0
UNION ALL SELECT doc_id, 6, 'amber', 'rising_debt', CASE WHEN t.debt_to_equity - a.debt_to_equity >= 0.3
    THEN 'Debt to equity rose from ' || printf('%.2f', a.debt_to_equity) || 'x (' || a.period || ') to ' || printf('%.2f', t.debt_to_equity) || 'x (' || t.period || ')'
    ELSE 'Borrowings grew ' || printf('%.1f', borrowings_cagr) || '% a year, faster than revenue''s ' || printf('%.1f', revenue_cagr) || '% (' || span || ')' END
  FROM g WHERE t.debt_to_equity - a.debt_to_equity >= 0.3 OR borrowings_cagr - revenue_cagr >= 10
UNION ALL SELECT doc_id, 7, CASE WHEN b.interest_coverage < 1.5 THEN 'red' ELSE 'amber' END, 'low_interest_cover', 'Operating profit covered interest only ' || printf('%.1f', b.interest_coverage)
  || 'x in ' || b.period FROM g WHERE b.interest_coverage < 2
UNION ALL SELECT doc_id, 8, 'amber', 'low_liquidity', 'Current liabilities exceed current assets (current ratio ' || printf('%.2f', t.current_ratio) || 'x, ' || t.period || ')' FROM g WHERE t.current_ratio < 1
UNION ALL SELECT doc_id, 9, 'amber', 'receivables_outpacing_revenue', 'Trade receivables grew ' || printf('%.1f', trade_receivables_cagr) || '% a year against revenue''s ' || printf('%.1f', revenue_cagr)
  || '%, so customers took ' || printf('%.0f', a.receivable_days) || ' → ' || printf('%.0f', b.receivable_days) || ' days to pay (' || span || '): check how revenue is recognised'
  FROM g WHERE trade_receivables_cagr - revenue_cagr >= 10 AND b.receivable_days - a.receivable_days >= 10
UNION ALL SELECT doc_id, 10, 'amber', 'slow_collections', 'Customers take about ' || printf('%.0f', b.receivable_days) || ' days to pay (' || b.period || ')' FROM g WHERE b.receivable_days >= 120
UNION ALL SELECT doc_id, 11, 'amber', 'other_income_dependence', 'Other income was a large share of profit before tax: ' || heavy_list FROM per WHERE heavy_list IS NOT NULL
UNION ALL SELECT doc_id, 12 + (3000 - y) / 10000.0, 'amber', 'unusual_jump', message FROM jumps),
flags AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY severity <> 'red', o) AS INT) AS ord, severity, code, message FROM raw)"""

METRIC_ROWS_SQL = " UNION ALL ".join(
    f"SELECT doc_id, period, full_year, y, '{x}' AS metric, {i} AS metric_no, CAST(printf('%.2f', {x}) AS DOUBLE) + 0.0 AS value FROM m" for i, x in enumerate(V.METRICS))


def register(r: Registry) -> None:
    r.add("pivot_items", lambda spark, sf: R.pivot_items(facts(spark, sf)).select(
        "doc_id", "period", *[F.round(F.col(i), 6).alias(i) for i in R.ITEMS]), f"""
        WITH {check_sql('fin_wide')} SELECT doc_id, period, {', '.join(f'round({i}, 6) AS {i}' for i in R.ITEMS)} FROM fin_wide""")
    shown = [x for x in V.METRICS if x != "revenue_growth"]
    r.add("period_metrics", lambda spark, sf: R.period_metrics(R.pivot_items(facts(spark, sf)).join(
        periods(spark, sf), ["doc_id", "period"])).select("doc_id", "period", *[exact_round(F.col(x), 2).alias(x) for x in shown]), f"""
        WITH {METRICS_SQL} SELECT doc_id, period, {', '.join(f"CAST(printf('%.2f', {x}) AS DOUBLE) + 0.0 AS {x}" for x in shown)} FROM m""")
    r.add("revenue_growth", lambda spark, sf: R.revenue_growth(profiles(spark, sf)).withColumn(
        "revenue_growth", exact_round(F.col("revenue_growth"), 2)), f"""
        WITH {METRICS_SQL} SELECT doc_id, period, CAST(printf('%.2f', revenue_growth) AS DOUBLE) + 0.0 AS revenue_growth FROM m WHERE prev_revenue IS NOT NULL""")
    r.add("growth_rates", lambda spark, sf: R.growth_rates(profiles(spark, sf)), f"""
        WITH {METRICS_SQL} SELECT doc_id, a.period AS from_period, b.period AS to_period, years,
          {', '.join(f"CAST(printf('%.2f', {s}_cagr) AS DOUBLE) + 0.0 AS {s}_cagr" for s in V.GROWTH_SERIES)} FROM g WHERE years IS NOT NULL""")
    r.add("grades", lambda spark, sf: R.period_metrics(R.pivot_items(facts(spark, sf)).join(periods(spark, sf), ["doc_id", "period"])).select(
        "doc_id", "period", grade(F.col("roe"), 15, 8).alias("roe"), grade(F.negative("debt_to_equity"), -0.5, -1.5).alias("debt")), f"""
        WITH {METRICS_SQL} SELECT doc_id, period, {GRADE.format(x='roe', good=15, bad=8)} AS roe, CASE WHEN debt_to_equity IS NULL THEN 'unknown'
          WHEN debt_to_equity <= 0.5 THEN 'positive' WHEN debt_to_equity > 1.5 THEN 'negative' ELSE 'neutral' END AS debt FROM m""")
    r.add("scorecard", lambda spark, sf: R.scorecard(profiles(spark, sf)), f"WITH {SCORECARD_SQL} SELECT doc_id, ord, dimension, signal, reason FROM card")
    r.add("financial_flags", lambda spark, sf: R.financial_flags(profiles(spark, sf)).drop("metrics"),
          f"WITH {FLAGS_SQL} SELECT doc_id, ord, severity, code, message FROM flags")
    r.add("unusual_jumps", lambda spark, sf: R.unusual_jumps(profiles(spark, sf)).select("doc_id", "ord", "message"), f"""
        WITH {METRICS_SQL}, {JUMPS_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y DESC) AS INT) AS ord, message FROM jumps""")
    r.add("metric_table", lambda spark, sf: R.metric_table(profiles(spark, sf)), f"""
        WITH {METRICS_SQL}, long AS ({METRIC_ROWS_SQL}),
        placed AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY NOT full_year, CASE WHEN full_year THEN y ELSE -y END) AS place,
           count(value) OVER (PARTITION BY doc_id, metric) AS n FROM long)
        SELECT doc_id, metric, CAST(place AS INT) AS place, period, value FROM placed WHERE n > 0""")
    r.add("holding_signal", lambda spark, sf: derived(spark, sf, "promoters").select(
        "doc_id", R.holding_level(F.col("holding_pct")).alias("level")), f"""
        WITH {check_sql('promoters')} SELECT doc_id, CASE WHEN holding_pct IS NULL THEN 'unknown' WHEN holding_pct >= 50 THEN 'high'
          WHEN holding_pct >= 26 THEN 'moderate' ELSE 'low' END AS level FROM promoters""")

    # checks on the extracted facts
    r.add("missing_items", lambda spark, sf: S.missing_items(facts(spark, sf).select("doc_id", "item")), f"""
        WITH {check_sql('fin_wide')}, present AS (UNPIVOT (SELECT doc_id, {', '.join(FIN_ITEMS)} FROM fin_wide) ON {', '.join(FIN_ITEMS)} INTO NAME item VALUE v),
        expected(item) AS (VALUES {', '.join(f"('{i}')" for s in V.LINE_ITEMS.values() for i in s)})
        SELECT d.doc_id, e.item FROM (SELECT DISTINCT doc_id FROM present) d, expected e
        WHERE (d.doc_id, e.item) NOT IN (SELECT doc_id, item FROM present)""")
    r.add("identity_check", lambda spark, sf: S.identity_check(R.pivot_items(facts(spark, sf))).select("doc_id", "period"), f"""
        WITH {check_sql('fin_wide')} SELECT doc_id, period FROM fin_wide WHERE total_income <> 0
          AND abs(total_income - (revenue_from_operations + other_income)) / abs(total_income) > 0.01""")
    r.add("net_worth", lambda spark, sf: S.net_worth(facts(spark, sf), periods(spark, sf)).withColumn("net_worth", F.round("net_worth", 6)), f"""
        WITH {check_sql('fin_wide')} SELECT doc_id, round(arg_max(total_equity, y), 6) AS net_worth FROM fin_wide GROUP BY doc_id""")

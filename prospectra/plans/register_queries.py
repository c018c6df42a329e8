"""Risk register, legal cases, offers and grounding over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.text import figures
from prospectra.operators import grounding as G
from prospectra.operators import legal as L
from prospectra.operators import offer as O
from prospectra.operators import register as R
from prospectra.operators import statements as S
from prospectra.operators.ordered import id_bucket, position
from prospectra.plans.inputs import check_sql, derived, spread, spread_derived, table
from prospectra.plans.ratio_queries import facts, periods
from prospectra.plans.registry import Registry, shared

# ------------------------------------------------------------------ risk register
ON = ["item_id"]


@shared
def headings(spark, sf):
    """Documents as numbered headings; a source is a prospectus."""
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id").select(
        F.substring("source", F.lit(4), F.lit(9)).cast("long").alias("doc_id"), F.col("doc_id").alias("item_id"), "text")
    numbered = position(d, ["doc_id"], [id_bucket(F.col("item_id"))], [F.col("item_id")], "number")
    return numbered.withColumn("page", (F.col("number") + 20).cast("int"))


@shared
def register_of(spark, sf):
    return R.build_register(headings(spark, sf), derived(spark, sf, "risk_answers"), ON)


@shared
def ranked_register(spark, sf):
    return R.rank_register(register_of(spark, sf))


SHORT = "array_to_string(string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' ')[1:14], ' ') || CASE WHEN len(string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' ')) > 14 THEN '…' ELSE '' END"
FIGS = "list_transform(regexp_extract_all({t}, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda z: replace(z, ',', ''))"


def unsupported_sql(claimed: str, source: str) -> str:
    """Claimed figures without a near value among the source figures."""
    return (f"list_filter({claimed}, lambda f: length(f) > 1 AND NOT coalesce(list_bool_or(list_transform({source}, lambda v: "
            f"abs(CAST(v AS DOUBLE) - CAST(f AS DOUBLE)) < pow(10.0, -(CASE WHEN contains(f, '.') THEN length(string_split(f, '.')[2]) ELSE 0 END)))), FALSE))")


HEADINGS_SQL = """headings AS (SELECT CAST(substr(source, 4) AS BIGINT) AS doc_id, doc_id AS item_id, text,
  row_number() OVER (PARTITION BY source ORDER BY documents.doc_id) AS number FROM documents)"""
REGISTER_SQL = f"""{HEADINGS_SQL}, {check_sql('risk_answers')},
reg0 AS (SELECT h.*, CAST(number + 20 AS INT) AS page, a.score, a.category, a.headline AS said FROM headings h LEFT JOIN risk_answers a USING (item_id)),
reg AS (SELECT doc_id, item_id, text, number, page, score, category, CASE WHEN score >= 4 THEN 'high' WHEN score = 3 THEN 'medium' WHEN score IS NOT NULL THEN 'low' END AS severity,
  CASE WHEN score IS NULL OR len({unsupported_sql(FIGS.format(t='said'), FIGS.format(t='text'))}) > 0 THEN {SHORT.format(t='text')} ELSE trim(said) END AS headline FROM reg0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(score, 0) DESC, number) AS rank FROM reg),
counts AS (SELECT doc_id, count(*) AS total, {', '.join(f"count(*) FILTER (score = {s}) AS score_{s}" for s in (5, 4, 3, 2, 1))},
  {', '.join(f"count(*) FILTER (severity = '{s}') AS severity_{s}" for s in ('high', 'medium', 'low'))},
  {', '.join(f"count(*) FILTER (category = '{c}') AS category_{c}" for c in V.RISK_CATEGORIES)},
  CAST(printf('%.2f', sum(score) / count(score)) AS DOUBLE) AS average_score FROM reg GROUP BY doc_id)"""

# ------------------------------------------------------------------ legal
def shown():
    return F.sequence(F.lit(300), F.lit(307))


@shared
def records(spark, sf):
    return L.case_records(spread_derived(spark, sf, "cases", "events", "ord"), shown())


@shared
def marked_cases(spark, sf):
    return L.mark_totals(L.dedupe_cases(records(spark, sf)))


@shared
def issuer_worth(spark, sf):
    return S.net_worth(facts(spark, sf), periods(spark, sf))


@shared
def legal_summary(spark, sf):
    return L.case_summary(marked_cases(spark, sf), issuer_worth(spark, sf))


_PARTY_LEVEL = " ".join(f"CASE WHEN regexp_matches(lv, '{p.replace('(?i)', '')}', 'i') THEN '{party}' END," for party, p in V.HEADING_PARTIES.items()).rstrip(",")
CASES_SQL = f"""{check_sql('cases')},
lv AS (SELECT doc_id, ord, i, list_filter([{_PARTY_LEVEL}], lambda n: n IS NOT NULL) AS named FROM (
   SELECT doc_id, ord, unnest(string_split(heading, '>')) AS lv, unnest(range(len(string_split(heading, '>')))) AS i FROM cases)),
nr AS (SELECT doc_id, ord, arg_max(named, i) AS named FROM lv WHERE len(named) > 0 GROUP BY ALL),
cr AS (SELECT c.doc_id, c.ord, trim(heading) AS heading, CASE WHEN len(named) = 1 OR named[1] = 'director' THEN named[1] ELSE party END AS party,
  CASE WHEN type IN ('tax', 'regulatory', 'sebi_disciplinary') THEN TRUE
    ELSE coalesce(lower(regexp_extract_all(heading, '(?i)\\b(?:against|by)\\b')[-1]) = 'against', against_party) END AS against_party,
  type, total_row, CAST(greatest(count, 1) AS BIGINT) AS count, amount, unit, page, trim(summary) AS summary,
  len({unsupported_sql("[printf('%.4f', amount)]", FIGS.format(t='source_text')).replace('length(f) > 1', 'TRUE')}) = 0 AS found
  FROM cases c LEFT JOIN nr USING (doc_id, ord)),
rec AS (SELECT doc_id, ord, heading, party, against_party, type, total_row, count, summary, CASE WHEN page BETWEEN 300 AND 307 THEN page ELSE 300 END AS page,
  CAST(printf('%.3f', CASE WHEN found THEN amount * CASE unit WHEN 'rupees' THEN 1e-6 WHEN 'thousand' THEN 1e-3 WHEN 'lakh' THEN 0.1E0 WHEN 'million' THEN 1.0E0 WHEN 'crore' THEN 10.0E0 END END) AS DOUBLE) + 0.0 AS amount_million,
  CASE WHEN amount IS NOT NULL AND NOT found THEN 'amount not on its pages' WHEN amount IS NOT NULL AND unit IS NULL THEN 'amount without unit' END AS warning FROM cr),
dd AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY doc_id, party, against_party, type, amount_million, CASE WHEN amount_million IS NULL THEN lower(left(summary, 30)) END ORDER BY ord) = 1),
mk AS (SELECT *, NOT total_row AND bool_or(total_row) OVER (PARTITION BY doc_id, party, type) AS in_total_row FROM dd),
ck AS (SELECT *, against_party AND party IN ('company', 'subsidiary', 'promoter', 'director') AND NOT in_total_row AS counted FROM mk),
sm AS (SELECT ck.doc_id, {', '.join(f"CAST(coalesce(sum(count) FILTER (counted AND type = '{t}'), 0) AS BIGINT) AS n_{t}, CAST(printf('%.2f', CAST(coalesce(sum(CAST(amount_million AS DECIMAL(28,3))) FILTER (counted AND type = '{t}'), 0) AS DOUBLE)) AS DOUBLE) AS amount_{t}" for t in V.CASE_TYPES)},
  CAST(printf('%.2f', CAST(coalesce(sum(CAST(amount_million AS DECIMAL(28,3))) FILTER (counted), 0) AS DOUBLE)) AS DOUBLE) AS total_amount,
  CAST(coalesce(sum(count) FILTER (NOT against_party AND NOT in_total_row), 0) AS BIGINT) AS filed_by_parties FROM ck GROUP BY ck.doc_id),
nw AS (SELECT doc_id, arg_max(total_equity, y) AS net_worth FROM fin_wide GROUP BY doc_id),
summ AS (SELECT sm.*, net_worth, CASE WHEN net_worth > 0 THEN CAST(printf('%.1f', total_amount / net_worth * 100) AS DOUBLE) END AS pct_of_net_worth
  FROM sm LEFT JOIN nw ON nw.doc_id = sm.doc_id)"""
LEGAL_SQL = f"{check_sql('fin_wide')}, {CASES_SQL}"
LEGAL_FLAGS_SQL = f"""{LEGAL_SQL}, {check_sql('approvals')},
lj AS (SELECT summ.*, a.n_pending, a.n_not_applied, a.all_material_obtained FROM summ LEFT JOIN approvals a ON a.doc_id = summ.doc_id),
lr AS (SELECT doc_id, 1 AS o, 'red' AS severity, 'criminal_cases' AS code, n_criminal || ' criminal proceeding(s) against the company, its promoters or directors' AS message FROM lj WHERE n_criminal > 0
 UNION ALL SELECT doc_id, 2, 'red', 'sebi_action', 'Disciplinary action by SEBI or a stock exchange against the promoters' FROM lj WHERE n_sebi_disciplinary > 0
 UNION ALL SELECT doc_id, 3, 'amber', 'regulatory_actions', n_regulatory || ' action(s) by regulators or statutory authorities' FROM lj WHERE n_regulatory > 0
 UNION ALL SELECT doc_id, 4, CASE WHEN pct_of_net_worth >= 25 THEN 'red' ELSE 'amber' END, 'large_claims', 'Claims against the company, promoters and directors total ₹' || format('{{:,.1f}}', total_amount) || ' m, ' || printf('%g', pct_of_net_worth) || '% of net worth' FROM lj WHERE pct_of_net_worth >= 10
 UNION ALL SELECT doc_id, 5, 'info', 'tax_cases', n_tax || ' tax proceeding(s) involving ₹' || format('{{:,.1f}}', amount_tax) || ' m' FROM lj WHERE n_tax > 0
 UNION ALL SELECT doc_id, 6, 'amber', 'approvals_not_applied', n_not_applied || ' required approval(s) not yet applied for' FROM lj WHERE n_not_applied > 0
 UNION ALL SELECT doc_id, 7, 'info', 'approvals_pending', n_pending || ' approval(s) applied for but not yet received' FROM lj WHERE n_pending > 0
 UNION ALL SELECT doc_id, 8, 'amber', 'approvals_missing', 'The document says some material approvals are missing' FROM lj WHERE NOT all_material_obtained),
lflags AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) AS INT) AS ord, severity, code, message FROM lr)"""

# ------------------------------------------------------------------ offers
PCT = "CASE WHEN {b} <> 0 THEN CAST(printf('%.1f', {a} / {b} * 100) AS DOUBLE) + 0.0 END"


@shared
def metrics(spark, sf):
    return O.offer_metrics(derived(spark, sf, "offers"), derived(spark, sf, "objects"))


OFFERS_SQL = f"""{check_sql('offers', 'objects')},
ob AS (SELECT doc_id, sum(amount) FILTER (NOT general_purposes) AS stated, sum(amount) FILTER (NOT general_purposes AND regexp_matches(purpose, 'repay|prepay|borrowing|loan|debt', 'i')) AS debt,
  sum(amount) FILTER (general_purposes) AS general FROM objects GROUP BY doc_id),
of0 AS (SELECT o.*, fresh_issue_amount * f AS fresh, stated * f AS specified, general * f AS gcp, CASE WHEN debt <> 0 THEN debt * f END AS debt FROM (
   SELECT *, CASE amount_unit WHEN 'million' THEN 1.0E0 WHEN 'lakh' THEN 0.1E0 ELSE 10.0E0 END AS f FROM offers) o LEFT JOIN ob ON ob.doc_id = o.doc_id),
om AS (SELECT *, {PCT.format(a='specified', b='fresh')} AS specified_pct, {PCT.format(a='(fresh - specified)', b='fresh')} AS unspecified_pct, {PCT.format(a='gcp', b='fresh')} AS gcp_pct,
  {PCT.format(a='debt', b='specified')} AS debt_pct, {PCT.format(a='offer_for_sale_shares', b='(fresh_issue_shares + offer_for_sale_shares)')} AS offer_for_sale_pct,
  {PCT.format(a='fresh_issue_shares', b='shares_after_offer')} AS dilution_pct FROM of0)"""
OFFER_FLAGS_SQL = f"""{OFFERS_SQL},
orr AS (SELECT doc_id, 1 AS o, CASE WHEN offer_for_sale_pct >= 50 THEN 'amber' ELSE 'info' END AS severity, CASE WHEN offer_for_sale_pct >= 50 THEN 'mostly_offer_for_sale' ELSE 'offer_for_sale' END AS code,
   printf('%g', offer_for_sale_pct) || '% of the shares on offer are sold by existing shareholders' || CASE WHEN offer_for_sale_pct >= 50 THEN '; that money goes to them, not the company' ELSE '' END AS message FROM om WHERE offer_for_sale_pct <> 0
 UNION ALL SELECT doc_id, 2, 'amber', 'promoters_selling', 'Promoters or the promoter group are selling shares in the offer' FROM om WHERE promoters_selling
 UNION ALL SELECT doc_id, 3, 'amber', 'vague_use_of_proceeds', printf('%g', gcp_pct) || '% of the fresh issue is for general corporate purposes, which needn''t be specified' FROM om WHERE gcp_pct > 20
 UNION ALL SELECT doc_id, 4, 'amber', 'vague_use_of_proceeds', 'Up to ' || printf('%g', unspecified_pct) || '% of the fresh issue isn''t tied to a stated object (general corporate purposes plus issue expenses)' FROM om WHERE gcp_pct IS NULL AND unspecified_pct > 20
 UNION ALL SELECT doc_id, 5, 'info', 'mostly_debt_repayment', printf('%g', debt_pct) || '% of the stated uses repay borrowings: this lowers interest costs rather than funding growth' FROM om WHERE debt_pct >= 50
 UNION ALL SELECT doc_id, 6, 'info', 'dilution', 'New shares will make up ' || printf('%g', dilution_pct) || '% of all shares after the offer' FROM om WHERE dilution_pct IS NOT NULL),
oflags AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) AS INT) AS ord, severity, code, message FROM orr)"""
GROUNDED = ("fresh_issue_amount", "fresh_issue_shares", "offer_for_sale_shares", "shares_before_offer", "shares_after_offer",
            "general_corporate_purposes_amount")
GROUND_TEXT = {f: ("printf('%.4f', {f})" if f.endswith("_amount") else "CAST({f} AS VARCHAR)").format(f=f) for f in GROUNDED}
GROUND_OK = {f: f"len({unsupported_sql(f'[{t}]', FIGS.format(t='source_text'))}) = 0" for f, t in GROUND_TEXT.items()}
GROUND_SQL = f"""{check_sql('offer_answers')}, gk AS (SELECT *, {', '.join(f'{c} AS ok_{f}' for f, c in GROUND_OK.items())} FROM offer_answers)"""
OBJECT_OK = f"len({unsupported_sql("[printf('%.4f', amount)]", FIGS.format(t='source_text'))}) = 0"


def register(r: Registry) -> None:
    shown = ["doc_id", "item_id", "number", "page", "score", "category", "severity", "headline"]
    r.add("build_register", lambda spark, sf: register_of(spark, sf).select(*shown), f"WITH {REGISTER_SQL} SELECT {', '.join(shown)} FROM reg")
    r.add("restore_headlines", lambda spark, sf: headings(spark, sf).join(derived(spark, sf, "risk_answers"), ON).select(
        "item_id", R.restored_headline(F.trim("headline"), F.col("text")).alias("headline")),
        f"WITH {REGISTER_SQL} SELECT item_id, headline FROM reg WHERE score IS NOT NULL")
    r.add("rank_register", lambda spark, sf: ranked_register(spark, sf).select("doc_id", "number", "score", "rank"),
          f"WITH {REGISTER_SQL} SELECT doc_id, number, score, rank FROM ranked")
    r.add("risk_counts", lambda spark, sf: R.risk_counts(register_of(spark, sf)), f"WITH {REGISTER_SQL} SELECT * FROM counts")
    r.add("filter_register", lambda spark, sf: R.filter_register(register_of(spark, sf), "high", "litigation").select("doc_id", "number", "headline"),
          f"WITH {REGISTER_SQL} SELECT doc_id, number, headline FROM reg WHERE severity = 'high' AND category = 'litigation'")
    for name, n in (("top_risks_report", 8), ("top_risks_chat", 6)):
        r.add(name, lambda spark, sf, n=n: R.top_risks(register_of(spark, sf), n).select("doc_id", "place", "number", "score"), f"""
            WITH {REGISTER_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, number) AS INT) AS place, number, score
            FROM reg WHERE score >= 4 QUALIFY place <= {n}""")
    r.add("unanswered_items", lambda spark, sf: R.unanswered(headings(spark, sf), derived(spark, sf, "risk_answers"), ON).select("doc_id", "number"),
          f"WITH {REGISTER_SQL} SELECT doc_id, number FROM reg WHERE score IS NULL")
    r.add("wanted_answers", lambda spark, sf: R.wanted_answers(derived(spark, sf, "risk_answers").withColumn(
        "item_id", F.col("item_id") * 2), headings(spark, sf), ON).select("item_id", "score"), f"""
        WITH {check_sql('risk_answers')} SELECT item_id * 2 AS item_id, score FROM risk_answers WHERE item_id * 2 IN (SELECT doc_id FROM documents)""")
    r.add("missing_numbers", lambda spark, sf: missing_numbers_of(spark, sf), """
        WITH found AS (SELECT CAST(substr(source, 4) AS BIGINT) AS doc_id, n_chars AS number FROM documents),
        last AS (SELECT doc_id, max(number) AS n FROM found GROUP BY doc_id)
        SELECT doc_id, number FROM (SELECT doc_id, unnest(generate_series(1, n)) AS number FROM last) AS listed ANTI JOIN found USING (doc_id, number)""")
    r.add("balanced_split", lambda spark, sf: R.balanced_split(headings(spark, sf), 7).select("doc_id", "number", "batch"), f"""
        WITH {HEADINGS_SQL}, run AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running,
           sum(length(text)) OVER (PARTITION BY doc_id) AS total FROM headings)
        SELECT doc_id, number, CAST(least(floor(running / (total / 7)), 6) AS BIGINT) AS batch FROM run""")
    r.add("fewest_batches", lambda spark, sf: R.fewest_batches(headings(spark, sf)), f"""
        WITH {HEADINGS_SQL}, c AS (SELECT doc_id, number, text AS t, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running,
           sum(length(text)) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS n FROM headings),
        p AS (SELECT *, (length(t) - length(regexp_replace(t, '[^0-9]', '', 'g'))) // 4 + length(regexp_replace(t, '[^0-9]', '', 'g')) + 1 + 40 AS cost FROM c),
        x AS (SELECT *, unnest(generate_series(1, n)) AS parts FROM p),
        b AS (SELECT doc_id, parts, least(floor(running / (total / parts)), parts - 1) AS batch, sum(cost) AS used FROM x GROUP BY ALL),
        f AS (SELECT doc_id, parts FROM b GROUP BY ALL HAVING max(used) <= 5900)
        SELECT doc_id, min(parts) AS parts, NULL::VARCHAR AS reason FROM f GROUP BY doc_id
        UNION ALL SELECT doc_id, NULL, 'heading too long' FROM p GROUP BY doc_id HAVING max(cost) > 5900""")

    # grounding
    def claims(spark, sf):
        d = table(spark, sf, "documents")
        said = d.select("doc_id", figures(F.col("text")).alias("claimed"))
        source = d.select((F.col("doc_id") - 1).alias("doc_id"), G.known_values(F.col("text")).alias("known"))
        return said.join(source, "doc_id").select("doc_id", F.explode(G.unsupported(F.col("claimed"), F.col("known"))).alias("figure"))

    r.add("unsupported_figures", claims, f"""
        SELECT d.doc_id, unnest({unsupported_sql(FIGS.format(t='d.text'), FIGS.format(t='s.text'))}) AS figure
        FROM documents d JOIN documents s ON s.doc_id = d.doc_id + 1""")
    r.add("number_in", lambda spark, sf: derived(spark, sf, "cases").where("amount IS NOT NULL").select(
        "doc_id", "ord", G.number_in(F.col("amount") + (F.col("ord") % 4) / 100000, F.col("source_text")).alias("found")), f"""
        WITH {check_sql('cases')}, n AS (SELECT *, rtrim(rtrim(printf('%.4f', amount + (ord % 4) / 100000.0), '0'), '.') AS t FROM cases WHERE amount IS NOT NULL)
        SELECT doc_id, ord, len({unsupported_sql('[t]', FIGS.format(t='source_text'))}) = 0 AS found FROM n""")

    def citing(spark, sf):
        b = derived(spark, sf, "blocks").groupBy("doc_id").agg(F.collect_set(F.col("page")).alias("shown"))
        c = derived(spark, sf, "cases").select("doc_id", "ord", F.array(F.col("page") % 9, F.col("ord") % 7, F.col("page") % 9).alias("cited"))
        kept, warning = G.valid_citations(F.col("cited"), F.col("shown"))
        return c.join(b, "doc_id").select("doc_id", "ord", F.array_join(kept, ",").alias("pages"), warning.alias("warning"))

    r.add("valid_citations", citing, f"""
        WITH {check_sql('blocks', 'cases')}, shown AS (SELECT DISTINCT doc_id, page FROM blocks),
        c AS (SELECT DISTINCT doc_id, ord, unnest([page % 9, ord % 7]) AS p FROM cases),
        k AS (SELECT c.doc_id, c.ord, count(*) AS cited, count(s.page) AS kept, string_agg(CASE WHEN s.page IS NOT NULL THEN CAST(p AS VARCHAR) END, ',' ORDER BY p) AS pages
          FROM c LEFT JOIN shown s ON s.doc_id = c.doc_id AND s.page = c.p GROUP BY ALL)
        SELECT doc_id, ord, coalesce(pages, '') AS pages, CASE WHEN kept = 0 THEN 'no citation of a page that was shown' WHEN kept < cited THEN 'dropped citations of pages that were not shown' END AS warning FROM k""")

    # legal
    r.add("case_direction", lambda spark, sf: records(spark, sf).select("doc_id", "ord", "against_party"), f"WITH {LEGAL_SQL} SELECT doc_id, ord, against_party FROM rec")
    r.add("case_party", lambda spark, sf: records(spark, sf).select("doc_id", "ord", "party"), f"WITH {LEGAL_SQL} SELECT doc_id, ord, party FROM rec")
    columns = ["doc_id", "ord", "heading", "party", "against_party", "type", "total_row", "count", "amount_million", "summary", "page"]
    r.add("case_records", lambda spark, sf: records(spark, sf).select(*columns, "warning"), f"WITH {LEGAL_SQL} SELECT {', '.join(columns)}, warning FROM rec")
    r.add("dedupe_cases", lambda spark, sf: L.dedupe_cases(records(spark, sf)).select(*columns), f"WITH {LEGAL_SQL} SELECT {', '.join(columns)} FROM dd")
    r.add("mark_totals", lambda spark, sf: marked_cases(spark, sf).select("doc_id", "ord", "in_total_row"), f"WITH {LEGAL_SQL} SELECT doc_id, ord, in_total_row FROM mk")
    r.add("case_summary", lambda spark, sf: legal_summary(spark, sf).withColumn("net_worth", F.round("net_worth", 6)),
          f"WITH {LEGAL_SQL} SELECT * REPLACE (round(net_worth, 6) AS net_worth) FROM summ")
    r.add("legal_flags", lambda spark, sf: L.legal_flags(legal_summary(spark, sf), derived(spark, sf, "approvals")),
          f"WITH {LEGAL_FLAGS_SQL} SELECT doc_id, ord, severity, code, message FROM lflags")
    r.add("cases_filed_by", lambda spark, sf: L.split_cases(marked_cases(spark, sf))[1].select("doc_id", "ord", "party"),
          f"WITH {LEGAL_SQL} SELECT doc_id, ord, party FROM mk WHERE NOT against_party")
    r.add("cases_against", lambda spark, sf: L.split_cases(marked_cases(spark, sf))[0].select("doc_id", "ord", "party", "in_total_row"),
          f"WITH {LEGAL_SQL} SELECT doc_id, ord, party, in_total_row FROM mk WHERE against_party")

    # offers
    amounts = {"fresh_issue_million": "fresh", "specified_objects_million": "specified", "gcp_million": "gcp", "debt_repayment_million": "debt"}
    shares = ["specified_pct", "unspecified_pct", "gcp_pct", "debt_pct", "offer_for_sale_pct", "dilution_pct"]
    r.add("offer_metrics", lambda spark, sf: metrics(spark, sf).select("doc_id", *[F.round(c, 4).alias(c) for c in amounts], *shares), f"""
        WITH {OFFERS_SQL} SELECT doc_id, {', '.join(f'round({b}, 4) AS {a}' for a, b in amounts.items())}, {', '.join(shares)} FROM om""")
    r.add("offer_flags", lambda spark, sf: O.offer_flags(metrics(spark, sf)), f"WITH {OFFER_FLAGS_SQL} SELECT doc_id, ord, severity, code, message FROM oflags")
    r.add("ground_offer", lambda spark, sf: O.ground_offer(derived(spark, sf, "offer_answers"), GROUNDED).select(
        "doc_id", *GROUNDED, F.array_join("left_out", ",").alias("left_out")), f"""
        WITH {GROUND_SQL} SELECT doc_id, {', '.join(f'CASE WHEN ok_{f} THEN {f} END AS {f}' for f in GROUNDED)},
          array_to_string(list_filter([{', '.join(f"CASE WHEN {f} IS NOT NULL AND NOT ok_{f} THEN '{f}' END" for f in GROUNDED)}], lambda z: z IS NOT NULL), ',') AS left_out FROM gk""")
    r.add("ground_objects", lambda spark, sf: O.ground_objects(derived(spark, sf, "object_answers")).select("doc_id", "ord", "amount", "warning"), f"""
        WITH {check_sql('object_answers')}, k AS (SELECT *, amount IS NOT NULL AND NOT ({OBJECT_OK}) AS lost FROM object_answers)
        SELECT doc_id, ord, CASE WHEN NOT lost THEN amount END AS amount,
          CASE WHEN lost THEN 'amount for ''' || left(purpose, 40) || ''' (' || CAST(amount AS VARCHAR) || ') isn''t in the excerpts, so it was left out' END AS warning FROM k""")


def missing_numbers_of(spark, sf):
    """Gaps among the printed numbers of all documents, within their source."""
    from prospectra.operators.structure import missing_numbers

    d = table(spark, sf, "documents")
    return missing_numbers(d.select(F.substring("source", F.lit(4), F.lit(9)).cast("long").alias("doc_id"),
                                    F.col("n_chars").alias("number")))

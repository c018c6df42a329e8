"""Scores, facts and reports of every supplier treated as an issuer."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import fill, general, grouped, lookup, plain
from prospectra.operators import legal as L, offer as O, ratios as R, register as G, report as P, rubric as B, statements as S
from prospectra.operators.report import DIGEST_TEXT as DT, FACT_TEXT as FT
from prospectra.plans import register_queries as Q
from prospectra.plans.inputs import check_sql, derived, spread_derived, table
from prospectra.plans.ratio_queries import FLAGS_SQL, SCORECARD_SQL, long_facts, periods_of
from prospectra.plans.registry import Registry, shared
from prospectra.plans.statement_queries import PAGE_STATEMENT_SQL, statement_pages
from prospectra.plans.structure_queries import SECTIONS_SQL, parsed
from prospectra.sources.folders import stored


def issuers(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"))


# What several parts of a score or report use is stored once per query: Spark would work it out again for each part.
@shared
def figures(spark, sf):
    """Facts and periods of all issuers, from one pass over the lines."""
    wide = stored(derived(spark, sf, "fin_wide"))
    return long_facts(wide), periods_of(wide)


@shared
def issuer_profiles(spark, sf):
    return stored(R.profile(*figures(spark, sf)))


@shared
def risks(spark, sf):
    return stored(Q.register_of(spark, sf).join(issuers(spark, sf), "doc_id", "left_semi").select("doc_id", "number", "page", "score", "category", "severity", "headline"))


@shared
def issuer_cases(spark, sf):
    """The case summary of each issuer, with the pages of its cases against the parties. All steps go document by document, so others' cases need not be read closely."""
    read = spread_derived(spark, sf, "cases", "events", "ord").join(issuers(spark, sf), "doc_id", "left_semi")
    cases = stored(L.dedupe_cases(L.case_records(read, Q.shown()).drop("heading", "warning")).drop("summary"))
    return stored(L.case_summary(L.mark_totals(cases), S.net_worth(*figures(spark, sf)), against_pages=F.collect_set(F.when(F.col("against_party"), F.col("page")))))


@shared
def risk_status(spark, sf):
    return G.risk_counts(risks(spark, sf)).withColumn("status", F.when(F.col("doc_id") % 6 == 5, "failed").otherwise("done"))


@shared
def legal_flag_rows(spark, sf):
    return L.legal_flags(issuer_cases(spark, sf), derived(spark, sf, "approvals"))


@shared
def part(name, spark, sf):
    docs = issuers(spark, sf)
    if name == "financial":
        p = issuer_profiles(spark, sf)
        return B.score_financial(docs, R.scorecard(p), R.financial_flags(p))
    if name == "risk":
        return B.score_risk(docs, risk_status(spark, sf))
    if name == "business":
        return B.score_business(docs, derived(spark, sf, "promoters"))
    if name == "legal":
        return B.score_legal(docs, issuer_cases(spark, sf), derived(spark, sf, "approvals"))
    m = issuer_metrics(spark, sf)
    return B.score_offer(docs, m, O.offer_flags(m))


@shared
def all_parts(spark, sf):
    parts = [part(name, spark, sf) for name, _, _ in V.PARTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@shared
def scores(spark, sf):
    return B.total_score(all_parts(spark, sf), legal_flag_rows(spark, sf))


# ------------------------------------------------------------------ checks
def _with(*texts: str) -> str:
    """Joins common table expressions, keeping the first definition of each name."""
    seen, out = set(), []
    for text in texts:
        depth, start, items = 0, 0, []
        quoted = False
        for i, ch in enumerate(text):
            if ch == "'":
                quoted = not quoted
            elif not quoted and ch in "([{":
                depth += 1
            elif not quoted and ch in ")]}":
                depth -= 1
            elif not quoted and ch == "," and depth == 0:
                items.append(text[start:i])
                start = i + 1
        items.append(text[start:])
        for item in items:
            name = item.strip().split(" AS ", 1)[0].split("(")[0].strip()
            if name not in seen:
                seen.add(name)
                out.append(item.strip())
    return ",\n".join(out)


HALF = "'The {a} agent didn''t finish, so this part gets half marks'"
FIN_PART = f"""sg AS (SELECT doc_id, avg(CASE signal WHEN 'positive' THEN 1.0 WHEN 'negative' THEN 0.0 ELSE 0.5 END) AS mean, count(*) AS n, count(*) FILTER (signal = 'positive') AS np,
   count(*) FILTER (signal = 'neutral') AS nn, count(*) FILTER (signal = 'negative') AS ng FROM card GROUP BY doc_id),
fc AS (SELECT doc_id, list({{'c': CASE severity WHEN 'red' THEN 3 ELSE 1 END, 'm': message}} ORDER BY ord) AS f FROM flags GROUP BY doc_id),
ff AS (SELECT doc_id, list_reduce(f, lambda s, x: CASE WHEN s.used + x.c <= 12 THEN {{'used': s.used + x.c, 'r': list_append(s.r, '-' || x.c || ': ' || x.m)}} ELSE s END, {{'used': 0, 'r': []::VARCHAR[]}}) AS z FROM fc),
part_financial AS (SELECT s_suppkey AS doc_id, 'financial' AS part, CASE WHEN n IS NULL THEN 15.0 ELSE greatest(0.0, least(30.0, 30 * mean - coalesce(z.used, 0))) END AS raw,
  CASE WHEN n IS NULL THEN [{HALF.format(a='financial')}] ELSE list_concat(['Scorecard: ' || np || ' positive, ' || nn || ' neutral, ' || ng || ' negative of ' || n], coalesce(z.r, [])) END AS reasons, n IS NOT NULL AS complete
  FROM supplier LEFT JOIN sg ON sg.doc_id = s_suppkey LEFT JOIN ff ON ff.doc_id = s_suppkey)"""
RISK_PART = f"""part_risk AS (SELECT s_suppkey AS doc_id, 'risk' AS part, CASE WHEN ok THEN greatest(0.0, least(20.0, 20 * (5 - average_score) / 4 - CASE WHEN score_5 > 0 THEN least(2 * score_5, 8) ELSE 0 END)) ELSE 10.0 END AS raw,
  CASE WHEN ok THEN list_filter(['Average risk score ' || printf('%g', average_score) || ' out of 5 across ' || total || ' risk factors', CASE WHEN score_5 > 0 THEN '-' || least(2 * score_5, 8) || ': ' || score_5 || ' risk(s) scored 5, a threat to the core business' END], lambda x: x IS NOT NULL)
   ELSE [{HALF.format(a='risk')}] END AS reasons, ok AS complete
  FROM (SELECT s_suppkey, c.*, coalesce(c.doc_id % 6 <> 5 AND average_score IS NOT NULL, FALSE) AS ok FROM supplier LEFT JOIN counts c ON c.doc_id = s_suppkey))"""
BUSINESS_PART = f"""part_business AS (SELECT s_suppkey AS doc_id, 'business' AS part, CASE WHEN ok THEN hp + pp + gp ELSE 10.0 END AS raw,
  CASE WHEN ok THEN ['+' || hp || ': ' || coalesce('Promoters hold ' || printf('%g', holding_pct) || '% before the offer', 'The promoters'' holding isn''t stated') || ' (' || lv || ' stake)',
    '+' || pp || ': promoter shares pledged: ' || CASE shares_pledged WHEN TRUE THEN 'yes' WHEN FALSE THEN 'no' ELSE 'not stated' END, '+' || printf('%g', gp) || ': ' || n_concerns || ' governance concern(s) found'] ELSE [{HALF.format(a='business')}] END AS reasons, ok AS complete
  FROM (SELECT *, doc_id IS NOT NULL AS ok, CASE lv WHEN 'high' THEN 10 WHEN 'moderate' THEN 6 WHEN 'low' THEN 2 ELSE 5 END AS hp, CASE shares_pledged WHEN TRUE THEN 0 WHEN FALSE THEN 4 ELSE 2 END AS pp, greatest(6 - 1.5E0 * n_concerns, 0) AS gp
    FROM (SELECT *, CASE WHEN holding_pct IS NULL THEN 'unknown' WHEN holding_pct >= 50 THEN 'high' WHEN holding_pct >= 26 THEN 'moderate' ELSE 'low' END AS lv FROM supplier LEFT JOIN promoters ON promoters.doc_id = s_suppkey)))"""
_LD = ["CASE WHEN n_criminal > 0 THEN {'a': least(4.0 * n_criminal, 8)::DOUBLE, 'm': n_criminal || ' criminal case(s) against'} END",
       "CASE WHEN n_sebi_disciplinary > 0 THEN {'a': 5.0::DOUBLE, 'm': 'SEBI or stock exchange action against the promoters'} END",
       "CASE WHEN n_regulatory > 0 THEN {'a': least(1.5 * n_regulatory, 4.5)::DOUBLE, 'm': n_regulatory || ' regulatory action(s) against'} END",
       "CASE WHEN pct_of_net_worth >= 10 THEN {'a': (CASE WHEN pct_of_net_worth >= 25 THEN 5.0 ELSE 3.0 END)::DOUBLE, 'm': 'claims against total ' || printf('%g', pct_of_net_worth) || '% of net worth'} END",
       "CASE WHEN n_not_applied > 0 THEN {'a': least(n_not_applied, 3)::DOUBLE, 'm': 'required approvals not yet applied for'} END",
       "CASE WHEN NOT all_material_obtained THEN {'a': 2.0::DOUBLE, 'm': 'the document says material approvals are missing'} END"]
LEGAL_PART = f"""ldx AS (SELECT s_suppkey AS doc_id, s.doc_id IS NOT NULL AS ok, list_filter([{', '.join(_LD)}], lambda x: x IS NOT NULL) AS d FROM supplier LEFT JOIN summ s ON s.doc_id = s_suppkey LEFT JOIN approvals a ON a.doc_id = s_suppkey),
part_legal AS (SELECT doc_id, 'legal' AS part, CASE WHEN ok THEN greatest(0.0, 15 - coalesce(list_sum(list_transform(d, lambda x: x.a)), 0)) ELSE 7.5 END AS raw, CASE WHEN NOT ok THEN [{HALF.format(a='legal')}]
   WHEN len(d) = 0 THEN ['No criminal, regulatory or large claims against the company, promoters or directors'] ELSE list_transform(d, lambda x: '-' || printf('%g', x.a) || ': ' || x.m) END AS reasons, ok AS complete FROM ldx)"""
_OD = ["CASE WHEN offer_for_sale_pct >= 25 THEN {'a': CASE WHEN offer_for_sale_pct >= 50 THEN 5 ELSE 2 END, 'm': printf('%g', offer_for_sale_pct) || '% of the shares offered are sold by existing shareholders'} END",
       "CASE WHEN promoters_selling THEN {'a': 2, 'm': 'promoters or the promoter group are selling shares'} END",
       "CASE WHEN gcp_pct > 20 OR (gcp_pct IS NULL AND unspecified_pct > 20) THEN {'a': 3, 'm': 'over 20% of the fresh issue isn''t tied to a stated use'} END"]
OFFER_PART = f"""odx AS (SELECT s_suppkey AS doc_id, o.doc_id IS NOT NULL AS ok, list_filter([{', '.join(_OD)}], lambda x: x IS NOT NULL) AS d FROM supplier LEFT JOIN om o ON o.doc_id = s_suppkey),
part_offer AS (SELECT doc_id, 'offer' AS part, CASE WHEN ok THEN 15.0 - coalesce(list_sum(list_transform(d, lambda x: x.a)), 0) ELSE 7.5 END AS raw, CASE WHEN NOT ok THEN [{HALF.format(a='offer')}]
   WHEN len(d) = 0 THEN ['No concerns in how the offer is structured'] ELSE list_transform(d, lambda x: '-' || x.a || ': ' || x.m) END AS reasons, ok AS complete FROM odx)"""
PART_SQL = {
    "financial": lambda: _with(SCORECARD_SQL, FLAGS_SQL, FIN_PART), "risk": lambda: _with(Q.REGISTER_SQL, RISK_PART),
    "business": lambda: _with(check_sql("promoters"), BUSINESS_PART), "legal": lambda: _with(Q.LEGAL_SQL, check_sql("approvals"), LEGAL_PART),
    "offer": lambda: _with(Q.OFFERS_SQL, OFFER_PART)}
POINTS = "CAST(printf('%.1f', raw) AS DOUBLE) + 0.0"


def score_sql() -> str:
    parts = _with(*[make() for make in PART_SQL.values()], Q.LEGAL_FLAGS_SQL)
    union = " UNION ALL ".join(f"SELECT doc_id, part, {POINTS} AS points, complete FROM part_{p}" for p in PART_SQL)
    return f"""{parts}, allparts AS ({union}),
tot AS (SELECT doc_id, CAST(printf('%.1f', sum(points::DECIMAL(10,1))::DOUBLE) AS DOUBLE) AS score, {', '.join(f"max(points) FILTER (part = '{p}') AS {p}" for p in PART_SQL)},
  bool_or(part = 'financial' AND complete) AS fin_ok, coalesce(string_agg(CASE part {' '.join(f"WHEN '{n}' THEN '{label}'" for n, label, _ in V.PARTS)} END, ', ' ORDER BY CASE part WHEN 'financial' THEN 1 WHEN 'risk' THEN 2 WHEN 'business' THEN 3 WHEN 'legal' THEN 4 ELSE 5 END) FILTER (NOT complete), '') AS incomplete
  FROM allparts GROUP BY doc_id),
ko AS (SELECT tot.*, list_filter([CASE WHEN fin_ok AND financial < 12 THEN 'Financial health scored ' || printf('%g', financial) || '/30, under 40%' END,
   CASE WHEN doc_id IN (SELECT doc_id FROM lflags WHERE severity = 'red' AND code IN ('criminal_cases', 'sebi_action')) THEN 'Criminal or SEBI proceedings against the company, promoters or directors' END], lambda x: x IS NOT NULL) AS k FROM tot),
final AS (SELECT doc_id, score, CASE WHEN score >= 65 AND len(k) = 0 THEN 'Leans Subscribe' WHEN score >= 45 THEN 'Neutral' ELSE 'Leans Avoid' END AS rating, array_to_string(k, ' | ') AS knockouts, incomplete,
  CAST(printf('%.2f', financial / 30) AS DOUBLE) AS reward, CAST(printf('%.2f', (risk / 20 + legal / 15) / 2) AS DOUBLE) AS safety,
  CASE WHEN financial / 30 >= 0.6 THEN 'Higher reward, ' ELSE 'Lower reward, ' END || CASE WHEN (risk / 20 + legal / 15) / 2 >= 0.6 THEN 'lower risk' ELSE 'higher risk' END AS quadrant FROM ko)"""


# ------------------------------------------------------------------ facts
def of_issuers(spark, sf, name, key="doc_id"):
    """Rows of a derived table whose document is an issuer; the filter reaches the scans below its joins and groups."""
    return derived(spark, sf, name).join(issuers(spark, sf), "doc_id", "left_semi")


@shared
def issuer_metrics(spark, sf):
    return stored(O.offer_metrics(of_issuers(spark, sf, "offers"), uses_of_issuers(spark, sf)))


@shared
def uses_of_issuers(spark, sf):
    return stored(of_issuers(spark, sf, "objects"))


@shared
def issuer_claims(spark, sf):
    return stored(of_issuers(spark, sf, "claims"))


def claims(spark, sf, kind):
    return issuer_claims(spark, sf).where(F.col("kind") == kind)


def case_counts(separator):
    return F.concat_ws(separator, *[F.when(F.col(f"n_{t}") > 0, F.concat(F.lit(t.replace("_", " ") + " "), F.col(f"n_{t}").cast("string"))) for t in V.CASE_TYPES])


def held():
    return F.coalesce(fill(V.RUBRIC_TEXT["holding_known"], holding=general(F.col("holding_pct"))), F.lit(V.RUBRIC_TEXT["holding_unknown"]))


def commas(amount):
    """A money amount with thousands separators and its decimals as they are, at least one."""
    return F.regexp_replace(grouped(amount, 2), "0$", "")


@shared
def fact_sources(spark, sf):
    p = issuer_profiles(spark, sf)
    docs = issuers(spark, sf)
    # Pages: those on which each statement was found first; the offer's; those of the cases that count as against.
    pages = statement_pages(spark, sf).where("statement IS NOT NULL").groupBy("doc_id", "statement").agg(F.min("page").alias("page")).groupBy("doc_id").agg(F.collect_list("page").alias("pages"))
    empty = F.coalesce("pages", F.array().cast("array<int>"))
    pages = stored(pages)
    scored = R.scorecard(p).join(pages, "doc_id", "left")
    card = scored.select("doc_id", *P.fact("F", 1, F.col("ord"), fill(
        FT["signal"], dimension=P.readable(F.col("dimension")), signal=F.col("signal"), reason=F.col("reason")), empty))
    summary_fact = claims(spark, sf, "summary").join(scored.select("doc_id", "pages").distinct(), "doc_id").select("doc_id", *P.fact("F", 0, F.col("ord"), F.col("text"), empty))
    flags = R.financial_flags(p).join(pages, "doc_id", "left").select("doc_id", *P.fact("F", 2, F.col("ord"), fill(
        FT["flag"], severity=F.col("severity"), message=F.col("message")), empty))
    register = risks(spark, sf)
    counts = G.risk_counts(register).select("doc_id", *P.fact("R", 3, F.lit(0), fill(
        FT["risks"], total=F.col("total"), average=F.col("average_score"), high=F.col("severity_high"))))
    top = G.top_risks(register, 8).select("doc_id", *P.fact("R", 4, F.col("place"), fill(
        FT["risk"], number=F.col("number"), category=F.col("category"), score=F.col("score"), headline=F.col("headline")), F.array("page")))
    people = of_issuers(spark, sf, "promoters")

    def claim(source, kind):
        return claims(spark, sf, kind).select("doc_id", *P.fact("B", source, F.col("ord"), fill(FT[kind], text=F.col("text")), F.array("page")))

    promoters = people.select("doc_id", *P.fact("B", 9, F.lit(0), fill(FT["promoters"], names=F.col("name"), reason=held()), F.array("holding_page")))
    pledge = people.select("doc_id", *P.fact("B", 10, F.lit(0), F.when(F.col("shares_pledged"), FT["pledged"]).when(~F.col("shares_pledged"), FT["not_pledged"]), F.array("pledge_page")))
    with_people = people.select("doc_id")
    m = issuer_metrics(spark, sf)
    offer = m.select("doc_id", "amount_unit", "offer_page")
    fresh = m.select("doc_id", *P.fact("O", 13, F.lit(0), F.when(F.col("fresh_issue_million") != 0, fill(FT["fresh_issue"], amount=grouped(F.col("fresh_issue_million"), 1)))
                                       .when(F.col("fresh_issue_shares") != 0, fill(FT["fresh_shares"], shares=F.format_number("fresh_issue_shares", 0))), F.array("offer_page")))
    sellers = P.joined(of_issuers(spark, sf, "sellers"), "names", "ord", F.col("name"), ", ").join(offer, "doc_id").select(
        "doc_id", *P.fact("O", 14, F.lit(0), fill(FT["sellers"], names=F.col("names")), F.array("offer_page")))
    amount = F.coalesce(fill(": {amount} {unit}", amount=commas(F.col("amount")), unit=F.col("amount_unit")), F.lit(""))
    uses = uses_of_issuers(spark, sf).join(offer, "doc_id").select("doc_id", *P.fact("O", 15, F.col("ord"), fill(
        FT["use"], purpose=F.col("purpose"), amount=amount), F.array("page")))
    offer_flags = O.offer_flags(m).join(offer, "doc_id").select("doc_id", *P.fact("O", 16, F.col("ord"), F.col("message"), F.array("offer_page")))
    peers = derived(spark, sf, "peers").select("doc_id", *P.fact("O", 17, F.lit(0), fill(
        FT["peers"], low=plain(F.col("low")), high=plain(F.col("high")), mean=plain(F.col("mean"))), F.array("page")))
    summary = issuer_cases(spark, sf)
    cases = case_counts("; ")
    share = F.coalesce(fill(" ({share}% of net worth)", share=general(F.col("pct_of_net_worth"))), F.lit(""))
    legal = summary.select("doc_id", *P.fact("L", 18, F.lit(0), fill(
        FT["cases"], cases=F.when(cases == "", "none material").otherwise(cases), amount=grouped(F.col("total_amount"), 1), share=share), F.col("against_pages")))
    legal_flags = legal_flag_rows(spark, sf).select("doc_id", *P.fact("L", 19, F.col("ord"), F.col("message")))
    pending = derived(spark, sf, "pending").select("doc_id", *P.fact("L", 20, F.col("ord"), fill(FT["pending"], item=F.col("item")), F.array("page")))
    rows = [summary_fact, card, flags, counts, top, claim(5, "description"), claim(6, "strength"), claim(7, "weakness"), claim(8, "market_position"), promoters, pledge,
            claim(11, "governance").join(with_people, "doc_id", "left_semi"), claim(12, "related_party").join(with_people, "doc_id", "left_semi"),
            fresh, sellers, uses, offer_flags, peers, legal, legal_flags, pending]
    return [r.join(docs, "doc_id", "left_semi") for r in rows]


@shared
def facts_of(spark, sf):
    return P.collect_facts(fact_sources(spark, sf))


CASES_TEXT = """coalesce(nullif(array_to_string(list_filter([CASE WHEN n_criminal > 0 THEN 'criminal ' || n_criminal END, CASE WHEN n_regulatory > 0 THEN 'regulatory ' || n_regulatory END,
    CASE WHEN n_sebi_disciplinary > 0 THEN 'sebi disciplinary ' || n_sebi_disciplinary END, CASE WHEN n_tax > 0 THEN 'tax ' || n_tax END, CASE WHEN n_civil > 0 THEN 'civil ' || n_civil END], lambda x: x IS NOT NULL), '{sep}'), ''), 'none material')"""
HELD_SQL = "coalesce('Promoters hold ' || printf('%g', holding_pct) || '% before the offer', 'The promoters'' holding isn''t stated')"
FACTS_SQL_TAIL = f"""{PAGE_STATEMENT_SQL}, spg AS (SELECT doc_id, list(page) AS pg FROM (SELECT doc_id, statement, min(page) AS page FROM page_statement WHERE statement IS NOT NULL GROUP BY ALL) GROUP BY doc_id),
selling AS (SELECT doc_id, string_agg(name, ', ' ORDER BY ord, name) AS names FROM sellers GROUP BY doc_id),
agp AS (SELECT doc_id, list(DISTINCT page) AS pg FROM mk WHERE against_party GROUP BY doc_id),
fsrc AS (
 SELECT c.doc_id, 'F' AS prefix, 0 AS source, c.ord, c.text, s.pg FROM claims c LEFT JOIN spg s ON s.doc_id = c.doc_id WHERE kind = 'summary' AND c.doc_id IN (SELECT doc_id FROM card)
 UNION ALL SELECT card.doc_id, 'F', 1, ord, replace(dimension, '_', ' ') || ': ' || signal || '. ' || reason, pg FROM card LEFT JOIN spg ON spg.doc_id = card.doc_id
 UNION ALL SELECT flags.doc_id, 'F', 2, ord, severity || ' flag: ' || message, pg FROM flags LEFT JOIN spg ON spg.doc_id = flags.doc_id
 UNION ALL SELECT doc_id, 'R', 3, 0, total || ' risk factors, average score ' || average_score || ' out of 5 (' || severity_high || ' scored 4-5)', [] FROM counts WHERE average_score IS NOT NULL
 UNION ALL (SELECT doc_id, 'R', 4, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, number) AS place, 'Risk factor ' || number || ' (' || category || ', score ' || score || '): ' || headline, [page] FROM reg WHERE score >= 4 QUALIFY place <= 8)
 UNION ALL SELECT doc_id, 'B', CASE kind WHEN 'description' THEN 5 WHEN 'strength' THEN 6 WHEN 'weakness' THEN 7 WHEN 'market_position' THEN 8 WHEN 'governance' THEN 11 ELSE 12 END, ord,
   CASE kind WHEN 'description' THEN 'What it does: ' WHEN 'strength' THEN 'Strength: ' WHEN 'weakness' THEN 'Weakness: ' WHEN 'market_position' THEN 'Market position: ' WHEN 'governance' THEN 'Governance: ' ELSE 'Related parties: ' END || text, [page]
   FROM claims WHERE kind NOT IN ('summary', 'executive_summary') AND (kind NOT IN ('governance', 'related_party') OR doc_id IN (SELECT doc_id FROM promoters))
 UNION ALL SELECT doc_id, 'B', 9, 0, 'Promoters: ' || name || '. ' || {HELD_SQL}, [holding_page] FROM promoters
 UNION ALL SELECT doc_id, 'B', 10, 0, CASE shares_pledged WHEN TRUE THEN 'Some promoter shares are pledged' ELSE 'No promoter shares are pledged' END, [pledge_page] FROM promoters WHERE shares_pledged IS NOT NULL
 UNION ALL SELECT doc_id, 'O', 13, 0, CASE WHEN fresh <> 0 THEN 'Fresh issue of ₹' || format('{{:,.1f}}', fresh) || ' m' ELSE 'Fresh issue of ' || format('{{:,}}', fresh_issue_shares) || ' shares (price not yet fixed)' END, [offer_page] FROM om
 UNION ALL SELECT s.doc_id, 'O', 14, 0, 'Offer for sale by ' || names, [offer_page] FROM selling s JOIN om ON om.doc_id = s.doc_id
 UNION ALL SELECT o.doc_id, 'O', 15, o.ord, 'Use of proceeds: ' || purpose || coalesce(': ' || regexp_replace(format('{{:,.2f}}', amount), '0$', '') || ' ' || amount_unit, ''), [page] FROM objects o JOIN om ON om.doc_id = o.doc_id
 UNION ALL SELECT f.doc_id, 'O', 16, ord, message, [offer_page] FROM oflags f JOIN om ON om.doc_id = f.doc_id
 UNION ALL SELECT doc_id, 'O', 17, 0, 'Listed peers'' P/E: ' || CAST(low AS VARCHAR) || ' to ' || CAST(high AS VARCHAR) || ', average ' || CAST(mean AS VARCHAR), [page] FROM peers
 UNION ALL SELECT summ.doc_id, 'L', 18, 0, 'Cases against the company, promoters and directors: ' || {CASES_TEXT.format(sep='; ')}
    || '. Claims total ₹' || format('{{:,.1f}}', total_amount) || ' m' || coalesce(' (' || printf('%g', pct_of_net_worth) || '% of net worth)', ''), pg FROM summ LEFT JOIN agp ON agp.doc_id = summ.doc_id
 UNION ALL SELECT doc_id, 'L', 19, ord, message, [] FROM lflags
 UNION ALL SELECT doc_id, 'L', 20, ord, 'Approval pending: ' || item, [page] FROM pending),
factrows AS (SELECT doc_id, prefix, source, ord, prefix || row_number() OVER (PARTITION BY doc_id, prefix ORDER BY source, ord, trim(text)) AS fact_id, trim(text) AS text,
  array_to_string(list_sort(list_distinct(coalesce(pg, []))), ',') AS pages FROM fsrc WHERE trim(text) <> '' AND doc_id IN (SELECT s_suppkey FROM supplier))"""


def facts_sql() -> str:
    return _with(SCORECARD_SQL, FLAGS_SQL, Q.REGISTER_SQL, check_sql("promoters", "claims", "sellers", "peers", "pending", "statement_pages"), Q.OFFER_FLAGS_SQL, Q.LEGAL_FLAGS_SQL) + ",\n" + FACTS_SQL_TAIL


def points_of(spark, sf):
    n = F.col("doc_id")
    ids = [F.concat(F.lit("F"), (n % 4 + 1).cast("string")), F.concat(F.lit("R"), (n % 12 + 1).cast("string")), F.lit("X9")]
    rows = issuers(spark, sf).select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("point_no"))
    return rows.select("doc_id", "point_no", F.lit("Shown by (F1, R2) the facts").alias("text"), F.slice(
        F.array(*ids), F.lit(1), F.pmod(n + F.col("point_no"), F.lit(3)).cast("int") + 1).alias("fact_ids"))


def register(r: Registry) -> None:
    for name, _, _ in V.PARTS:
        r.add(f"score_{name}", lambda spark, sf, name=name: part(name, spark, sf).select(
            "doc_id", "points", F.array_join("reasons", " | ").alias("reasons"), "complete"),
            f"WITH {PART_SQL[name]()} SELECT doc_id, {POINTS} AS points, array_to_string(reasons, ' | ') AS reasons, complete FROM part_{name}")
    r.add("total_and_rating", scores, f"WITH {score_sql()} SELECT * FROM final")
    r.add("collect_facts", lambda spark, sf: facts_of(spark, sf).select("doc_id", "fact_id", "text", F.array_join("pages", ",").alias("pages")),
          f"WITH {facts_sql()} SELECT doc_id, fact_id, text, pages FROM factrows")
    r.add("cite_points", lambda spark, sf: P.cite_points(points_of(spark, sf), facts_of(spark, sf)).select(
        "doc_id", "point_no", "text", F.array_join("facts", ",").alias("facts"), F.array_join("pages", ",").alias("pages"), F.array_join("dropped", ",").alias("dropped")), f"""
        WITH {facts_sql()}, pt AS (SELECT doc_id, CAST(point_no AS INT) AS point_no, ['F' || (doc_id % 4 + 1), 'R' || (doc_id % 12 + 1), 'X9'][1 : (doc_id + point_no) % 3 + 1] AS ids
           FROM (SELECT s_suppkey AS doc_id, unnest(generate_series(1, 3)) AS point_no FROM supplier)),
        px AS (SELECT doc_id, point_no, unnest(ids) AS fact_id, unnest(range(len(ids))) AS i FROM pt),
        pf AS (SELECT px.*, f.fact_id AS known, f.pages FROM px LEFT JOIN factrows f ON f.doc_id = px.doc_id AND f.fact_id = px.fact_id),
        pp AS (SELECT doc_id, point_no, string_agg(p, ',' ORDER BY CAST(p AS INT)) AS pages FROM (SELECT DISTINCT doc_id, point_no, unnest(string_split(pages, ',')) AS p FROM pf WHERE pages <> '') GROUP BY ALL)
        SELECT pf.doc_id, pf.point_no, 'Shown by the facts' AS text, coalesce(string_agg(known, ',' ORDER BY i), '') AS facts, any_value(coalesce(pp.pages, '')) AS pages,
          coalesce(string_agg(CASE WHEN known IS NULL THEN fact_id END, ',' ORDER BY fact_id), '') AS dropped FROM pf LEFT JOIN pp ON pp.doc_id = pf.doc_id AND pp.point_no = pf.point_no GROUP BY pf.doc_id, pf.point_no""")

    def digest(spark, sf):
        line = lambda rows, source, order, text: rows.select("doc_id", F.lit(source).alias("source"), order.cast("long").alias("ord"), text.alias("text"))      # noqa: E731
        zero, c = F.lit(0), F.col
        of_part = {part: (i, label, f"{most:g}") for i, (part, label, most) in enumerate(V.PARTS)}
        place, label, most = (lookup(c("part"), {part: values[k] for part, values in of_part.items()}) for k in range(3))
        parts = P.joined(all_parts(spark, sf).withColumn("place", place), "parts", "place", fill("{label} {points}/{most}", label=label, points=general(c("points")), most=most), ", ")
        s = scores(spark, sf).join(parts, "doc_id")
        p = issuer_profiles(spark, sf)
        card = P.joined(R.scorecard(p), "signals", "ord", F.concat(P.readable(c("dimension")), F.lit(" "), c("signal"), F.lit(" ("), c("reason"), F.lit(")")), "; ")
        flags = P.joined(R.financial_flags(p), "flags", "ord", c("message"), " | ")
        register = risks(spark, sf)
        people = of_issuers(spark, sf, "promoters")
        pledged = F.when(c("shares_pledged"), DT["pledged"]).when(~c("shares_pledged"), DT["not_pledged"]).otherwise(DT["pledge_unknown"])
        m = issuer_metrics(spark, sf)
        uses = P.joined(uses_of_issuers(spark, sf).join(m.select("doc_id", "amount_unit"), "doc_id"), "uses", "ord", F.concat(
            c("purpose"), F.lit(" ("), F.coalesce(plain(c("amount")), F.lit("None")), F.lit(" "), c("amount_unit"), F.lit(")")), "; ")
        priced = F.coalesce(c("fresh_issue_million") != 0, F.lit(False))
        offer = m.join(uses, "doc_id", "left")
        summary = issuer_cases(spark, sf)
        cases = case_counts(", ")
        share = F.coalesce(fill(" ({share}% of net worth)", share=plain(c("pct_of_net_worth"))), F.lit(""))
        lines = [
            line(s, 0, zero, fill(DT["score"], score=c("score"), rating=c("rating"), quadrant=c("quadrant"), parts=c("parts"))),
            line(s.where("knockouts <> ''").select("doc_id", F.posexplode(F.split("knockouts", r" \| ")).alias("i", "reason")), 1, c("i"), fill(DT["knockout"], reason=c("reason"))),
            line(card, 2, zero, fill(DT["scorecard"], signals=c("signals"))), line(flags, 3, zero, fill(DT["flags"], flags=c("flags"))),
            line(claims(spark, sf, "summary").where("text <> ''"), 4, zero, fill(DT["summary"], text=c("text"))),
            line(G.risk_counts(register), 5, zero, fill(DT["risks"], total=c("total"), average=c("average_score"))),
            line(G.top_risks(register, 6), 6, c("place"), fill(DT["risk"], number=c("number"), score=c("score"), page=c("page"), headline=c("headline"))),
            line(people, 7, zero, fill(DT["promoters"], names=c("name"), reason=held(), pledged=pledged)),
            line(offer, 8, zero, fill(DT["offer"], fresh=F.when(priced, plain(c("fresh_issue_million"))).otherwise(F.coalesce(c("fresh_issue_shares").cast("string"), F.lit("None"))),
                                      unit=F.when(priced, "₹ million").otherwise("shares"), sold=F.coalesce("offer_for_sale_shares", F.lit(0)), uses=F.coalesce("uses", F.lit("")))),
            line(O.offer_flags(m), 9, c("ord"), c("message")),
            line(summary, 10, zero, fill(DT["cases"], cases=F.when(cases == "", "none material").otherwise(cases), amount=grouped(c("total_amount"), 1), share=share)),
            line(claims(spark, sf, "executive_summary").where("text <> ''"), 11, zero, fill(DT["report"], text=c("text")))]
        docs = issuers(spark, sf)
        return P.analysis_digest([rows.join(docs, "doc_id", "left_semi") for rows in lines])

    r.add("analysis_digest", digest, f"""
        WITH {_with(score_sql(), facts_sql())}, us AS (SELECT o.doc_id, string_agg(purpose || ' (' || coalesce(CAST(amount AS VARCHAR), 'None') || ' ' || amount_unit || ')', '; ' ORDER BY o.ord, purpose || ' (' || coalesce(CAST(amount AS VARCHAR), 'None') || ' ' || amount_unit || ')') AS uses
          FROM objects o JOIN om ON om.doc_id = o.doc_id GROUP BY o.doc_id),
        kx AS (SELECT doc_id, unnest(string_split(knockouts, ' | ')) AS reason, unnest(range(len(string_split(knockouts, ' | ')))) AS i FROM final WHERE knockouts <> ''),
        dl AS (SELECT doc_id, 0 AS source, 0 AS ord, 'Rubric score ' || score || '/100: ' || rating || ' (' || quadrant || '). ' || (SELECT {" || ', ' || ".join(f"'{label} ' || printf('%g', tot.{p}) || '/{most:g}'" for p, label, most in V.PARTS)} FROM tot WHERE tot.doc_id = final.doc_id) || '.' AS text FROM final
          UNION ALL SELECT doc_id, 1, i, 'Rating capped at Neutral: ' || reason || '.' FROM kx
          UNION ALL SELECT doc_id, 2, 0, 'Financial scorecard: ' || string_agg(replace(dimension, '_', ' ') || ' ' || signal || ' (' || reason || ')', '; ' ORDER BY ord) FROM card GROUP BY doc_id
          UNION ALL SELECT doc_id, 3, 0, 'Financial flags: ' || string_agg(message, ' | ' ORDER BY ord) FROM flags GROUP BY doc_id
          UNION ALL SELECT doc_id, 4, 0, 'Financial summary: ' || text FROM claims WHERE kind = 'summary' AND text <> ''
          UNION ALL SELECT doc_id, 5, 0, total || ' risk factors, average score ' || average_score || '/5.' FROM counts
          UNION ALL (SELECT doc_id, 6, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, number) AS place, 'Risk ' || number || ' (score ' || score || ', p. ' || page || '): ' || headline FROM reg WHERE score >= 4 QUALIFY place <= 6)
          UNION ALL SELECT doc_id, 7, 0, 'Promoters: ' || name || '. ' || {HELD_SQL} || ', ' || CASE shares_pledged WHEN TRUE THEN 'some shares pledged' WHEN FALSE THEN 'no shares pledged' ELSE 'pledging not stated' END || '.' FROM promoters
          UNION ALL SELECT om.doc_id, 8, 0, 'Offer: fresh issue ' || CASE WHEN coalesce(fresh, 0) <> 0 THEN CAST(fresh AS VARCHAR) || ' (₹ million)' ELSE coalesce(CAST(fresh_issue_shares AS VARCHAR), 'None') || ' (shares)' END
            || ', offer for sale ' || coalesce(offer_for_sale_shares, 0) || ' shares. Money for: ' || coalesce(uses, '') || '.' FROM om LEFT JOIN us ON us.doc_id = om.doc_id
          UNION ALL SELECT doc_id, 9, ord, message FROM oflags
          UNION ALL SELECT doc_id, 10, 0, 'Cases against the company, promoters and directors: ' || {CASES_TEXT.format(sep=', ')} || '; claims ₹' || format('{{:,.1f}}', total_amount) || ' m'
            || coalesce(' (' || CAST(pct_of_net_worth AS VARCHAR) || '% of net worth)', '') || '.' FROM summ
          UNION ALL SELECT doc_id, 11, 0, 'Report summary: ' || text FROM claims WHERE kind = 'executive_summary' AND text <> '')
        SELECT doc_id, string_agg(text, chr(10) ORDER BY source, ord) AS digest FROM dl WHERE doc_id IN (SELECT s_suppkey FROM supplier) GROUP BY doc_id""")
    agents = ("risk", "financial", "legal", "business", "offer", "score", "report")
    r.add("list_analyses", lambda spark, sf: P.list_analyses(derived(spark, sf, "agent_results")).select(
        "doc_id", "finished_at", *[F.try_element_at("agents", F.lit(a)).alias(a) for a in agents]), f"""
        WITH {check_sql('agent_results')}, l AS (SELECT doc_id, agent, arg_max(status, result_id) AS status, max(saved_at) AS done_at FROM agent_results GROUP BY ALL)
        SELECT doc_id, max(done_at) AS finished_at, {', '.join(f"max(status) FILTER (agent = '{a}') AS {a}" for a in agents)} FROM l GROUP BY doc_id""")

    def view(spark, sf):
        out = P.analysis_view(parsed(spark, sf).select("doc_id", "page_offset", "sections"), derived(spark, sf, "agent_results"), agents)
        return out.select("doc_id", "page_offset", F.array_join(F.transform("sections", lambda s: s["title"]), " | ").alias("outline"), *agents)

    r.add("analysis_view", view, f"""
        WITH {_with(SECTIONS_SQL, check_sql('agent_results'))}, l AS (SELECT doc_id, agent, arg_max(status, result_id) AS status FROM agent_results GROUP BY ALL),
        o AS (SELECT doc_id, string_agg(title, ' | ' ORDER BY pos) AS outline FROM sections GROUP BY doc_id)
        SELECT n.doc_id, page_offset, outline, {', '.join(f"(SELECT status FROM l WHERE l.doc_id = n.doc_id AND agent = '{a}') AS {a}" for a in agents)}
        FROM npages n LEFT JOIN offs ON offs.doc_id = n.doc_id LEFT JOIN o ON o.doc_id = n.doc_id""")
    def warnings(spark, sf):
        legal = Q.records(spark, sf).select("doc_id", F.lit("legal").alias("agent"), F.col("ord").cast("long").alias("ord"), "warning")
        offer = O.grounding_warnings(derived(spark, sf, "offer_answers"), Q.GROUNDED).select("doc_id", F.lit("offer").alias("agent"), "ord", "warning")
        uses = O.ground_objects(derived(spark, sf, "object_answers")).select("doc_id", F.lit("offer").alias("agent"), (F.col("ord") + len(Q.GROUNDED)).cast("long").alias("ord"), "warning")
        report = P.cite_points(points_of(spark, sf), facts_of(spark, sf)).where(F.size("dropped") > 0).select("doc_id", F.lit("report").alias("agent"), F.col("point_no").cast("long").alias("ord"), fill(
            V.DROPPED_FACTS, label=F.lit("bull case"), ids=F.array_join(F.transform("dropped", lambda d: F.concat(F.lit("'"), d, F.lit("'"))), ", ")).alias("warning"))
        return P.warnings_rollup(legal.unionByName(offer).unionByName(uses).unionByName(report)).select("doc_id", "agent", F.array_join("warnings", " | ").alias("warnings"))

    left_out = " UNION ALL ".join(f"SELECT doc_id, 'offer', {i}, '{f.replace('_', ' ')} (' || CAST({f} AS VARCHAR) || ') isn''t in the excerpts, so it was left out' FROM gk WHERE {f} IS NOT NULL AND NOT ok_{f}"
                                  for i, f in enumerate(Q.GROUNDED))
    r.add("warnings_rollup", warnings, f"""
        WITH {_with(facts_sql(), Q.GROUND_SQL, check_sql('object_answers'))}, pt AS (SELECT doc_id, CAST(point_no AS INT) AS point_no, ['F' || (doc_id % 4 + 1), 'R' || (doc_id % 12 + 1), 'X9'][1 : (doc_id + point_no) % 3 + 1] AS ids
           FROM (SELECT s_suppkey AS doc_id, unnest(generate_series(1, 3)) AS point_no FROM supplier)),
        px AS (SELECT DISTINCT doc_id, point_no, unnest(ids) AS fact_id FROM pt),
        w AS (SELECT doc_id, 'legal' AS agent, ord, warning FROM rec WHERE warning IS NOT NULL UNION ALL {left_out}
          UNION ALL SELECT doc_id, 'offer', ord + {len(Q.GROUNDED)}, 'amount for ''' || left(purpose, 40) || ''' (' || CAST(amount AS VARCHAR) || ') isn''t in the excerpts, so it was left out'
            FROM object_answers WHERE amount IS NOT NULL AND NOT ({Q.OBJECT_OK})
          UNION ALL SELECT doc_id, 'report', point_no, 'bull case: dropped unknown fact ids [' || string_agg('''' || fact_id || '''', ', ' ORDER BY fact_id) || ']' FROM px
            WHERE (doc_id, fact_id) NOT IN (SELECT doc_id, fact_id FROM factrows) GROUP BY doc_id, point_no)
        SELECT doc_id, agent, string_agg(warning, ' | ' ORDER BY ord, warning) AS warnings FROM w GROUP BY ALL""")

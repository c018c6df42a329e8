"""The 0-100 score: five parts with reasons, total, rating, knockouts, risk and reward.

Every part takes one row per document and returns (doc_id, part, points, reasons, complete). The set
of documents to score comes first; a part without a result gives half marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import computed, exact_round, fill, first_match, general, lookup
from prospectra.operators.ratios import holding_level

T = V.RUBRIC_TEXT
MAX = {name: points for name, _, points in V.PARTS}


def _deduct(when: Column, amount: Column, text: Column) -> Column:
    """(amount, reason) of a deduction, null when it does not apply."""
    amount = amount.cast("double")
    return F.when(when, F.struct(amount.alias("amount"), fill(T["deduct"], points=general(amount), reason=text).alias("reason")))


def _part(df: DataFrame, name: str, available: Column, start: Column, opening: Column, deductions: Column, clean: str | None = None) -> DataFrame:
    """Start points minus deductions, clamped and rounded; half marks when the result is not available."""
    d = computed(df, __deductions=F.array_compact(deductions))
    taken = F.aggregate("__deductions", F.lit(0.0), lambda total, x: total + x["amount"])
    reasons = F.concat(opening, F.transform("__deductions", lambda x: x["reason"]))
    if clean:
        reasons = F.when(F.size(reasons) == 0, F.array(F.lit(T[clean]))).otherwise(reasons)
    limit = MAX[name]
    points = exact_round(F.greatest(F.lit(0.0), F.least(F.lit(limit), start - taken)), 1)
    missing = F.array(fill(T["unavailable"], agent=F.lit(name)))
    ok = F.coalesce(available, F.lit(False))
    return d.select("doc_id", F.lit(name).alias("part"), F.when(ok, points).otherwise(limit / 2).alias("points"),
                    F.when(ok, reasons).otherwise(missing).alias("reasons"), ok.alias("complete"))


def _no_text() -> Column:
    return F.array().cast("array<string>")


def score_financial(documents: DataFrame, scorecard: DataFrame, flags: DataFrame) -> DataFrame:
    """Mean signal points of the scorecard, minus flag costs; a flag that would exceed the cap is skipped."""
    signals = scorecard.groupBy("doc_id").agg(
        F.avg(lookup(F.col("signal"), V.SIGNAL_POINTS)).alias("mean"), F.count("*").alias("n"),
        *[F.count_if(F.col("signal") == s).alias(s) for s in ("positive", "neutral", "negative")])
    cost = F.coalesce(lookup(F.col("severity"), V.FLAG_COSTS), F.lit(0))
    costs = flags.select("doc_id", "ord", cost.alias("cost"), "message").where("cost > 0").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "cost", "message"))).alias("f"))
    d = documents.select("doc_id").join(signals, "doc_id", "left").join(costs, "doc_id", "left")
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<ord:int,cost:int,message:string>>").alias("kept"))
    kept = F.aggregate(F.coalesce("f", start["kept"]), start, lambda s, x: F.when(s["used"] + x["cost"] <= V.MAX_FLAG_PENALTY, F.struct(
        (s["used"] + x["cost"]).alias("used"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s), lambda s: s["kept"])
    deductions = F.transform(kept, lambda x: _deduct(F.lit(True), x["cost"], x["message"]))
    opening = F.array(fill(T["scorecard"], positive=F.col("positive"), neutral=F.col("neutral"), negative=F.col("negative"), n=F.col("n")))
    return _part(d, "financial", F.col("n").isNotNull(), 30 * F.col("mean"), opening, deductions)


def score_risk(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """counts: total, score_5, average_score and status of the risk result."""
    d = documents.select("doc_id").join(counts.select("doc_id", "total", "score_5", "average_score", "status"), "doc_id", "left")
    average, severe = F.col("average_score"), F.col("score_5")
    opening = F.array(fill(T["average"], average=general(average), total=F.col("total")))
    return _part(d, "risk", (F.col("status") == "done") & average.isNotNull(), 20 * (5 - average) / 4, opening, F.array(
        _deduct(severe > 0, F.least(severe * 2, F.lit(8)), fill(T["severe"], n=severe))))


def score_business(documents: DataFrame, promoters: DataFrame) -> DataFrame:
    """promoters: holding_pct, shares_pledged (true, false or null), n_concerns."""
    d = documents.select("doc_id").join(promoters.withColumn("__here", F.lit(True)), "doc_id", "left")
    level = holding_level(F.col("holding_pct"))
    holding, pledged = lookup(level, V.HOLDING_POINTS), F.col("shares_pledged")
    pledge = F.when(pledged, 0).when(~pledged, 4).otherwise(2)
    word = F.when(pledged, "yes").when(~pledged, "no").otherwise("not stated")
    governance = F.greatest(F.lit(6) - F.lit(1.5) * F.col("n_concerns"), F.lit(0.0))
    stated = F.coalesce(fill(T["holding_known"], holding=general(F.col("holding_pct"))), F.lit(T["holding_unknown"]))
    opening = F.array(fill(T["holding"], points=holding, reason=stated, level=level), fill(T["pledge"], points=pledge, word=word),
                      fill(T["governance"], points=general(governance), n=F.col("n_concerns")))
    none = F.array(_deduct(F.lit(False), F.lit(0), F.lit("")))
    return _part(d, "business", F.col("__here"), holding + pledge + governance, opening, none)


def score_legal(documents: DataFrame, summary: DataFrame, approvals: DataFrame) -> DataFrame:
    d = (documents.select("doc_id").join(summary.withColumn("__here", F.lit(True)), "doc_id", "left")
         .join(approvals, "doc_id", "left"))
    c = F.col
    share = c("pct_of_net_worth")
    deductions = F.array(
        _deduct(c("n_criminal") > 0, F.least(4 * c("n_criminal"), F.lit(8)), fill(T["criminal"], n=c("n_criminal"))),
        _deduct(c("n_sebi_disciplinary") > 0, F.lit(5), F.lit(T["sebi"])),
        _deduct(c("n_regulatory") > 0, F.least(1.5 * c("n_regulatory"), F.lit(4.5)), fill(T["regulatory"], n=c("n_regulatory"))),
        _deduct(share >= 10, F.when(share >= 25, 5).otherwise(3), fill(T["claims"], share=general(share))),
        _deduct(c("n_not_applied") > 0, F.least(c("n_not_applied"), F.lit(3)), F.lit(T["not_applied"])),
        _deduct(~c("all_material_obtained"), F.lit(2), F.lit(T["approvals_missing"])))
    return _part(d, "legal", c("__here"), F.lit(15.0), _no_text(), deductions, "legal_clean")


def score_offer(documents: DataFrame, metrics: DataFrame, flags: DataFrame) -> DataFrame:
    codes = flags.groupBy("doc_id").agg(F.bool_or(F.col("code") == "promoters_selling").alias("selling"),
                                        F.bool_or(F.col("code") == "vague_use_of_proceeds").alias("vague"))
    d = (documents.select("doc_id").join(metrics.select("doc_id", "offer_for_sale_pct", F.lit(True).alias("__here")), "doc_id", "left")
         .join(codes, "doc_id", "left"))
    ofs = F.col("offer_for_sale_pct")
    deductions = F.array(
        _deduct(ofs >= 25, F.when(ofs >= 50, 5).otherwise(2), fill(T["offer_for_sale"], pct=general(ofs))),
        _deduct(F.col("selling"), F.lit(2), F.lit(T["promoters_selling"])), _deduct(F.col("vague"), F.lit(3), F.lit(T["vague"])))
    return _part(d, "offer", F.col("__here"), F.lit(15.0), _no_text(), deductions, "offer_clean")


def total_score(parts: DataFrame, legal_flags: DataFrame) -> DataFrame:
    """One row per document: score, rating after knockouts, knockouts, incomplete parts, reward, safety, quadrant."""
    p = F.col("points")
    sums = parts.groupBy("doc_id").agg(
        exact_round(F.sum(p.cast("decimal(10,1)")).cast("double"), 1).alias("score"),
        *[F.max(F.when(F.col("part") == name, p)).alias(name) for name in MAX],
        F.bool_or((F.col("part") == "financial") & F.col("complete")).alias("financial_complete"),
        F.collect_set(F.when(~F.col("complete"), F.col("part"))).alias("__incomplete"))
    red = legal_flags.where("severity = 'red' AND code IN ('criminal_cases', 'sebi_action')").select("doc_id").distinct().withColumn("__red", F.lit(True))
    d = sums.join(red, "doc_id", "left")
    weak = F.col("financial_complete") & (F.col("financial") < 0.4 * MAX["financial"])
    knockouts = F.array_compact(F.array(
        F.when(weak, fill(T["knockout_financial"], points=general(F.col("financial")), max=F.lit("30"))),
        F.when(F.col("__red"), T["knockout_legal"])))
    base = first_match([(F.col("score") >= at, label) for at, label in V.RATINGS])
    reward = F.col("financial") / MAX["financial"]
    safety = (F.col("risk") / MAX["risk"] + F.col("legal") / MAX["legal"]) / 2
    labels = F.array(*[F.when(F.array_contains("__incomplete", F.lit(name)), label) for name, label, _ in V.PARTS])
    return d.select(
        "doc_id", "score", F.when((F.size(knockouts) > 0) & (base == "Leans Subscribe"), "Neutral").otherwise(base).alias("rating"),
        F.array_join(knockouts, " | ").alias("knockouts"), F.array_join(F.array_compact(labels), ", ").alias("incomplete"),
        exact_round(reward, 2).alias("reward"), exact_round(safety, 2).alias("safety"),
        F.concat(F.when(reward >= 0.6, "Higher reward").otherwise("Lower reward"), F.lit(", "),
                 F.when(safety >= 0.6, "lower risk").otherwise("higher risk")).alias("quadrant"))

"""Outstanding cases: direction and party from headings, grounding, deduplication, totals, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import exact_round, fill, general, grouped, strip
from prospectra.functions.text import to_million
from prospectra.operators.grounding import number_in
from prospectra.operators.ordered import spread_join


def case_direction(heading: Column, case_type: Column, answered: Column) -> Column:
    """Whether the case is against the party: by its type, else the last direction word of the heading, else the answer."""
    words = F.regexp_extract_all(heading, F.lit(V.DIRECTION_WORDS), F.lit(0))
    nearest = F.lower(F.try_element_at(words, F.lit(-1)))
    return F.when(case_type.isin(*V.ALWAYS_AGAINST), True).otherwise(F.coalesce(nearest == "against", answered))


def case_party(heading: Column, answered: Column) -> Column:
    """The party named by the nearest heading level that names any: a single one, or directors named first."""
    def named(level: Column) -> Column:
        return F.array_compact(F.array(*[F.when(level.rlike(p), party) for party, p in V.HEADING_PARTIES.items()]))

    levels = F.filter(F.transform(F.reverse(F.split(heading, ">")), named), lambda n: F.size(n) > 0)
    nearest = F.get(levels, F.lit(0))
    return F.when((F.size(nearest) == 1) | (F.get(nearest, F.lit(0)) == "director"), F.get(nearest, F.lit(0))).otherwise(answered)


def case_records(cases: DataFrame, shown_pages: Column) -> DataFrame:
    """Cases as stored: grounded amounts in million, settled party and direction, a page that was shown."""
    supported = F.col("amount").isNotNull() & number_in(F.col("amount"), F.col("source_text"))
    amount = F.when(supported, to_million(F.col("amount"), F.col("unit")))
    warning = (F.when(F.col("amount").isNotNull() & ~supported, "amount not on its pages")
               .when(supported & F.col("unit").isNull(), "amount without unit"))
    return cases.select(
        "doc_id", "ord", strip(F.col("heading")).alias("heading"),
        case_party(F.col("heading"), F.col("party")).alias("party"),
        case_direction(F.col("heading"), F.col("type"), F.col("against_party")).alias("against_party"),
        "type", "total_row", F.greatest(F.col("count").cast("long"), F.lit(1).cast("long")).alias("count"),
        exact_round(amount, 3).alias("amount_million"), strip(F.col("summary")).alias("summary"),
        F.when(F.array_contains(shown_pages, F.col("page")), F.col("page")).otherwise(F.array_min(shown_pages)).alias("page"),
        warning.alias("warning"))


def dedupe_cases(records: DataFrame) -> DataFrame:
    """The first of every case seen twice; first rows meet by partial aggregation, not by sorting a group."""
    detail = F.coalesce(F.col("amount_million").cast("string"), F.lower(F.substring("summary", 1, 30)))
    rest = [c for c in records.columns if c not in ("doc_id", "party", "against_party", "type")]
    return (records.groupBy("doc_id", "party", "against_party", "type", detail.alias("__detail"))
            .agg(F.min_by(F.struct(*rest), F.col("ord")).alias("c"))
            .select("doc_id", "party", "against_party", "type", "c.*"))


def mark_totals(cases: DataFrame) -> DataFrame:
    """Adds `in_total_row`: a single case of a party and type for which a total row exists."""
    totals = cases.where("total_row").select("doc_id", "party", "type").distinct().withColumn("__t", F.lit(True))
    marked = spread_join(cases, totals, ["doc_id", "party", "type"], ["ord"], "left")
    return marked.withColumn("in_total_row", ~F.col("total_row") & F.coalesce("__t", F.lit(False))).drop("__t")


def split_cases(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(against the parties, filed by them)."""
    return cases.where("against_party"), cases.where("NOT against_party")


def case_summary(cases: DataFrame, net_worth: DataFrame, **more: Column) -> DataFrame:
    """One row per document: count and amount of core cases by type, totals, share of net worth, and `more` aggregates of its cases."""
    counted = F.col("against_party") & F.col("party").isin(*V.CORE_PARTIES) & ~F.col("in_total_row")
    # three decimals each: exact decimal sums do not depend on the order of addition
    amount = F.col("amount_million").cast("decimal(28,3)")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, amount)).cast("double"), F.lit(0.0))

    zero = F.lit(0).cast("long")
    per_type = []
    for t in V.CASE_TYPES:
        of_type = counted & (F.col("type") == t)
        per_type += [F.coalesce(F.sum(F.when(of_type, F.col("count"))), zero).alias(f"n_{t}"),
                     exact_round(total(of_type), 2).alias(f"amount_{t}")]
    summed = cases.groupBy("doc_id").agg(
        *per_type, exact_round(total(counted), 2).alias("total_amount"),
        F.coalesce(F.sum(F.when(~F.col("against_party") & ~F.col("in_total_row"), F.col("count"))), zero).alias("filed_by_parties"),
        *[aggregate.alias(name) for name, aggregate in more.items()])
    worth = summed.join(net_worth.select("doc_id", "net_worth"), "doc_id", "left")
    return worth.withColumn("pct_of_net_worth", F.when(
        F.col("net_worth") > 0, exact_round(F.col("total_amount") / F.col("net_worth") * 100, 1)))


def legal_flags(summary: DataFrame, approvals: DataFrame) -> DataFrame:
    """(doc_id, ord, severity, code, message) in rule order. approvals: n_pending, n_not_applied, all_material_obtained."""
    T, c = V.LEGAL_FLAG_TEXT, F.col

    def flag(when: Column, severity, code: str, **parts: Column) -> Column:
        severity = severity if isinstance(severity, Column) else F.lit(severity)
        message = fill(T[code], **parts) if parts else F.lit(T[code])
        return F.when(when, F.struct(severity.alias("severity"), F.lit(code).alias("code"), message.alias("message")))

    share = c("pct_of_net_worth")
    rules = F.array(
        flag(c("n_criminal") > 0, "red", "criminal_cases", n=c("n_criminal")),
        flag(c("n_sebi_disciplinary") > 0, "red", "sebi_action"),
        flag(c("n_regulatory") > 0, "amber", "regulatory_actions", n=c("n_regulatory")),
        flag(share >= 10, F.when(share >= 25, "red").otherwise("amber"), "large_claims",
             amount=grouped(c("total_amount"), 1), share=general(share)),
        flag(c("n_tax") > 0, "info", "tax_cases", n=c("n_tax"), amount=grouped(c("amount_tax"), 1)),
        flag(c("n_not_applied") > 0, "amber", "approvals_not_applied", n=c("n_not_applied")),
        flag(c("n_pending") > 0, "info", "approvals_pending", n=c("n_pending")),
        flag(c("all_material_obtained") == F.lit(False), "amber", "approvals_missing"))
    joined = summary.join(approvals, "doc_id", "left")
    return joined.select("doc_id", F.posexplode(F.array_compact(rules)).alias("ord", "f")).select(
        "doc_id", (F.col("ord") + 1).alias("ord"), "f.severity", "f.code", "f.message")

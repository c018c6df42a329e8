"""Offer structure: metrics of the issue and its uses, flags, grounding of extracted numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import exact_round, fill, general, lookup, plain
from prospectra.operators.grounding import number_in


def use_totals(objects: DataFrame) -> DataFrame:
    """Per document, in the offer's own unit: stated uses, the debt repayments among them, general purposes."""
    specific = ~F.col("general_purposes")
    return objects.groupBy("doc_id").agg(
        F.sum(F.when(specific, F.col("amount"))).alias("stated"),
        F.sum(F.when(specific & F.col("purpose").rlike(V.DEBT_PURPOSE), F.col("amount"))).alias("debt"),
        F.sum(F.when(~specific, F.col("amount"))).alias("general"))


def _share(part: Column, whole: Column) -> Column:
    return exact_round(F.try_divide(part, whole) * 100, 1)


def offer_metrics(offers: DataFrame, objects: DataFrame) -> DataFrame:
    """Offers with amounts in million and the percentages the flags rest on (null when unknown)."""
    c, scale = F.col, lookup(F.col("amount_unit"), V.UNITS_TO_MILLION)
    d = offers.join(use_totals(objects), "doc_id", "left").withColumns({
        "fresh_issue_million": c("fresh_issue_amount") * scale, "specified_objects_million": c("stated") * scale,
        "gcp_million": c("general") * scale,
        "debt_repayment_million": F.when(c("debt") != 0, c("debt") * scale)})
    fresh, specified, gcp, debt = c("fresh_issue_million"), c("specified_objects_million"), c("gcp_million"), c("debt_repayment_million")
    return d.withColumns({
        "specified_pct": _share(specified, fresh), "unspecified_pct": _share(fresh - specified, fresh),
        "gcp_pct": _share(gcp, fresh), "debt_pct": _share(debt, specified),
        "offer_for_sale_pct": _share(c("offer_for_sale_shares"), c("fresh_issue_shares") + c("offer_for_sale_shares")),
        "dilution_pct": _share(c("fresh_issue_shares"), c("shares_after_offer"))}).drop("stated", "debt", "general")


def offer_flag_array() -> Column:
    T, c = V.OFFER_FLAG_TEXT, F.col

    def flag(when: Column, severity: str, code: str, text: str | None = None, pct: Column | None = None) -> Column:
        message = F.lit(T[text or code]) if pct is None else fill(T[text or code], pct=general(pct))
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message")))

    ofs, gcp, rest = c("offer_for_sale_pct"), c("gcp_pct"), c("unspecified_pct")
    return F.array_compact(F.array(
        flag(ofs >= 50, "amber", "mostly_offer_for_sale", pct=ofs),
        flag((ofs < 50) & (ofs != 0), "info", "offer_for_sale", pct=ofs),
        flag(c("promoters_selling"), "amber", "promoters_selling"),
        flag(gcp > 20, "amber", "vague_use_of_proceeds", "vague_general_purposes", gcp),
        flag(gcp.isNull() & (rest > 20), "amber", "vague_use_of_proceeds", "vague_unspecified", rest),
        flag(c("debt_pct") >= 50, "info", "mostly_debt_repayment", pct=c("debt_pct")),
        flag(c("dilution_pct").isNotNull(), "info", "dilution", pct=c("dilution_pct"))))


def offer_flags(metrics: DataFrame) -> DataFrame:
    """(doc_id, ord, severity, code, message) in rule order."""
    return metrics.select("doc_id", F.posexplode(offer_flag_array()).alias("ord", "f")).select(
        "doc_id", (F.col("ord") + 1).alias("ord"), "f.severity", "f.code", "f.message")


def ground_offer(offers: DataFrame, fields: Sequence[str], source: str = "source_text") -> DataFrame:
    """Numbers the source does not state become null; `left_out` names them in field order."""
    lost = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & ~number_in(F.col(f), F.col(source)), f) for f in fields]))
    checked = offers.withColumn("left_out", lost)
    return checked.withColumns({f: F.when(~F.array_contains("left_out", F.lit(f)), F.col(f)) for f in fields})


def ground_objects(objects: DataFrame, source: str = "source_text") -> DataFrame:
    """Uses of proceeds whose amount the source does not state lose it, with a warning."""
    lost = F.col("amount").isNotNull() & ~number_in(F.col("amount"), F.col(source))
    warning = fill(V.LEFT_OUT, field=fill(V.OBJECT_FIELD, purpose=F.substring("purpose", 1, 40)), value=plain(F.col("amount")))
    # Two steps: inside a lambda, Spark would take `amount` for the new column of the same projection.
    return objects.withColumn("warning", F.when(lost, warning)).withColumn("amount", F.when(F.col("warning").isNull(), F.col("amount")))


def grounding_warnings(offers: DataFrame, fields: Sequence[str], source: str = "source_text") -> DataFrame:
    """(doc_id, ord, warning): one warning per number that `ground_offer` leaves out, in field order."""
    def warning(i: int, f: str) -> Column:
        value = plain(F.col(f)) if dict(offers.dtypes)[f] == "double" else F.col(f)
        text = fill(V.LEFT_OUT, field=F.lit(f.replace("_", " ")), value=value)
        return F.when(F.col(f).isNotNull() & ~number_in(F.col(f), F.col(source)), F.struct(F.lit(i).cast("long").alias("ord"), text.alias("warning")))

    found = F.array_compact(F.array(*[warning(i, f) for i, f in enumerate(fields)]))
    return offers.select("doc_id", F.inline(found))

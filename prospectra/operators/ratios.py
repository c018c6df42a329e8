"""Ratios, growth, scorecard and flags of every issuer.

Facts arrive long (doc_id, period, item, value) with a period dimension. One pivot and one
grouping by issuer produce `profile`: one row per issuer whose `p` column holds its periods,
newest first. Everything else is an expression over that short array, so scorecard, flags
and growth need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import (
    change_percent, days_of, divide, exact_round, fill, first_match, fixed, grade, growth_per_year, grouped, lit_array, percent,
)

ITEMS = tuple(dict.fromkeys(
    ["revenue_from_operations", "other_income", "finance_costs", "depreciation", "profit_before_tax", "profit_for_period",
     "total_equity", "total_income", "borrowings", "trade_receivables", "inventories", "cash_and_equivalents",
     "total_current_assets", "total_current_liabilities", "total_assets", "operating_cash_flow", "capex"]))


def pivot_items(facts: DataFrame) -> DataFrame:
    """One row per (doc_id, period) with a column per line item (the column list is fixed)."""
    return facts.groupBy("doc_id", "period").pivot("item", list(ITEMS)).agg(F.first("value", ignorenulls=True))


def period_metrics(wide: DataFrame) -> DataFrame:
    """The metrics of a single period; returns and day counts only for full years."""
    c, full = F.col, F.col("full_year")
    revenue, pat, equity, pbt = c("revenue_from_operations"), c("profit_for_period"), c("total_equity"), c("profit_before_tax")
    finance, ocf = c("finance_costs"), c("operating_cash_flow")
    ebitda = pbt + finance + c("depreciation") - F.coalesce(c("other_income"), F.lit(0.0))
    return (wide.withColumn("ebitda", ebitda).withColumns({
        "revenue": revenue,
        "ebitda_margin": percent(c("ebitda"), revenue),
        "pat": pat,
        "pat_margin": percent(pat, revenue),
        "roe": F.when(full & (equity > 0), percent(pat, equity)),
        "receivable_days": F.when(full, days_of(c("trade_receivables"), revenue)),
        "inventory_days": F.when(full, days_of(c("inventories"), revenue)),
        "debt_to_equity": F.when(equity > 0, divide(c("borrowings"), equity)),
        "interest_coverage": F.when(finance != 0, divide(pbt + finance, finance)),
        "current_ratio": divide(c("total_current_assets"), c("total_current_liabilities")),
        "cash_conversion": F.when(pat > 0, divide(ocf, pat)),
        "free_cash_flow": ocf - F.abs(c("capex")),
        "other_income_share": F.when(pbt > 0, percent(c("other_income"), pbt)),
    }))


CARRIED = ("period", "full_year", "y", "m", *ITEMS, "revenue", "ebitda", "ebitda_margin", "pat", "pat_margin", "roe",
           "receivable_days", "inventory_days", "debt_to_equity", "interest_coverage", "current_ratio", "cash_conversion",
           "free_cash_flow", "other_income_share")


def profile(facts: DataFrame, periods: DataFrame) -> DataFrame:
    """doc_id and `p`, its periods with items and metrics, newest first; `full` holds the full years."""
    wide = period_metrics(pivot_items(facts).join(periods, ["doc_id", "period"]))
    packed = F.struct(F.struct(F.negative("y").alias("y"), F.negative("m").alias("m")).alias("key"),
                      F.struct(*CARRIED).alias("v"))
    return (wide.groupBy("doc_id").agg(F.array_sort(F.collect_list(packed)).alias("s"))
            .select("doc_id", F.col("s.v").alias("p"))
            .withColumn("full", F.filter("p", lambda x: x["full_year"])))


# one issuer's arrays: columns by name, so that importing needs no session
P, FULL = "p", "full"


def newest(array: Column) -> Column:
    return F.get(array, F.lit(0))


def oldest(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def with_ends(profiles: DataFrame) -> DataFrame:
    """Adds the newest period of any kind and the first and last full year."""
    return profiles.withColumns({"latest": newest(P), "last": newest(FULL), "first": oldest(FULL)})


def with_growth(profiles: DataFrame) -> DataFrame:
    """Adds years and growth per year of each series between the first and last full year."""
    first, last = F.col("first"), F.col("last")
    named = first["period"].rlike(r"^FY\d{4}$") & last["period"].rlike(r"^FY\d{4}$")
    years = F.when(F.size("full") >= 2, F.when(named, last["y"] - first["y"]).otherwise(F.size("full") - 1))
    out = with_ends(profiles).withColumn("years", years)
    return out.withColumns({f"{s}_cagr": growth_per_year(first[s], last[s], F.col("years")) for s in V.GROWTH_SERIES})


def revenue_growth(profiles: DataFrame) -> DataFrame:
    """(doc_id, period, revenue_growth) between adjacent full years."""
    pairs = F.transform(FULL, lambda x, i: F.struct(
        x["period"].alias("period"), change_percent(F.get(FULL, i + 1)["revenue"], x["revenue"]).alias("revenue_growth"),
        (i < F.size(FULL) - 1).alias("older")))
    return profiles.select("doc_id", F.inline(F.filter(pairs, lambda x: x["older"]))).drop("older")


def growth_rates(profiles: DataFrame) -> DataFrame:
    """Rounded growth per year of the five series, for issuers with at least two full years."""
    g = with_growth(profiles).where("years IS NOT NULL")
    return g.select("doc_id", F.col("first.period").alias("from_period"), F.col("last.period").alias("to_period"), "years",
                    *[exact_round(F.col(f"{s}_cagr"), 2).alias(f"{s}_cagr") for s in V.GROWTH_SERIES])


def metric_values(profiles: DataFrame) -> DataFrame:
    """Long metrics: (doc_id, period, full_year, place, metric, value), rounded, all metrics of all periods.

    `place` orders periods for reading: full years oldest first, then part-years newest first.
    """
    growth = F.transform(FULL, lambda x, i: F.struct(x["period"].alias("k"), change_percent(
        F.get(FULL, i + 1)["revenue"], x["revenue"]).alias("v")))
    part = F.filter(P, lambda x: ~x["full_year"])
    ordered = F.concat(F.reverse(FULL), part)

    def value(x: Column, metric: str) -> Column:
        if metric == "revenue_growth":
            return F.get(F.filter("growth", lambda g: g["k"] == x["period"]), F.lit(0))["v"]
        return x[metric]

    rows = F.flatten(F.transform(ordered, lambda x, i: F.array(*[F.struct(
        x["period"].alias("period"), x["full_year"].alias("full_year"), (i + 1).alias("place"), F.lit(m).alias("metric"),
        exact_round(value(x, m), 2).alias("value")) for m in V.METRICS])))
    return profiles.withColumn("growth", growth).select("doc_id", F.inline(rows))


def metric_table(profiles: DataFrame) -> DataFrame:
    """metric_values without metrics that are missing in every period."""
    m = metric_values(profiles)
    packed = m.groupBy("doc_id", "metric").agg(
        F.array_sort(F.collect_list(F.struct("place", "period", "value"))).alias("v"), F.count("value").alias("n"))
    return packed.where("n > 0").select("doc_id", "metric", F.inline("v"))


def holding_level(holding: Column) -> Column:
    return first_match([(holding >= 50, "high"), (holding >= 26, "moderate"), (holding.isNotNull(), "low")], F.lit("unknown"))


# ------------------------------------------------------------------ scorecard
def _total(field: str) -> Column:
    return F.aggregate(F.filter(FULL, lambda x: x[field].isNotNull()), F.lit(0.0), lambda s, x: s + x[field])


def _periods_where(array: Column, test) -> Column:
    return F.transform(F.filter(array, test), lambda x: x["period"])


def _span() -> Column:
    return F.concat(F.col("first.period"), F.lit("→"), F.col("last.period"))


def scorecard(profiles: DataFrame) -> DataFrame:
    """(doc_id, ord, dimension, signal, reason): seven graded dimensions, or one line when there are no full years."""
    T = V.SCORECARD_TEXT
    d = with_growth(profiles)
    first, last, latest, span = F.col("first"), F.col("last"), F.col("latest"), _span()

    def line(dimension: str, signal: Column, reason: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), signal.alias("signal"), reason.alias("reason"))

    cagr = F.col("revenue_cagr")
    growth = line("growth", grade(cagr, 15, 5), F.coalesce(
        fill(T["growth"], verb=F.when(cagr >= 0, "grew").otherwise("shrank"), cagr=fixed(F.abs(cagr), 1), span=span),
        F.lit(T["growth_unknown"])))

    a, b = first["ebitda_margin"], last["ebitda_margin"]
    unknown = a.isNull() | b.isNull() | F.exists(FULL, lambda x: x["pat"].isNull())
    losses = _periods_where(FULL, lambda x: x["pat"] < 0)
    note = F.when(F.size(losses) > 0, fill(T["losses_in"], years=F.array_join(losses, ", "))).otherwise(T["no_losses"])
    profitability = line("profitability", first_match([
        (unknown, "unknown"), ((last["pat"] < 0) | (b - a <= -3), "negative"),
        ((F.size(losses) == 0) & (b - a >= 1), "positive")], F.lit("neutral")),
        F.when(unknown, T["profitability_unknown"]).otherwise(
            fill(T["profitability"], first=fixed(a, 1), last=fixed(b, 1), span=span, note=note)))

    de, cover = latest["debt_to_equity"], last["interest_coverage"]
    leverage = line("leverage", first_match([
        (de.isNull(), "unknown"), ((de > 1.5) | (cover < 2), "negative"),
        ((de <= 0.5) & (cover.isNull() | (cover >= 3)), "positive")], F.lit("neutral")),
        F.coalesce(fill(T["leverage"], de=fixed(de, 2), latest=latest["period"], cover=F.coalesce(
            fill(T["cover"], cover=fixed(cover, 1), last=last["period"]), F.lit(""))), F.lit(T["leverage_unknown"])))

    current = latest["current_ratio"]
    liquidity = line("liquidity", grade(current, 1.5, 1.0), F.coalesce(
        fill(T["liquidity"], ratio=fixed(current, 2), latest=latest["period"]), F.lit(T["liquidity_unknown"])))

    negative = _periods_where(FULL, lambda x: x["operating_cash_flow"] < 0)
    total_pat, ratio = _total("pat"), divide(_total("operating_cash_flow"), _total("pat"))
    no_cash = ~F.exists(FULL, lambda x: x["operating_cash_flow"].isNotNull())
    cash = line("cash_conversion", first_match([
        (no_cash, "unknown"), (F.size(negative) > 0, "negative"), (total_pat > 0, grade(ratio, 0.8, 0.5))], F.lit("positive")),
        first_match([(no_cash, T["cash_unknown"]),
                     (F.size(negative) > 0, fill(T["cash_negative"], years=F.array_join(negative, ", "))),
                     (total_pat > 0, fill(T["cash_ratio"], ratio=fixed(ratio, 2), span=span))], F.lit(T["cash_positive"])))

    def moved(field: str, text: str) -> tuple[Column, Column]:
        x, y = first[field], last[field]
        return y - x, fill(T[text], a=fixed(x, 0), b=fixed(y, 0))

    receivables, receivable_note = moved("receivable_days", "receivable_note")
    inventory, inventory_note = moved("inventory_days", "inventory_note")
    notes = F.concat_ws("; ", receivable_note, inventory_note)
    capital = line("working_capital", first_match([
        (receivables.isNull() & inventory.isNull(), "unknown"),
        (F.coalesce(receivables >= 20, F.lit(False)) | F.coalesce(inventory >= 20, F.lit(False)) | (last["receivable_days"] >= 120), "negative"),
        (F.coalesce(receivables <= 5, F.lit(True)) & F.coalesce(inventory <= 5, F.lit(True)), "positive")], F.lit("neutral")),
        F.when(receivables.isNull() & inventory.isNull(), T["capital_unknown"]).otherwise(
            F.concat(F.upper(F.substring(notes, 1, 1)), F.substring(notes, F.lit(2), F.length(notes)), F.lit(" ("), span, F.lit(")"))))

    roe = last["roe"]
    returns = line("returns", grade(roe, 15, 8), F.coalesce(
        fill(T["returns"], roe=fixed(roe, 1), last=last["period"]), F.lit(T["returns_unknown"])))

    card = F.when(F.size(FULL) == 0, F.array(line("all", F.lit("unknown"), F.lit(T["no_years"])))).otherwise(
        F.array(growth, profitability, leverage, liquidity, cash, capital, returns))
    return d.select("doc_id", F.posexplode(card).alias("ord", "c")).select(
        "doc_id", (F.col("ord") + 1).alias("ord"), "c.dimension", "c.signal", "c.reason")


# ------------------------------------------------------------------ flags
FLAG_TYPE = "struct<severity:string,code:string,message:string,metrics:array<string>>"


def _flag(when: Column, severity: Column | str, code: str, message: Column, metrics: tuple[str, ...]) -> Column:
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return F.when(when, F.struct(severity.alias("severity"), F.lit(code).alias("code"), message.alias("message"),
                                 lit_array(metrics).alias("metrics")))


def _amounts(array: Column, field: str) -> tuple[Column, Column]:
    """(periods with a negative value, their text)."""
    bad = F.filter(array, lambda x: x[field] < 0)
    text = F.array_join(F.transform(bad, lambda x: fill(
        V.FINANCIAL_FLAG_TEXT["period_amount"], period=x["period"], amount=grouped(x[field], 1))), ", ")
    return bad, text


def _jumps() -> Column:
    """One amber flag per pair of neighbouring periods in which an item moved threefold."""
    T = V.FINANCIAL_FLAG_TEXT

    def pairs(array: Column) -> Column:
        return F.transform(F.slice(array, 1, F.greatest(F.size(array) - 1, F.lit(0))), lambda x, i: F.struct(
            x.alias("b"), F.get(array, i + 1).alias("a")))

    def change(pair: Column, item: str) -> Column:
        a, b, assets = pair["a"][item], pair["b"][item], pair["b"]["total_assets"]
        ratio = b / a
        sharp = (a > 0) & (b > 0) & (assets != 0) & ((ratio >= V.JUMP_RATIO) | (ratio <= 1 / V.JUMP_RATIO)) & (
            F.abs(b - a) >= V.JUMP_MIN_SHARE * assets)
        name = F.lit(V.JUMP_ITEMS[item])
        up = fill(T["jump_up"], name=name, ratio=fixed(ratio, 1), a=grouped(a, 1), b=grouped(b, 1))
        down = fill(T["jump_down"], name=name, drop=fixed((1 - ratio) * 100, 0), a=grouped(a, 1), b=grouped(b, 1))
        return F.when(sharp, F.when(ratio > 1, up).otherwise(down))

    balance = [i for i in V.JUMP_ITEMS if i not in V.FLOW_ITEMS]

    def found(array: Column, items: list[str], kind: int) -> Column:
        return F.transform(pairs(array), lambda pair: F.struct(
            F.array_position(F.transform(P, lambda x: x["period"]), pair["b"]["period"]).alias("at"), F.lit(kind).alias("kind"),
            pair["a"]["period"].alias("older"), pair["b"]["period"].alias("newer"),
            F.array_compact(F.array(*[change(pair, i) for i in items])).alias("parts")))

    flows = found(FULL, list(V.FLOW_ITEMS), 1)
    # flow changes join the balance changes of the same pair; pairs only the full years have follow
    same = F.transform(found(P, balance, 0), lambda x: F.struct(
        x["at"].alias("at"), x["kind"].alias("kind"), x["older"].alias("older"), x["newer"].alias("newer"),
        F.concat(x["parts"], F.coalesce(F.get(F.filter(flows, lambda f: (f["older"] == x["older"]) & (f["newer"] == x["newer"])), F.lit(0))["parts"],
                                        F.array().cast("array<string>"))).alias("parts")))
    extra = F.filter(flows, lambda f: ~F.exists(pairs(P), lambda x: (x["a"]["period"] == f["older"]) & (x["b"]["period"] == f["newer"])))
    moved = F.array_sort(F.filter(F.concat(same, extra), lambda x: F.size(x["parts"]) > 0))
    return F.transform(moved, lambda x: F.struct(
        F.lit("amber").alias("severity"), F.lit("unusual_jump").alias("code"),
        fill(T["unusual_jump"], older=x["older"], newer=x["newer"], parts=F.array_join(x["parts"], "; ")).alias("message"),
        F.array().cast("array<string>").alias("metrics")))


def _red_first(flags: Column) -> Column:
    return F.concat(F.filter(flags, lambda f: f["severity"] == "red"), F.filter(flags, lambda f: f["severity"] != "red"))


def flag_rows(df: DataFrame, flags: Column, *keep: str) -> DataFrame:
    return df.select("doc_id", *keep, F.posexplode(flags).alias("ord", "f")).select(
        "doc_id", *keep, (F.col("ord") + 1).alias("ord"), "f.*")


def unusual_jumps(profiles: DataFrame) -> DataFrame:
    return flag_rows(profiles, _jumps())


def financial_flags(profiles: DataFrame) -> DataFrame:
    """(doc_id, ord, severity, code, message, metrics), red flags first, otherwise in rule order."""
    T = V.FINANCIAL_FLAG_TEXT
    d = with_growth(profiles)
    first, last, latest = F.col("first"), F.col("last"), F.col("latest")
    fp, lp, tp = first["period"], last["period"], latest["period"]

    losses, loss_text = _amounts(P, "pat")
    outflows, outflow_text = _amounts(P, "operating_cash_flow")
    total_pat, total_ocf = _total("pat"), _total("operating_cash_flow")
    a, b = first["ebitda_margin"], last["ebitda_margin"]
    de, de_first = latest["debt_to_equity"], first["debt_to_equity"]
    debt_growth, revenue_growth_, receivable_growth = F.col("borrowings_cagr"), F.col("revenue_cagr"), F.col("trade_receivables_cagr")
    cover, current = last["interest_coverage"], latest["current_ratio"]
    days_a, days_b = first["receivable_days"], last["receivable_days"]
    rose = F.coalesce(de - de_first >= 0.3, F.lit(False))
    heavy = F.filter(FULL, lambda x: x["other_income_share"] >= 25)
    heavy_text = F.array_join(F.transform(heavy, lambda x: fill(
        T["share_in_period"], share=fixed(x["other_income_share"], 0), period=x["period"])), ", ")

    rules = F.array(
        _flag(F.size(losses) > 0, "red", "losses", fill(T["losses"], list=loss_text), ("pat",)),
        _flag(F.size(outflows) > 0, F.when(F.exists(outflows, lambda x: x["full_year"]), "red").otherwise("amber"),
              "negative_cash_flow", fill(T["negative_cash_flow"], list=outflow_text), ("operating_cash_flow",)),
        _flag((F.size(outflows) == 0) & (F.size(FULL) > 0) & (total_pat > 0) & (divide(total_ocf, total_pat) < 0.5), "amber",
              "weak_cash_conversion", fill(T["weak_cash_conversion"], share=fixed(percent(total_ocf, total_pat), 0), first=fp, last=lp),
              ("cash_conversion",)),
        _flag(b - a <= -3, F.when(b - a <= -6, "red").otherwise("amber"), "falling_margin",
              fill(T["falling_margin"], a=fixed(a, 1), first=fp, b=fixed(b, 1), last=lp), ("ebitda_margin",)),
        _flag(de > 1.0, F.when(de > 1.5, "red").otherwise("amber"), "high_debt",
              fill(T["high_debt"], de=fixed(de, 2), latest=tp), ("debt_to_equity",)),
        _flag(rose, "amber", "rising_debt",
              fill(T["rising_debt"], a=fixed(de_first, 2), first=fp, b=fixed(de, 2), latest=tp), ("debt_to_equity",)),
        _flag(~rose & (debt_growth - revenue_growth_ >= 10), "amber", "rising_debt",
              fill(T["rising_debt_growth"], debt=fixed(debt_growth, 1), revenue=fixed(revenue_growth_, 1), first=fp, last=lp),
              ("debt_to_equity", "revenue_growth")),
        _flag(cover < 2, F.when(cover < 1.5, "red").otherwise("amber"), "low_interest_cover",
              fill(T["low_interest_cover"], cover=fixed(cover, 1), last=lp), ("interest_coverage",)),
        _flag(current < 1, "amber", "low_liquidity", fill(T["low_liquidity"], ratio=fixed(current, 2), latest=tp), ("current_ratio",)),
        _flag((receivable_growth - revenue_growth_ >= 10) & (days_b - days_a >= 10), "amber", "receivables_outpacing_revenue",
              fill(T["receivables_outpacing_revenue"], receivables=fixed(receivable_growth, 1), revenue=fixed(revenue_growth_, 1),
                   a=fixed(days_a, 0), b=fixed(days_b, 0), first=fp, last=lp), ("receivable_days", "revenue_growth")),
        _flag(days_b >= 120, "amber", "slow_collections", fill(T["slow_collections"], days=fixed(days_b, 0), last=lp), ("receivable_days",)),
        _flag(F.size(heavy) > 0, "amber", "other_income_dependence", fill(T["other_income_dependence"], list=heavy_text),
              ("other_income_share",)))
    flagged = d.withColumn("flags", F.concat(F.array_compact(rules), _jumps()))
    return flag_rows(flagged, _red_first(F.col("flags")))

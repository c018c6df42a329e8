"""Small column builders shared by every operator: rounding, formatting, templates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_array(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values])


def first_match(rules: Iterable[tuple[Column, object]], default: Column | None = None) -> Column:
    """The value of the first rule whose condition holds, as one CASE expression."""
    chain = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain if default is None else chain.otherwise(default)


def lookup(key: Column, table: Mapping, default: Column | None = None) -> Column:
    return first_match([(key == F.lit(k), v) for k, v in table.items()], default)


def fixed(value: Column, digits: int) -> Column:
    """Plain decimals, ties decided on the exact binary value (half to even)."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    value = value.cast("double")
    text = F.call_function("format_number", value, F.lit(pattern))
    if digits < 3:
        return text
    # Java takes 0.0005, 0.00005 and so on for ties, which no double of them is.
    half = 5 / 10 ** (digits + 1)
    return lookup(value, {h: f"{h:.{digits}f}" for h in (half, -half)}, text)


def grouped(value: Column, digits: int) -> Column:
    """Decimals with thousands separators."""
    return F.format_number(value.cast("double"), digits)


def general(value: Column) -> Column:
    """Six significant digits without trailing zeros."""
    value = value.cast("double")
    size = F.abs(value)
    digits = F.greatest(F.lit(0), F.least(F.lit(9), 5 - F.floor(F.coalesce(F.log10(size), F.lit(0.0))))).cast("int")
    plain = F.regexp_replace(F.call_function("format_number", value, digits), ",", "")
    trimmed = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    large = F.regexp_replace(F.call_function("format_number", value, F.lit("0.#####E00")), "E", "e+")
    return F.when(size >= 999999.5, large).otherwise(trimmed)


def plain(value: Column) -> Column:
    """The shortest decimals that name the double, without an exponent below 1e16: 12.0, 0.1, 25000000.0."""
    text = value.cast("double").cast("string")
    long = F.regexp_replace(F.regexp_replace(text.cast("decimal(38,16)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(text.contains("E") & (F.abs(value) < 1e16), long).otherwise(text)


def exact_round(value: Column, digits: int) -> Column:
    """Correctly rounded decimal value (half to even on the exact binary value); -0.0 becomes 0.0."""
    return fixed(value, digits).cast("double") + F.lit(0.0)


def fill(template: str, **parts: Column) -> Column:
    """A message from a text template; a null part makes the message null."""
    pieces = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field:
            pieces.append(parts[field].cast("string"))
    return F.concat(*pieces)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def divide(a: Column, b: Column) -> Column:
    """Quotient, null when a side is missing or the divisor is zero."""
    return F.try_divide(a, b)


def percent(a: Column, b: Column) -> Column:
    return divide(a, b) * 100


def days_of(balance: Column, revenue: Column) -> Column:
    return divide(balance, revenue) * 365


def change_percent(old: Column, new: Column) -> Column:
    return F.when(old > 0, (new / old - 1) * 100)


def growth_per_year(first: Column, last: Column, years: Column) -> Column:
    """Compound annual growth in percent; defined only for positive ends and a positive span."""
    return F.when((first > 0) & (last > 0) & (years > 0), (F.pow(last / first, F.lit(1.0) / years) - 1) * 100)


def grade(value: Column, good: float, bad: float) -> Column:
    return (F.when(value.isNull(), "unknown").when(value >= good, "positive").when(value < bad, "negative")
            .otherwise("neutral"))


def bind(value: Column, body) -> Column:
    """body(v) with v computed once, for expressions that use a costly value several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df, **columns: Column):
    """Adds columns that are computed exactly once per row.

    Plain projections may be merged, or copied into filters above them, and then run a costly
    array expression again for every use; a one-row generator is left in place.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))

"""Golden facts against saved results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V


MISSING = "MISSING"


def resolve_path(payload: Column, path: Column) -> Column:
    """The value at a path such as a.b[0].c as text (objects and lists as JSON), null for JSON's null, and MISSING where the payload has no such
    path or is not JSON."""
    at = F.concat(F.lit("$."), path)
    found = F.variant_get(F.try_parse_json(payload), at, "variant")
    text = F.coalesce(F.try_variant_get(found, "$", "string"), F.to_json(found))
    return F.when(found.isNull(), F.lit(MISSING)).when(~F.is_variant_null(found), text)


def matches(kind: Column, expected: Column, actual: Column) -> Column:
    """Booleans match exactly, numbers within max(0.5 %, 0.01), everything else when equal (all given as text)."""
    e, a = expected.try_cast("double"), actual.try_cast("double")
    near = F.abs(a - e) <= F.greatest(F.abs(e) * V.ACCURACY_TOLERANCE, F.lit(V.ACCURACY_ABSOLUTE))
    return F.coalesce(F.when((kind == "number") & a.isNotNull(), near).otherwise(expected.eqNullSafe(actual)), F.lit(False))


def accuracy_report(checked: DataFrame) -> DataFrame:
    """Passed and total checks per document and overall (doc_id null). checked: doc_id, ok."""
    return checked.rollup("doc_id").agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))

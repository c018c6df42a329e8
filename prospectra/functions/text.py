"""Scalar text functions as Catalyst expressions (no Python runs per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import first_match, lit_array, lookup, strip

ANY_DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise_title(text: Column) -> Column:
    return F.upper(collapse_ws(F.translate(text, "’‘–—", "''--")))


def looks_like_heading(line: Column) -> Column:
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    capitals = F.regexp_count(line, F.lit(r"\p{Lu}"))
    return (letters >= 3) & (capitals / F.greatest(letters, F.lit(1)) > 0.8)


def tokenise(text: Column) -> Column:
    """Lower-case words without stopwords, a plural "s" dropped."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)),
                     lambda w: ~w.isin(*V.STOPWORDS))
    return F.transform(words, lambda w: F.when(
        (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def estimate_tokens(text: Column) -> Column:
    digits = F.regexp_count(text, F.lit(ANY_DIGIT))
    return (F.floor((F.length(text) - digits) / 4) + digits + 1).cast("long")


def shorten(text: Column, words: int = V.HEADLINE_WORDS) -> Column:
    parts = F.split(collapse_ws(text), " ")
    return F.concat(F.array_join(F.slice(parts, 1, words), " "),
                    F.when(F.size(parts) > words, "…").otherwise(""))


def preview(text: Column, chars: int = V.PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, chars)


def without_section_prefix(title: Column) -> Column:
    return normalise_title(F.regexp_replace(title, V.SECTION_PREFIX, ""))


def section_key(title: Column) -> Column:
    name = without_section_prefix(title)
    return first_match([(name.rlike(p), key) for key, p in V.SECTION_PATTERNS.items()])


def is_skipped_section(title: Column) -> Column:
    return title.isNull() | without_section_prefix(title).rlike(V.SKIPPED_SECTIONS)


def clean_label(text: Column) -> Column:
    return F.regexp_replace(F.lower(collapse_ws(text)), V.LABEL_MARKERS, "")


def parse_value(cell: Column) -> Column:
    """A printed amount as a number: nil words are 0, brackets or a minus sign negate, other text is null."""
    bare = strip(F.regexp_replace(F.regexp_replace(cell, "[₹ ]", ""), r"[*#^]+$", ""))
    digits = F.regexp_replace(bare, r"[(),-]", "")
    value = digits.try_cast("double")
    return first_match([
        (F.lower(bare).isin(*V.NIL_WORDS), F.lit(0.0)),
        (bare.contains("%") | ~bare.rlike(V.NUMBER_CELL), F.lit(None).cast("double")),
        (bare.startswith("(") | bare.startswith("-"), F.negative(value)),
    ], value)


def looks_like_year(value: Column) -> Column:
    low, high = V.YEAR_RANGE
    return (value == F.floor(value)) & value.between(low, high)


_MONTH = "|".join(V.MONTHS)
PERIOD = (rf"(?i)({_MONTH})\s+(\d{{1,2}}),?\s+(\d{{4}})"
          rf"|(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH}),?\s+(\d{{4}})"
          rf"|Fiscal\s+(\d{{4}})")
PERIOD_TYPE = "array<struct<label:string,full_year:boolean,y:int,m:int>>"


def parse_periods(text: Column) -> Column:
    """Every period named in a text, left to right, as (label, full_year, y, m)."""
    def read(hit: Column) -> Column:
        def part(*groups: int) -> Column:
            return F.concat(*[F.regexp_extract(hit, PERIOD, g) for g in groups])

        month, day, year, fiscal = F.initcap(part(1, 5)), part(2, 4), part(3, 6), part(7)
        number = F.array_position(lit_array(V.MONTHS), month).cast("int")
        full = (fiscal != "") | ((month == "March") & (day == "31"))
        any_year = F.when(fiscal != "", fiscal).otherwise(year)
        label = F.when(full, F.concat(F.lit("FY"), any_year)).otherwise(
            F.concat(F.substring(month, 1, 3), F.lit(" "), day, F.lit(", "), year))
        return F.struct(label.alias("label"), full.alias("full_year"), any_year.cast("int").alias("y"),
                        F.when(full, 3).otherwise(number).alias("m"))

    return F.transform(F.regexp_extract_all(text, F.lit(PERIOD), F.lit(0)), read)


def figures(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(V.FIGURE), F.lit(0)),
                       lambda f: F.replace(f, F.lit(","), F.lit("")))


def strip_inline_ids(text: Column) -> Column:
    return strip(F.regexp_replace(text, V.INLINE_FACT_IDS, ""))


def to_million(amount: Column, unit: Column) -> Column:
    """Amount in million; null when the amount or its unit is missing."""
    return amount * lookup(unit, V.UNITS_TO_MILLION)


def detect_unit(text: Column) -> Column:
    lowered = F.lower(text)
    return first_match([(lowered.rlike(rf"(?U)in\s+{unit}"), unit) for unit in V.UNIT_SEARCH_ORDER],
                       F.lit("million"))


def page_link(printed_page: Column, offset: Column) -> Column:
    return printed_page + offset + 1


def match_line_item(statement: Column, label: Column, parent: Column) -> Column:
    """The row's own label first, then heading row + label; the first rule of the statement wins."""
    def item_of(text: Column) -> Column:
        return first_match([((statement == name) & text.rlike(pattern), item)
                            for name, rules in V.LINE_ITEMS.items() for item, pattern in rules.items()])

    # both candidates pass through one rule chain inside a lambda, which keeps generated code small
    candidates = F.array_compact(F.array(clean_label(label), F.when(parent != "", clean_label(F.concat_ws(" ", parent, label)))))
    return F.get(F.array_compact(F.transform(candidates, item_of)), F.lit(0))


def similarity_from_distance(distance: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - distance / 2))


def number_text(value: Column) -> Column:
    """How a number is looked up in a source: whole numbers without decimals, others with up to four."""
    value = value.cast("double")
    return F.call_function("format_number", value, F.lit("0.####"))

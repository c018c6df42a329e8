"""Which domain a document belongs to: stated, named by a model reply, or counted from keywords."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import first_match, lit_array


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """Number of different keywords present as whole words.

    The plain containment test is cheap and rules out nearly every keyword before a
    pattern runs. The keyword lists are fixed rules, so this stays a map-only expression.
    """
    hits = [F.when(F.contains(text, F.lit(word)), text.rlike(rf"(?U)\b{re.escape(word)}\b").cast("int")).otherwise(0)
            for word in keywords]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return total


def domain_scores(text: Column, rules: Mapping[str, Sequence[str]] = V.DOMAIN_KEYWORDS) -> dict[str, Column]:
    lowered = F.lower(text)
    return {domain: keyword_hits(lowered, words) for domain, words in rules.items()}


def best_domain(scores: Mapping[str, Column]) -> Column:
    """Highest score; ties go to the domain declared first; no hit at all falls back."""
    best = F.greatest(*scores.values())
    return first_match([(best == 0, V.FALLBACK_DOMAIN)] + [(score == best, domain) for domain, score in scores.items()])


def parse_label(reply: Column) -> Column:
    """The domain a reply names, if it names exactly one."""
    named = F.array_intersect(F.regexp_extract_all(F.lower(reply), F.lit("[a-z]+"), F.lit(0)), lit_array(V.DOMAINS))
    return F.when(F.size(named) == 1, F.element_at(named, 1))


def resolve_domain(chosen: Column, label: Column, by_keywords: Column) -> tuple[Column, Column]:
    """(domain, detected_by): the user's choice, else the model's label, else the keywords."""
    domain = F.coalesce(chosen, label, by_keywords)
    return domain, first_match([(chosen.isNotNull(), "user"), (label.isNotNull(), "llm")], F.lit("keywords"))

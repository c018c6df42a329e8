"""Every registered query, by area."""

from __future__ import annotations

import importlib

from prospectra.plans.registry import Registry

AREAS = ("text_queries", "chunk_queries", "search_queries", "store_queries", "ratio_queries", "statement_queries", "register_queries", "structure_queries", "score_queries", "job_queries")


def catalogue() -> Registry:
    registry = Registry()
    for area in AREAS:
        importlib.import_module(f"prospectra.plans.{area}").register(registry)
    return registry

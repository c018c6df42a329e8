"""The operators of this package by query name, with their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from prospectra.llm import chat, decontamination, embeddings, lexical, lm, packing, pii, quality, secrets, sharding, simhash, sketches, whitening
from prospectra.plans.registry import Registry


def register(registry: Registry) -> None:
    registry.add("op1_secret_scan", secrets.op1_secret_scan)
    registry.add("op2_decontamination", decontamination.op2_decontamination, decontamination.OP2_SQL)
    registry.add("op3_chat_format", chat.op3_chat_format, chat.OP3_SQL)
    registry.add("op4_simhash", simhash.op4_simhash)
    registry.add("op5_sharding", sharding.op5_sharding)
    registry.add("op6_embedding_dedup", embeddings.op6_embedding_dedup)
    registry.add("op7_quality", quality.op7_quality)
    registry.add("op8_lm_score", lm.op8_lm_score, lm.OP8_SQL)
    registry.add("op9_personal_data", pii.op9_personal_data)
    registry.add("op10_packing", packing.op10_packing)
    registry.add("op11_whitening", whitening.op11_whitening)
    registry.add("op12_fingerprints", sketches.op12_fingerprints)
    registry.add("op13_lexical_search", lexical.op13_lexical_search, lexical.OP13_SQL)
    registry.add("pipeline", corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)

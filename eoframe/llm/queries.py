"""Loads every operator module, which registers its query."""

from __future__ import annotations

from . import (  # noqa: F401
    decontamination,
    embedding_dedup,
    jaccard_join,
    language_id,
    lm_scoring,
    periodic_runs,
    pii,
    sentencepiece,
    sharding,
    substring_dedup,
    token_counts,
    tokenizer_alignment,
    toxicity,
)
from .registry import ORACLES, QUERIES  # noqa: F401

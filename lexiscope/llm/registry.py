"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from lexiscope.llm import q_alignment, q_decontaminate, q_fingerprints, q_html, q_langid, q_lexical, q_mixing, q_neardup, q_secrets, q_sharding, q_tokens, q_topk, q_toxicity

_MODULES = (q_sharding, q_mixing, q_decontaminate, q_tokens, q_secrets, q_langid, q_toxicity, q_topk, q_neardup, q_html, q_lexical, q_fingerprints, q_alignment)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}

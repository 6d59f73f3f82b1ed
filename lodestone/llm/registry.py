"""The queries of the training-data operators."""

from __future__ import annotations

from lodestone.llm import op1_decontaminate, op10_ppm, op11_jaccard, op12_divergence, op13_whiten, op2_simhash, op3_mix, op4_lines, op5_tokens, op6_language, op7_quality, op8_passages, op9_urls

_MODULES = [op1_decontaminate, op10_ppm, op11_jaccard, op12_divergence, op13_whiten, op2_simhash, op3_mix, op4_lines, op5_tokens, op6_language, op7_quality, op8_passages, op9_urls]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: x for m in _MODULES for k, x in m.ORACLES.items()}

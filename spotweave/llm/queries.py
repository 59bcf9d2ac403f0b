"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import embeddings, html, jaccard, langid, packing, quality, rules, sentencepiece, sharding, toxicity

QUERIES = {
    "op1_bayes_jaccard_join": jaccard.op1_query,
    "op2_composite_text_density": html.op2_query,
    "op5_ordinal_toxicity": toxicity.op5_query,
    "op6_attention_quality": quality.op6_query,
    "op7_perplexity_rules": rules.op7_query,
    "op3_viterbi_sentencepiece": sentencepiece.op3_query,
    "op4_best_two_fit_packing": packing.op4_query,
    "op8_spherical_cap_near_dedup": embeddings.op8_query,
    "op9_hypergeometric_sharding": sharding.op9_query,
    "op10_bitmask_language_id": langid.op10_query,
}
ORACLES: dict[str, str] = {}

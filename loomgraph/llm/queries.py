"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, language, mixing, near_dedup, packing, passages, quality, tokens, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_warc": warc.op2_warc,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality": quality.op4_quality,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_mixing": mixing.op6_mixing,
    "op7_passages": passages.op7_passages,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_language": language.op9_language,
    "op10_packing": packing.op10_packing,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_quality": quality.ORACLE,
    "op6_mixing": mixing.ORACLE,
}

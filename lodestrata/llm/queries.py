"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from .codes import op11_vector_codes
from .html import op1_html_extraction
from .langid import op8_language_id
from .merkle import op12_merkle_manifest
from .neighbours import op13_neighbours
from .packing import op9_packing
from .pii import op6_pii
from .quality import op5_quality_rules
from .sampling import op2_sentencepiece_sampling
from .simhash import op10_simhash
from .substring import op3_substring_dedup
from .tokencount import op7_token_counts
from .topk import op4_exact_topk

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_sentencepiece_sampling": op2_sentencepiece_sampling,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_topk": op4_exact_topk,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_neighbours": op13_neighbours,
}

ORACLES: dict[str, str] = {}

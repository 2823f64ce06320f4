"""The registered queries of the training-data operators."""

from __future__ import annotations

from .alignment import op11_token_alignment
from .chunks import op3_chunk_dedup
from .fingerprint import op7_multiset_fingerprint
from .isolation import op12_isolation_rules
from .language import op4_language_codes
from .lines import op5_line_runs
from .lm import op1_context_mixing
from .manifest import ORACLE as MANIFEST_ORACLE
from .manifest import op13_merkle_manifest
from .mixing import op6_mix_sources
from .ngram_join import op10_ngram_jaccard
from .packing import op9_cost_balanced_packing
from .shards import op2_hypergeometric_shards
from .topk import ORACLE as TOPK_ORACLE
from .topk import op8_impact_topk

QUERIES = {
    "op1_context_mixing": op1_context_mixing,
    "op2_hypergeometric_shards": op2_hypergeometric_shards,
    "op3_chunk_dedup": op3_chunk_dedup,
    "op4_language_codes": op4_language_codes,
    "op5_line_runs": op5_line_runs,
    "op6_mix_sources": op6_mix_sources,
    "op7_multiset_fingerprint": op7_multiset_fingerprint,
    "op8_impact_topk": op8_impact_topk,
    "op9_cost_balanced_packing": op9_cost_balanced_packing,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_token_alignment": op11_token_alignment,
    "op12_isolation_rules": op12_isolation_rules,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {"op8_impact_topk": TOPK_ORACLE, "op13_merkle_manifest": MANIFEST_ORACLE}

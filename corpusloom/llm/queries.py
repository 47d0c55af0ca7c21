"""Queries of the training-data operators, each over whole tables."""

from __future__ import annotations

from .bpe import op2_byte_bpe
from .embedding_dedup import op10_embedding_dedup
from .fingerprints import op5_fingerprints
from .licenses import op4_license_scan
from .lm import op11_lm_scoring
from . import importance, merkle, ngram_join
from .importance import op12_importance_resampling
from .merkle import op13_merkle_manifest
from .ngram_join import op3_ngram_join
from .packing import op9_packing
from .pii import op8_pii
from .sharding import op1_sharding
from .suffix_dedup import op7_suffix_dedup
from .toxicity import op6_toxicity


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_ngram_join": op3_ngram_join,
        "op4_license_scan": op4_license_scan,
        "op5_fingerprints": op5_fingerprints,
        "op6_toxicity": op6_toxicity,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_pii": op8_pii,
        "op9_packing": op9_packing,
        "op10_embedding_dedup": op10_embedding_dedup,
        "op11_lm_scoring": op11_lm_scoring,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": ngram_join.SQL, "op12_importance_resampling": importance.SQL, "op13_merkle_manifest": merkle.SQL}

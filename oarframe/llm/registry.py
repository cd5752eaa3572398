"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import OP5_SQL, op5_one_bit_neighbours
from .langid import op4_language_id
from .lexical import OP12_SQL, op12_block_ranked_search
from .license_scan import op7_license_scan
from .lm_score import OP10_SQL, op10_backoff_scores
from .media import op6_webp_columns
from .minhash import op1_minhash_dedup
from .mixing import OP9_SQL, op9_temperature_mix
from .secret_scan import op8_secret_scan
from .sentencepiece_bpe import op3_sentencepiece
from .sharding import op2_ring_shards
from .simhash import op11_simhash_dedup
from .spelling import op13_spelling_variants

_QUERIES = [
    op1_minhash_dedup,
    op2_ring_shards,
    op3_sentencepiece,
    op4_language_id,
    op5_one_bit_neighbours,
    op6_webp_columns,
    op7_license_scan,
    op8_secret_scan,
    op9_temperature_mix,
    op10_backoff_scores,
    op11_simhash_dedup,
    op12_block_ranked_search,
    op13_spelling_variants,
]
_SQL: dict[str, str] = {"op5_one_bit_neighbours": OP5_SQL, "op9_temperature_mix": OP9_SQL, "op10_backoff_scores": OP10_SQL, "op12_block_ranked_search": OP12_SQL}


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    return dict(_SQL)

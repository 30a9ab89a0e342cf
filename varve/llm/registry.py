"""The subpackage's queries and their SQL."""

from __future__ import annotations

from ..jobs.shipping import shipped
from . import bit_slices, byte_bpe, kd_shards, line_quality, ngram_join, packing, prefix_trie, pseudonyms, reference_automata, repair, simhash, spelling, substring_dedup, toxicity

_MODULES = (repair, bit_slices, ngram_join, toxicity, pseudonyms, kd_shards, line_quality, packing, substring_dedup, reference_automata, byte_bpe, simhash, prefix_trie, spelling)


def queries() -> dict:
    return {k: shipped(f) for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

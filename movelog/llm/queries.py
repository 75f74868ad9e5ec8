"""The registered queries of this subpackage and the SQL that DuckDB can hold against them."""

from __future__ import annotations

from . import op01_warc, op02_near_dedup, op03_bpe, op04_toxicity, op05_avi, op06_token_counts, op07_url_filter, op08_mixing, op09_lm_scoring, op10_edit_fingerprint, op11_jaccard_join, op12_hard_negatives, op13_alignment

_MODULES = (op01_warc, op02_near_dedup, op03_bpe, op04_toxicity, op05_avi, op06_token_counts, op07_url_filter, op08_mixing, op09_lm_scoring, op10_edit_fingerprint, op11_jaccard_join, op12_hard_negatives, op13_alignment)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

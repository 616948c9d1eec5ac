"""The queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from tickerloom.llm import bpe, language, licenses, merges, mixing, multi_index, periods, quality, rollup, simhash, token_store, treaps, weighted_sampling

QUERIES = {
    "op1_token_store": token_store.op1,
    "op2_weighted_fingerprints": weighted_sampling.op2,
    "op3_page_language": language.op3,
    "op4_license_scan": licenses.op4,
    "op5_multi_index_search": multi_index.op5,
    "op6_quality_scores": quality.op6,
    "op7_token_rollup": rollup.op7,
    "op8_byte_bpe": bpe.op8,
    "op9_simhash_groups": simhash.op9,
    "op10_source_mix": mixing.op10,
    "op11_merge_rounds": merges.op11,
    "op12_inverted_treaps": treaps.op12,
    "op13_periodic_runs": periods.op13,
}

ORACLE_SQL = {
    "op10_source_mix": mixing.OP10_SQL,
    "op12_inverted_treaps": treaps.OP12_SQL,
}

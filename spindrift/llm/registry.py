"""The registered queries of this package, and their SQL for DuckDB."""

from __future__ import annotations

from . import decontaminate, hilbert, html, lines, minhash, nearest, packing, passages, reputation, toxicity

QUERIES = {
    "op1_toxicity_fm": toxicity.op1_toxicity_fm,
    "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
    "op3_hilbert_shards": hilbert.op3_hilbert_shards,
    "op4_cutting_stock_packing": packing.op4_cutting_stock_packing,
    "op8_line_dedup": lines.op8_line_dedup,
    "op5_learned_partition_search": nearest.op5_learned_partition_search,
    "op6_compact_window_passages": passages.op6_compact_window_passages,
    "op7_host_reputation": reputation.op7_host_reputation,
    "op10_spaced_seed_decontamination": decontaminate.op10_spaced_seed_decontamination,
    "op9_html_main_text": html.op9_html_main_text,
}
# The others have no SQL that is fast on whole tables; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op7_host_reputation": reputation.ORACLE}

"""Queries of the corpus operators by name, and the SQL that gives the same rows."""

from __future__ import annotations

from sitegauge.llm import (
    bpe, decontaminate, embedding_dedup, hard_negatives, language_id, minhash_dedup, quality, secret_scan, sharding, token_counts, toxicity, turn_repair, url_filter,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_url_verdicts": url_filter.op2_url_verdicts,
    "op3_secret_spans": secret_scan.op3_secret_spans,
    "op4_benchmark_passages": decontaminate.op4_benchmark_passages,
    "op5_shuffled_shards": sharding.op5_shuffled_shards,
    "op6_section_tokens": token_counts.op6_section_tokens,
    "op7_quality": quality.op7_quality,
    "op8_bpe_round_trip": bpe.op8_bpe_round_trip,
    "op9_near_duplicates": minhash_dedup.op9_near_duplicates,
    "op10_embedding_links": embedding_dedup.op10_embedding_links,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "op13_language_id": language_id.op13_language_id,
}

ORACLES: dict[str, str] = {
    "op2_url_verdicts": url_filter.ORACLE,
    "op3_secret_spans": secret_scan.ORACLE,
    "op4_benchmark_passages": decontaminate.ORACLE,
    "op9_near_duplicates": minhash_dedup.ORACLE,
    "op10_embedding_links": embedding_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_turn_repair": turn_repair.ORACLE,
}

"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from quadrille.llm import contamination, exact_dedup, html_extract, lm, mixing, near_dedup, packing, quality, sharding, spelling, token_counts, topk, vector_codes


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_html_extraction": html_extract.op3_html_extraction,
        "op4_quality_classifier": quality.op4_quality_classifier,
        "op5_exact_top_k": topk.op5_exact_top_k,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
        "op8_lm_scoring": lm.op8_lm_scoring,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_mixing": mixing.op10_mixing,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_benchmark_decontamination": contamination.op13_benchmark_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_top_k": topk.OP5_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op7_minhash_near_dedup": near_dedup.OP7_SQL,
        "op11_vector_codes": vector_codes.OP11_SQL,
        "op12_spelling_variants": spelling.OP12_SQL,
        "op13_benchmark_decontamination": contamination.OP13_SQL,
    }

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from foliate.llm import decontaminate, fm_index, html_main, imatch, language_id, near_dedup, packing, periodic_runs, quality_rules, secrets, sort_means, suffix_dedup, token_counts

QUERIES = {
    "op1_winnowing": decontaminate.op1_winnowing,
    "op2_best_fit": packing.op2_best_fit,
    "op3_superminhash": near_dedup.op3_superminhash,
    "op4_bigru_language": language_id.op4_bigru_language,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_bucket_refinement": suffix_dedup.op6_bucket_refinement,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_imatch": imatch.op8_imatch,
    "op9_site_style_tree": html_main.op9_site_style_tree,
    "op10_secret_links": secrets.op10_secret_links,
    "op11_sort_means": sort_means.op11_sort_means,
    "op12_repeated_grams": periodic_runs.op12_repeated_grams,
    "op13_fm_index": fm_index.op13_fm_index,
}
ORACLE_SQL: dict[str, str] = {"op1_winnowing": decontaminate.ORACLE_SQL, "op3_superminhash": near_dedup.ORACLE_SQL, "op11_sort_means": sort_means.ORACLE_SQL, "op13_fm_index": fm_index.ORACLE_SQL}

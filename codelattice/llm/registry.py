"""Registered queries of the training-data operators and their SQL."""

from codelattice.llm import bpe, decontaminate, divergence, language_id, license_scan, line_dedup, pseudonyms, quality_model, quality_rules, secret_scan, simhash, tree_model, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_benchmark_leaks": decontaminate.op2_benchmark_leaks,
    "op3_simhash_components": simhash.op3_simhash_components,
    "op4_language_id": language_id.op4_language_id,
    "op5_pseudonyms": pseudonyms.op5_pseudonyms,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_quality_model": quality_model.op8_quality_model,
    "op9_context_tree_score": tree_model.op9_context_tree_score,
    "op10_subword_codec": bpe.op10_subword_codec,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_license_scan": license_scan.op13_license_scan,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op7_secret_scan": secret_scan.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_license_scan": license_scan.ORACLE,
}

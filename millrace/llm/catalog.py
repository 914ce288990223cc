"""Queries over the corpus operators and their SQL twins, by name."""

from __future__ import annotations

from millrace.llm import byte_bpe, decontaminate, exact_dedup, hard_negatives, html_text, jaccard_join, language_id, lm_score, mixing, pii, reshard, token_counts, whitening



def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {
    "pipeline": pipeline,
    "op9_pii": pii.op9_pii,
    "op10_lm_score": lm_score.op10_lm_score,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op1_language_id": language_id.op1_language_id,
    "op4_html_text": html_text.op4_html_text,
    "op7_token_counts": token_counts.op7_token_counts,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op5_reshard": reshard.op5_reshard,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_whitening": whitening.op12_whitening,
    "op13_mix_sources": mixing.op13_mix_sources,
}
ORACLES = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
}

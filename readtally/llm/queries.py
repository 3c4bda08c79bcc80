"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from readtally.llm import audit, bpe, chat, decontaminate, fingerprints, jaccard, licenses, lines, mixing, quality, toxicity, warc, whitening


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_importance_resampling": quality.op1,
    "op2_source_mixing": mixing.op2,
    "op3_license_scan": licenses.op3,
    "op4_chat_formatting": chat.op4,
    "op5_toxicity_chain": toxicity.op5,
    "op6_line_chunk_dedup": lines.op6,
    "op7_benchmark_decontamination": decontaminate.op7,
    "op8_winnowing_fingerprints": fingerprints.op8,
    "op9_ngram_jaccard_join": jaccard.op9,
    "op10_warc_index_merge": warc.op10,
    "op11_prefix_bpe": bpe.op11,
    "op12_filter_audit": audit.op12,
    "op13_lobpcg_whitening": whitening.op13,
    "pipeline": _pipeline,
}
ORACLES = {
    "op2_source_mixing": mixing.ORACLE,
    "op3_license_scan": licenses.ORACLE,
    "op4_chat_formatting": chat.ORACLE,
    "op7_benchmark_decontamination": decontaminate.ORACLE,
    "op9_ngram_jaccard_join": jaccard.ORACLE,
    "op10_warc_index_merge": warc.ORACLE,
    "op12_filter_audit": audit.ORACLE,
}

"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from tallyspark.llm import alignment, decontamination, line_dedup, manifest, merkle, mixing, near_dedup, quality, secrets, sharding, token_counts, token_output, warc

QUERIES = {
    "op1_benchmark_decontamination": decontamination.op1_query,
    "op2_secret_scan": secrets.op2_query,
    "op3_near_dedup": near_dedup.op3_query,
    "op4_quality_classifier": quality.op4_query,
    "op5_source_mixing": mixing.op5_query,
    "op6_token_counts": token_counts.op6_query,
    "op7_sharding": sharding.op7_query,
    "op8_token_binary_output": token_output.op8_query,
    "op9_document_fingerprints": merkle.op9_query,
    "op10_line_dedup": line_dedup.op10_query,
    "op11_tokenizer_alignment": alignment.op11_query,
    "op12_merkle_manifest": manifest.op12_query,
    "op13_warc": warc.op13_query,
}

ORACLE_SQL = {
    "op1_benchmark_decontamination": decontamination.OP1_SQL,
    "op5_source_mixing": mixing.OP5_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op12_merkle_manifest": manifest.OP12_SQL,
    "op13_warc": warc.OP13_SQL,
}

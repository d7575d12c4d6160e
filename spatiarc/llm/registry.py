"""Queries of this subpackage by name, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from spatiarc.llm import op1_quality, op2_topk, op3_ann, op4_suffix_dedup, op5_bpe, op6_secrets, op7_simhash, op8_toxicity, op9_token_counts, op10_mix

QUERIES = {
    "op1_quality": op1_quality.op1_quality,
    "op2_topk": op2_topk.op2_topk,
    "op3_ann": op3_ann.op3_ann,
    "op4_suffix_dedup": op4_suffix_dedup.op4_suffix_dedup,
    "op5_bpe": op5_bpe.op5_bpe,
    "op6_secrets": op6_secrets.op6_secrets,
    "op7_simhash": op7_simhash.op7_simhash,
    "op8_toxicity": op8_toxicity.op8_toxicity,
    "op9_token_counts": op9_token_counts.op9_token_counts,
    "op10_mix": op10_mix.op10_mix,
}

ORACLE_SQL = {"op2_topk": op2_topk.OP2_SQL, "op10_mix": op10_mix.OP10_SQL}

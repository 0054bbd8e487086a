"""Registered queries of the subpackage, and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, decontaminate, filter_audit, hard_negatives, jaccard_join, lm_score, minhash, quality_rules, secret_scan, sharding, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_sharding": sharding.op3_sharding,
    "op4_bpe": bpe.op4_bpe,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_minhash_dedup": minhash.op13_minhash_dedup,
}
ORACLE = {"op10_url_filter": url_filter.OP10_SQL, "op11_filter_audit": filter_audit.OP11_SQL,
          "op12_hard_negatives": hard_negatives.OP12_SQL}

"""The queries op1_ to op10_, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from lodevec.llm import exact_dedup, fingerprints, mixing, near_dedup, packing, secret_scan, sharding, toxicity, url_filters, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_soft_mixing": mixing.op3_soft_mixing,
    "op4_bagminhash": near_dedup.op4_bagminhash,
    "op5_consistent_parsing": fingerprints.op5_consistent_parsing,
    "op6_warc": warc.op6_warc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_link_propagation": url_filters.op8_link_propagation,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_sharding": sharding.op10_sharding,
}

ORACLE = exact_dedup.ORACLE | secret_scan.ORACLE | sharding.ORACLE | warc.ORACLE

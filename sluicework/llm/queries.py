"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import fingerprints, html_text, mixing, near_dups, neighbours, packing, quality, secret_scan, suffix_dedup, toxicity


def queries():
    return {
        "op1_suffix_dedup": suffix_dedup.op1,
        "op2_imatch_fingerprints": fingerprints.op2,
        "op3_weighted_minhash": near_dups.op3,
        "op4_consensus_html": html_text.op4,
        "op5_attention_quality": quality.op5,
        "op6_best_fit_packing": packing.op6,
        "op7_temperature_mixing": mixing.op7,
        "op8_string_kernel_toxicity": toxicity.op8,
        "op9_secret_scans": secret_scan.op9,
        "op10_nn_descent": neighbours.op10,
    }


def oracle_sql():
    return {"op2_imatch_fingerprints": fingerprints.OP2_SQL, "op7_temperature_mixing": mixing.OP7_SQL, "op9_secret_scans": secret_scan.OP9_SQL}

"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import debruijn, exact_dedup, jpeg, lbl, licenses, mixing, near_dedup, packing, pii, quality

QUERIES = {
    "op1_rake_and_sample": mixing.query,
    "op2_debruijn_dedup": debruijn.query,
    "op3_log_bilinear": lbl.query,
    "op4_importance_resampling": quality.query,
    "op5_jpeg_media": jpeg.query,
    "op6_best_fit_packing": packing.query,
    "op7_weak_supervision_pii": pii.query,
    "op8_license_scan": licenses.query,
    "op9_dart_minhash": near_dedup.query,
    "op10_exact_dedup": exact_dedup.query,
}
ORACLES = {"op2_debruijn_dedup": debruijn.SQL, "op10_exact_dedup": exact_dedup.SQL}

"""The score table, and the warning chain run from it: bands, thresholds, watchlist, lead time and gate on the calibrated score.

The chain has SQL for the stand-in score under its plain names; tests run the same SQL on the stored score table.
"""

from __future__ import annotations

from ledgerscope.functions.numeric import half_even
from ledgerscope.plans import gate_queries, model_queries, warning_queries  # noqa: F401  (registered before)
from ledgerscope.plans.pipeline import Calibrated
from ledgerscope.plans.registry import BUILDS, register

CHAIN = ["ew12_band_cuts", "ew14_threshold_table", "ew15_watchlist", "ew19_lead_time", "m16_decile_table", "m17_precision_recall", "m18_by_population", "q10_score_gate"]


def _table(b):
    scored = Calibrated(b.spark, b.folder).challenger
    return scored.select("loan_id", "months_on_book", "obs_month", "label", "split_oot", "score", half_even("score_challenger", 6).alias("score_challenger"))


register("m12_score_table", _table)
for _name in CHAIN:
    register(f"{_name}_calibrated", lambda b, build=BUILDS[_name]: build(Calibrated(b.spark, b.folder)))

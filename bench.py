"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pitchline.plans import QUERIES  # noqa: E402
from pitchline.session import local_session  # noqa: E402

HEADLINE = [
    "win1_form_prior_5", "win2_recent_means_5", "win3_venue_means_prior", "win6_head_to_head_unordered",
    "win11_player_rolling_10", "win12_lineup_continuity", "win13_player_availability", "win14_feature_store_rows",
    "agg1_innings_totals", "agg5_positive_mean_with_defaults", "agg10_rating_scale", "agg16_team_snapshot",
    "jon3_full_outer_zero_fill", "jon5_rating_lookup_with_median", "jon7_as_of_form", "jon9_fuzzy_lookup",
    "rec1_lineup_rating_prior", "rec3_anchored_rating", "set6_merge_columns", "set7_close_latest_of_fixture",
    "spl2_split_by_position", "spl4_stratified_folds", "evl4_classification_report", "evl10_auc_ovr_weighted",
    "drf1_numeric_drift", "sta1_correlations", "prj10_text_facts", "src6_page_facts", "sco6_live_feature_rows",
    "str3_live_team_state", "src1_document_decode", "mod1_logistic_regression", "str2_status_gate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["set9_distinct_teams"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

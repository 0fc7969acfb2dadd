"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wattloom.plans import queries  # noqa: E402
from wattloom.runtime import local_session  # noqa: E402

HEADLINE = [
    "household_consumption", "import_appliances", "appliance_usage_map", "usage_by_appliance",
    "standby_energy", "daily_total", "validate_household", "ingest_households", "blocked_rows",
    "assemble_vector", "autofill", "solar_sizing", "describe_target", "thresholds",
    "standardize", "eval_metrics", "recent_30", "delta_vs_last", "chart_series",
    "prediction_history", "monthly_trend", "train_test_split", "linear_sql", "fit_linear",
    "predict_batch", "save_load_models", "label_encode", "validate_fields", "stream_ingest",
    "stream_score", "stream_delta", "stream_recent_30", "stream_usage_daily",
]
# Full-size fits and what needs them; minutes each, so only on request (BENCH_FITS=1).
FITS = ["fit_forest", "fit_boosted", "train_pipeline", "score_all_models", "score_by_model"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries.registered()
    # Start the engine and its Python side before the clock runs.
    run(registered["household_consumption"](spark, folder))
    seconds = {}
    quality = {}
    names = HEADLINE + (FITS if os.environ.get("BENCH_FITS") == "1" else [])
    for name in names:
        started = time.perf_counter()
        df = registered[name](spark, folder)
        run(df)
        seconds[name] = round(time.perf_counter() - started, 3)
        if name.startswith("fit_"):
            quality |= {row["model"]: {m: row[m] for m in ("n", "RMSE", "MAE", "R2")} for row in df.collect()}
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
        "quality": quality,
    }))


if __name__ == "__main__":
    main()

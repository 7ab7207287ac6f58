"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import glob
import json
import os
import statistics
import time

from wardline.operators import dashboard
from wardline.plans.catalog import QUERIES
from wardline.session import build_session, shared_dir
from wardline.sources import fixtures

HEADLINE = [
    "severity_urgency", "daily_urgency", "latest_complaints", "location_hotspots", "log_summary",
    "dashboard_rollup", "normalize_text", "severity_rule", "urgency_rule", "category_fusion",
    "rules_documents", "weak_label_etl", "severity_decision", "category_probs", "validate_scores",
    "violation_report", "text_segments", "token_tags", "gazetteer_entities", "top_terms_documents",
    "mean_pool", "encode_hash", "tfidf_fit", "tfidf_transform", "nb_train", "nb_score", "enrich_stub",
    "enrich_documents", "enrich_model", "enrich_complaints",
]


# Charts read a stored log, as a dashboard does; it is written before the clock starts.
STORED_LOG = {
    "severity_urgency": dashboard.severity_urgency, "daily_urgency": dashboard.daily_urgency,
    "latest_complaints": dashboard.latest, "location_hotspots": dashboard.location_hotspots,
    "dashboard_rollup": dashboard.dashboard_rollup,
}
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "wardline-bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    root = shared_dir(spark, "bench")
    # Inputs as a table of several files would be: round-robin, no key has a place of its own.
    os.makedirs(f"{root}/in", exist_ok=True)
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        df = spark.read.parquet(path)
        files = int(cpus) if df.count() > 1000 else 1
        df.repartition(files).write.parquet(f"{root}/in/{os.path.basename(path)}")
    inputs = f"{root}/in"
    fixtures.complaint_log(spark, inputs).write.parquet(f"{root}/log")
    log = spark.read.parquet(f"{root}/log")
    runs = {n: (lambda f=STORED_LOG[n]: f(log)) if n in STORED_LOG else (lambda f=QUERIES[n]: f(spark, inputs)) for n in names}

    def seconds(run) -> float:
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(runs[names[0]])
    took = {name: round(statistics.median(seconds(run) for _ in range(RUNS)), 3) for name, run in runs.items()}
    rows = spark.read.parquet(f"{inputs}/events.parquet").count()
    result = {
        "metric": "headline queries, total of medians of three runs",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if "enrich_complaints" in took:
        result["complaints_per_sec"] = round(rows / took["enrich_complaints"])
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()

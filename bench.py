"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlynx.plans.catalog import QUERIES  # noqa: E402
from ledgerlynx.session import build_session  # noqa: E402

HEADLINE = [
    "vendor_stats", "category_patterns", "enrich_vendor", "anomalies", "velocity",
    "arrival_history", "exact_duplicates", "fuzzy_duplicates", "realtime_risk",
    "composite_risk", "registry_risk", "decisions", "explain_audit", "vendor_risk_summary",
    "kpi_cards", "risk_trend_7d", "semantic_duplicates", "enrich_semantic", "find_similar",
]
# timed once each, after the others: pairs, the whole chain and a stream
ONCE = ["detect_duplicates", "scored_invoices", "stream_velocity"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")

    exchanges = {}

    def run(name: str) -> float:
        start = time.perf_counter()
        df = QUERIES[name](spark, folder)
        df.write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        exchanges[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        return took

    cold = {name: round(run(name), 3) for name in HEADLINE}
    warm = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    once = {name: round(run(name), 3) for name in ONCE}
    rows = {name: QUERIES[name](spark, folder).count() for name in ("semantic_duplicates", "detect_duplicates")}
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    print(json.dumps({
        "metric": "headline queries, warm", "value": round(sum(warm.values()), 3),
        "unit": "sec", "queries": warm, "cold": cold, "once": once, "exchanges": exchanges,
        "pairs_per_sec": {n: round(rows[n] / (once | warm)[n]) for n in rows},
        "stream_rows_per_sec": {"stream_velocity": round(events / once["stream_velocity"])},
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

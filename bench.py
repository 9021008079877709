"""Time the headline queries and print one JSON line.

The alert, feed, change and note tables are derived from the sample data and written
out first, so that what is timed is each operator on stored tables, from building the
plan to the last row. Each query runs once untimed and then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from sentrymill import schemas as S
from sentrymill.operators import actions, alerts, dashboard, enrich, phi, timeline, tokens
from sentrymill.plans.ingest import ingest
from sentrymill.session import local_session, run_dir
from sentrymill.sources import sample_views as V
from sentrymill.streaming import jobs

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def stage(spark, df, name):
    """Write a table in as many files as there are cores."""
    path = run_dir(spark, f"bench-{name}")
    df.repartition(int(CORES)).write.parquet(path)
    schema = spark.read.parquet(path).schema
    return lambda: spark.read.schema(schema).parquet(path)


def main() -> None:
    spark = local_session(CORES, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = ["raw_alerts", "ti_abuse", "ti_scan", "ti_geo", "alerts", "scored", "status_changes",
             "playbook_requests", "phi_docs"]
    at = {name: stage(spark, getattr(V, name)(spark, FOLDER), name) for name in names}
    history = alerts.change_status(at["alerts"](), at["status_changes"]()).history
    at["timeline"] = stage(spark, timeline.event_log(
        timeline.lifecycle_events(at["scored"]()), timeline.status_events(history)
    ), "timeline")
    as_of = F.lit("2024-02-01").cast("timestamp")

    def ingested():
        done = ingest(at["raw_alerts"](), at["ti_abuse"](), at["ti_scan"](), at["ti_geo"]())
        return [done.alerts, done.events, done.rejects]

    def register():
        found = actions.resolve(at["playbook_requests"](), at["alerts"]())
        none = spark.createDataFrame([], S.BLOCKED_IPS)
        return [actions.block_entries(actions.executions(found.requests), none)]

    def pseudonyms():
        return [tokens.pseudonymize(phi.detect(at["phi_docs"]()), as_of)[0]]

    def restored():
        return [tokens.restore(swapped(), token_map(), as_of)]

    def streamed():
        out = run_dir(spark, "bench-intake")
        stream = spark.readStream.schema(S.RAW_ALERTS).option("maxFilesPerTrigger", 4).parquet(raw_path)
        jobs.intake(
            stream, lambda: (at["ti_abuse"](), at["ti_scan"](), at["ti_geo"]()), out, run_dir(spark, "bench-state")
        ).awaitTermination()
        return [jobs.read_batches(spark, f"{out}/alerts", S.ALERTS)]

    out, given = tokens.pseudonymize(phi.detect(at["phi_docs"]()), as_of)
    swapped = stage(spark, out.withColumnRenamed("pseudonymized_text", "text"), "swapped")
    token_map = stage(spark, given, "tokens")
    raw_path = run_dir(spark, "bench-stream")
    at["raw_alerts"]().repartition(int(CORES)).write.parquet(raw_path)
    no_blocks = spark.createDataFrame([], S.BLOCKED_IPS)
    queries = {
        "a1_ingest": ingested,
        "d6_summary": lambda: [dashboard.summary(at["alerts"](), no_blocks)],
        "d7_risk_distribution": lambda: [dashboard.risk_distribution(at["alerts"]())],
        "d10_by_country": lambda: [dashboard.by_country(at["alerts"]())],
        "a4_page": lambda: [alerts.page(at["alerts"]())],
        "a8_status_history": lambda: [
            alerts.change_status(at["alerts"](), at["status_changes"]()).history
        ],
        "t8_nested": lambda: [timeline.nested(at["alerts"](), at["timeline"]())],
        "p9_block_register": register,
        "h14_report": lambda: [phi.corpus_report(phi.detect(at["phi_docs"]()), "source", "lang")],
        "h16_replace": pseudonyms,
        "h18_restore": restored,
        "e1_abuse_lookup": lambda: [enrich.lookup_abuse(at["alerts"](), at["ti_abuse"]())],
        "w1_stream_intake": streamed,
    }
    seconds = {}
    for name, build in queries.items():
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            for df in build():
                df.write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

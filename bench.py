"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from deltaboard.plans.queries import all_queries  # noqa: E402
from deltaboard.session import local_session  # noqa: E402

# Rows of the table that drives each query, for the rows per second.
DRIVING = {
    "events": [
        "topk_departures", "countdown_items", "board_rows", "direction_resolution", "line_fallback",
        "pruned_payload_rows", "station_payloads", "merged_documents", "changed_stations", "heartbeats", "wipes",
        "emitted_updates", "cycle_messages", "subscribed_arrivals", "outbox_batches",
    ],
    "orders": ["status_changes", "status_push_rows", "upsert_merge", "changefeed_apply", "checkpoint_advance"],
    "lineitem": ["worst_status", "status_messages", "terminus_directions", "station_diff", "search_keys", "upsert_chunks"],
    "part": ["budgeted_pick"],
    "customer": ["geohash_cells"],
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(
        os.environ.get("BENCH_CPUS", "8"), "12g", **{
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="deltaboard-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    known = all_queries()
    sizes = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in DRIVING}
    # The first query pays for starting the engine; run one before the clock.
    known["countdown_items"](spark, folder).write.format("noop").mode("overwrite").save()

    seconds, rates = {}, {}
    for name_of_table, names in DRIVING.items():
        for name in names:
            begin = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begin, 3)
            rates[name] = round(sizes[name_of_table] / seconds[name])

    emitted = known["emitted_updates"](spark, folder).groupBy("reason").count().collect()
    sent = {row["reason"]: row["count"] for row in emitted}
    messages = known["changed_stations"](spark, folder).count() + known["heartbeats"](spark, folder).count()
    from deltaboard.plans.queries import presence

    stations = presence(spark, folder)[0].count()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "rows_per_sec": rates,
                "emitted": sent,
                "suppressed_share": round(1 - messages / stations, 3),
            }
        )
    )


if __name__ == "__main__":
    main()

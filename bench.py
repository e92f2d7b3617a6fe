"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. With $BENCH_DUCKDB also their DuckDB twins, on as many threads."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Queries of the engine itself, one or two a family.
HEADLINE = (
    "gated_facets flt11_useful_blocks flt18_reason_codes joi01_inner_chain joi03_nested_children joi12_substring_join joi15_asof_backward "
    "joi17_cooccurrence joi20_full_outer_diff agg04_group_by agg12_accumulating_groups agg16_reuse_clusters agg28_task_rollup agg29_ordered_digest "
    "win01_consecutive_edges win05_islands win13_ring fts04_top fts03_bm25 gat02_disposition grf01_corpus_build grf02_observation_graph str01_rate_verdicts str09_alert_dedupe"
).split()
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def duckdb_times(sf: str) -> dict[str, float]:
    """Median seconds of the twins, results fetched."""
    import duckdb

    from quarrylight import plans
    from quarrylight.session import TABLES

    con = duckdb.connect(config={"threads": os.environ.get("BENCH_CPUS", "8")})
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            con.sql(plans.oracle_sql()[name]).fetchall()
            times.append(time.perf_counter() - began)
        took[name] = round(sorted(times[1:])[len(times[1:]) // 2], 4)
    return took


def main() -> None:
    from quarrylight import plans
    from quarrylight.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.queries()
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + RUNS):  # the first one warms up
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(sorted(times[1:])[len(times[1:]) // 2], 4)
    more = {"duckdb": duckdb_times(sf)} if os.environ.get("BENCH_DUCKDB") else {}
    print(json.dumps(more | {"metric": "sum of median warm query times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

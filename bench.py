"""Benchmark: headline operations at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is timed end to end (fit jobs + a full execution of the result plan
into the no-op sink), warm, median of $BENCH_REPEATS runs.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabsense.config import get_session  # noqa: E402
from tabsense.operators import clean as CL  # noqa: E402
from tabsense.operators import correlate as CR  # noqa: E402
from tabsense.operators import features as FT  # noqa: E402
from tabsense.plans import q_ml  # noqa: E402
from tabsense.operators import profile as P  # noqa: E402
from tabsense.plans.automatic import run_pipeline  # noqa: E402
from tabsense.plans.variants import table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def run(df):
    df.write.format("noop").mode("overwrite").save()


def queries(s, d):
    li = lambda: table(s, d, "lineitem")          # noqa: E731
    od = lambda: table(s, d, "orders")            # noqa: E731
    ev = lambda: table(s, d, "events_nulls")      # noqa: E731
    return {
        "schema_profile": lambda: P.profile_schema(li()),
        "profile_count_distinct": lambda: P.profile_schema_count_distinct(li()),
        "health_score": lambda: P.health_components(li()),
        "winsorize": lambda: CL.winsorize(li()),
        "winsorize_approx": lambda: CL.winsorize(li(), quantiles="approx"),
        "clean_lineitem": lambda: CL.clean(li()).df,
        "clean_orders": lambda: CL.clean(od()).df,
        "transform_orders": lambda: FT.transform(od()),
        "correlation_matrix": lambda: CR.correlation_matrix(li()),
        "ffill_single_task": lambda: CL.fill_forward_backward(ev(), ["ts", "value"], "event_id", method="window"),
        "ffill_partitioned": lambda: CL.fill_forward_backward(ev(), ["ts", "value"], "event_id"),
        "auto_run_events": lambda: run_pipeline(ev(), order_by="event_id").transformed,
        "ml_regression": lambda: q_ml._reg_sweep(s, d).leaderboard,
        "ml_classification": lambda: q_ml._cls_sweep(s, d).leaderboard,
    }


def main():
    s = get_session(CPUS, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    only = set(sys.argv[1:])
    times = {}
    for name, q in queries(s, SF_DIR).items():
        if only and name not in only:
            continue
        reps = 1 if name.startswith("ml_") else REPEATS
        run(q())                                   # warm-up (JIT, file cache)
        ts = []
        for _ in range(reps):
            s.catalog.clearCache()                 # no reuse of a previous run's persisted frames
            t0 = time.perf_counter()
            run(q())
            ts.append(time.perf_counter() - t0)
        s.catalog.clearCache()
        times[name] = round(statistics.median(ts), 3)
    sf = SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": CPUS, "repeats": REPEATS}))


if __name__ == "__main__":
    main()

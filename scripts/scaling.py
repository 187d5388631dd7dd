"""Parallel efficiency of the cleaning run at 1, 2, 4 (and 8) cores.

Runs bench.py's clean_lineitem / clean_orders in a fresh JVM per core count and
prints one JSON line per run.
"""
import json
import os
import subprocess
import sys

here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
for cpus in sys.argv[1:] or ["1", "2", "4", "8"]:
    env = dict(os.environ, BENCH_CPUS=cpus, BENCH_SF_DIR=sf, BENCH_SHUFFLE_PARTITIONS=str(2 * int(cpus)))
    out = subprocess.run([sys.executable, os.path.join(here, "bench.py"), "clean_lineitem", "clean_orders",
                          "schema_profile"], env=env, capture_output=True, text=True, timeout=1800)
    line = [l for l in out.stdout.splitlines() if l.startswith("{")][-1]
    print(json.dumps({"cpus": int(cpus), **json.loads(line)["queries"]}))

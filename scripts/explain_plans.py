"""Print the physical plans of the key operators (for plan review).

usage: python scripts/explain_plans.py [--sf DIR] [--mode simple|formatted]
"""
from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tabsense.config import get_session  # noqa: E402
from tabsense.operators import charts as CH  # noqa: E402
from tabsense.operators import clean as CL  # noqa: E402
from tabsense.operators import correlate as CR  # noqa: E402
from tabsense.operators import profile as P  # noqa: E402
from tabsense.operators import query as QY  # noqa: E402
from tabsense.plans.variants import table  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--mode", default="simple")
    a = ap.parse_args()
    s = get_session()
    li, ev = table(s, a.sf, "lineitem"), table(s, a.sf, "events_nulls")
    plans = {
        "filter pushdown (Q1)": QY.run_query(table(s, a.sf, "orders"), {"filter": "o_totalprice > 200000"}),
        "column pruning + partial aggregation (H3)": CH.bar(table(s, a.sf, "orders"), "o_orderpriority",
                                                            "o_totalprice", "o_orderstatus"),
        "frequency table, one pass (P1)": P.frequency_table(li, text="hash"),
        "top-k with WindowGroupLimit (P9)": P.top_values(table(s, a.sf, "part"), 15, ["p_brand", "p_type"]),
        "correlation, one global aggregate (C1)": CR.correlation_matrix(li),
        "distinct rows by content hashes (P3)": P.distinct_row_count(table(s, a.sf, "events_dups")),
        "partitioned forward/backward fill (A14)": CL.fill_forward_backward(ev.select("event_id", "ts", "value"),
                                                                             ["ts", "value"], "event_id"),
        "running total by bucket (H5)": CH.area(li, "l_linenumber", "l_quantity", "l_returnflag"),
    }
    for name, df in plans.items():
        print("=" * 100)
        print(name)
        df.explain(mode=a.mode)


if __name__ == "__main__":
    main()

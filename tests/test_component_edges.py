import os
import random
from collections import Counter, defaultdict

import pytest

from antecede.operators import graph
from antecede.plans import queries as plans

METRICS = ("a_component_size", "b_component_size", "same_component", "merged_component_size")


def brute(rows):
    """id -> metrics of (id, a, b, dt), replayed in order of time."""
    sets, out, by_time = graph.DisjointSet(), {}, defaultdict(list)
    for i, x, y, dt in rows:
        by_time[dt].append((i, ("a", x), ("b", y)))
    for dt in sorted(by_time):
        for i, x, y in by_time[dt]:
            p, q, same = sets.size(x), sets.size(y), sets.connected(x, y)
            out[i] = (p, q, same, p if same else p + q)
        for _, x, y in by_time[dt]:
            sets.union(x, y)
    return out


@pytest.mark.parametrize("few", [0, 300_000])
def test_random_edges_against_replay(spark, few):
    r = random.Random(5)
    rows = [(k, r.choice(["", ":", *map(str, range(25))]), r.randrange(25), r.choice([-9, 0, 3, 4, 5, 50, 51, 52, 53])) for k in range(60)]
    df = spark.createDataFrame([*rows, (99, "1", 1, None)], "i int, x string, y int, at long")
    got = {row.i: tuple(row[c] for c in METRICS) for row in graph.causal_component_metrics(df, "x", "y", "at", few).collect()}
    assert got.pop(99) == (None,) * 4
    assert got == brute(rows)


def test_query_covers_all_edges(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    table = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_suppkey", "l_partkey", "floor(floor(unix_micros(cast(l_shipdate AS timestamp)) / 86400000000) / 30) AS m")
    rows = [(k, *r) for k, r in enumerate(table.collect())]
    want = brute(rows)
    got = plans.QUERIES["component_metrics"](spark, d).collect()
    assert Counter((r.grp, r.other, r.dt, *(r[c] for c in METRICS)) for r in got) == Counter((*row[1:], *want[row[0]]) for row in rows)

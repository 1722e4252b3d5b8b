import random

import numpy as np

from antecede.operators import graph


def test_few_forest_links_take_few_stages(spark):
    """The driver keeps plans and task records of each round, so their number must not follow the digits of the times."""
    r = random.Random(4)
    rows = [(k, r.randrange(200), r.randrange(200), r.randrange(60)) for k in range(400)]
    df = spark.createDataFrame(rows, "i long, x long, y long, at long")
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    nodes = 400
    links = df.selectExpr("x AS _c_x", "y + 200 AS _c_y", "at AS _c_t")
    merges = graph._merges(graph._forest(links, 300_000), nodes, 60, 300_000)
    assert [h for h, *_ in merges] == [5, 4, 3, 2, 1, 0]
    assert spark._jsparkSession.sharedState().statusStore().executionsCount() - before <= 8


def test_merges_by_one_task_equal_those_by_joins(spark):
    r = random.Random(6)
    links = spark.createDataFrame([(r.randrange(50), 50 + r.randrange(50), r.randrange(21)) for _ in range(150)], "_c_x long, _c_y long, _c_t long").repartition(3)
    groups = []
    for few in (0, 1000):
        found = graph._merges(graph._forest(links, few), 100, 21, few)
        # which node names a component may differ; who shares it with whom and its size may not
        groups.append([(h, n, sorted(row._c_total for row in moved.collect())) for h, moved, n in found if n])
    assert groups[0] == groups[1]


def test_first_forest_joins_at_every_time_what_all_links_join():
    r = np.random.default_rng(3)
    for n, m in ((1, 0), (5, 30), (60, 40), (60, 400)):
        u, v = r.integers(0, n, (2, m))
        kept = graph.first_forest(n, u, v)
        for upto in range(m + 1):
            few = kept[kept < upto]
            assert (graph.least_labels(n, u[:upto], v[:upto]) == graph.least_labels(n, u[few], v[few])).all()

import os
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from antecede.config import DetectionConfig
from antecede.operators import state
from antecede.plans import queries as plans


def test_requests_see_the_buffer_only(spark):
    r = random.Random(4)
    known = [(k, r.choice("AB"), r.randrange(12), float(r.randrange(1, 9)), 0, "train") for k in range(50)]
    asked = [(100 + k, r.choice(["A", "B", "C", None]), r.randrange(14), float(r.randrange(1, 9))) for k in range(40)]
    asked += [(100, "A", 13, 2.0), (None, "A", 13, 2.0), (200, "A", None, 2.0)]
    st = state.initial_state(spark.createDataFrame(known, "id long, grp string, dt long, amt double, y int, part string"))
    out = state.score_inputs(st, spark.createDataFrame(asked, "id long, grp string, dt long, amt double"), DetectionConfig(window=4, min_history=1))
    got = sorted(((x.id, x.grp, x.dt, x.amt, x.prior_count_in_window or 0, None if x.prior_median is None else round(x.prior_median, 9)) for x in out.collect()), key=str)
    logs = {row[0]: row[1] for row in spark.createDataFrame(known, "id long, grp string, dt long, amt double, y int, part string").select("id", F.log1p("amt")).collect()}
    want = []
    for i, g, dt, amt in asked:
        before = [x for x in known if x[1] == g and dt is not None and x[2] < dt]
        held = []
        for t in sorted({x[2] for x in before}, reverse=True):
            if len(held) < 4:
                held += [x for x in before if x[2] == t]
        want.append((i, g, dt, amt, len(held), round(median(logs[x[0]] for x in held), 9) if held else None))
    assert got == sorted(want, key=str)


def test_query_scores_the_whole_batch(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    batch = plans.parts(spark, d).where(F.col("part").isin("validation", "embargo_2", "holdout"))
    assert sorted(x.id for x in plans.QUERIES["score_requests"](spark, d).collect()) == sorted(x.id for x in batch.collect())

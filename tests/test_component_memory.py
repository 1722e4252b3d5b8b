import random

import pytest

from antecede.operators import graph


def plans(spark, after):
    rows = spark._jsparkSession.sharedState().statusStore().executionsList()
    rows = [rows.apply(k) for k in range(rows.size())]
    return {r.executionId(): r.physicalPlanDescription() for r in rows if r.executionId() > after}


@pytest.mark.parametrize("few", [0, 300_000])
def test_driver_gathers_no_table_of_nodes_or_links(spark, monkeypatch, few):
    """Stored tables are small in bytes, so by their files' size Spark would send each through the driver, whatever their rows."""
    monkeypatch.setattr(graph, "FEW_ROWS", 0, raising=False)
    r = random.Random(2)
    rows = [(k, r.randrange(40), r.randrange(40), r.randrange(4)) for k in range(60)]
    before = max(plans(spark, -1), default=-1)
    out = graph.causal_component_metrics(spark.createDataFrame(rows, "i long, x long, y long, at long"), "x", "y", "at", few)
    assert len(out.collect()) == 60
    ran = plans(spark, before)
    assert len(ran) > 10 and not [p for p in ran.values() if "BroadcastExchange" in p and "_c_start" not in p]

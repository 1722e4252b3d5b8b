import json

import duckdb
import pytest
from pyspark.sql import functions as F

from antecede.operators import detection, model
from antecede.plans import queries as plans

SF = "/root/testdata/sf0.001"


def compared(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(plans.SQL[name]).df()
    got = plans.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    by = list(want.columns)
    rows = lambda df: sorted(json.dumps([round(float(x), 5) if x == x and x is not None else None for x in r]) for r in df[by].values.tolist())
    assert rows(got) == rows(want) and len(want)


@pytest.mark.parametrize("name", ["validation_outliers", "relationship_direction"])
def test_composites_equal_sql(spark, name):
    compared(spark, name)


def test_only_validation_rows_are_evaluated(spark):
    scored = spark.createDataFrame([("validation", 1, 4.0, "scored_outlier"), ("train", 0, 1.0, "scored_normal")], "part string, y int, modified_zscore double, flag string")
    with pytest.raises(ValueError, match="validation"):
        detection.evaluate_validation_only(scored, "y")
    with pytest.raises(ValueError, match="validation"):
        detection.evaluate_validation_only(scored.withColumn("part", F.lit(None).cast("string")), "y")
    one = detection.evaluate_validation_only(scored.where("part = 'validation'"), "y").first()
    assert (one.n_rows, one.n_outlier, one.rate_outlier, one.n_normal, one.rate_normal, one.auc_abs_z) == (1, 1, 1.0, 0, None, None)


def test_a_saved_model_scores_as_before(spark, tmp_path):
    rows = spark.createDataFrame([(k, "train", int(k % 7 > 3), *[float((k * (j + 3)) % 11) for j in range(len(model.LADDER["B1"]))]) for k in range(60)], "id long, part string, y int, " + ", ".join(f"{c} double" for c in model.LADDER["B1"]))
    fitted = model.fit(rows, "B1")
    path = str(tmp_path / "artifact")
    model.save_artifact(fitted, "B1", path)
    model.save_artifact(fitted, "B1", path)
    loaded, step = model.load_artifact(spark, path)
    assert step == "B1" and model.score(loaded, rows).collect() == model.score(fitted, rows).collect()
    (tmp_path / "artifact/about").rename(tmp_path / "old")
    spark.createDataFrame([("B1", ["other"])], "step string, features array<string>").write.json(f"{path}/about")
    with pytest.raises(ValueError, match="other features"):
        model.load_artifact(spark, path)
    with pytest.raises(ValueError, match="unknown step"):
        model.save_artifact(fitted, "Z9", path)

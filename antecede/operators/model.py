"""The feature ladder, its logistic model, and the comparison of steps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from antecede.config import SplitConfig
from antecede.functions.columns import FEATURES
from antecede.operators.detection import FLAGS, behavior_score
from antecede.operators.split import assign_partition
from antecede.operators.target_history import target_history

# The ladder's steps.
ATTRIBUTES = (*FEATURES, "has_identity")
BEHAVIOR = ("prior_median", "prior_mad", "prior_count_in_window", "modified_zscore", "flag_insufficient_history", "flag_zero_mad", "flag_scored_outlier")
LADDER = {"B0": (), "B1": ATTRIBUTES, "B2": ATTRIBUTES + BEHAVIOR, "F1": ATTRIBUTES + BEHAVIOR + ("smoothed_rate", "global_cold_start"), "F2": ATTRIBUTES + BEHAVIOR + ("smoothed_rate", "global_cold_start", "sufficient")}


def ladder_matrix(df: DataFrame, config: SplitConfig, recipients: Sequence[str]) -> DataFrame:
    """All features of the recipients' rows. Behaviour sees every partition, embargoes too; labels only the allowed ones."""
    rows = assign_partition(df, config)
    scored = behavior_score(rows, "grp", "amt", "dt")
    history = target_history(rows.select("id", "grp", "dt", "y", "part"), recipients, "grp", "dt", "y").select("id", "smoothed_rate", "global_cold_start", "sufficient")
    out = scored.where(F.col("part").isin(list(recipients))).join(history, "id")
    own = {n: f("dt", "amt") for n, f in FEATURES.items() if n != "amt_log1p"}
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    flags = {f"flag_{v}": (F.col("flag") == v).cast("int") for v in FLAGS if v != "scored_normal"}
    filled = {c: zero(c) for c in ("prior_median", "prior_mad", "modified_zscore", "smoothed_rate", "global_cold_start", "sufficient")}
    return out.withColumns(own | flags | filled)


def matrix(assembled: DataFrame, step: str) -> DataFrame:
    if step not in LADDER:
        raise ValueError(f"unknown step: {step}")
    return assembled.select("id", "part", "y", *[F.col(c).cast("double") for c in LADDER[step]])


def fit(train: DataFrame, step: str) -> PipelineModel:
    """Scaling by population deviation and ridge logistic regression (C = 1), both on the training rows."""
    names = LADDER[step]
    n, stats = train.count(), train.agg(*[x for c in names for x in (F.avg(c), F.stddev_pop(c))]).first()
    texts = ", ".join(f"{'0.0D' if not stats[2 * k + 1] else f'(CAST({c} AS DOUBLE) - {stats[2 * k]!r}D) / {stats[2 * k + 1]!r}D'} AS _s{k}" for k, c in enumerate(names))
    stages = [SQLTransformer(statement=f"SELECT *, {texts} FROM __THIS__"), VectorAssembler(inputCols=[f"_s{k}" for k in range(len(names))], outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="y", regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-8)]
    return Pipeline(stages=stages).fit(train)


def save_artifact(model: PipelineModel, step: str, path: str) -> None:
    """Writes a fitted model with the step whose features it takes; an older one at ``path`` is replaced."""
    if step not in LADDER:
        raise ValueError(f"unknown step: {step}")
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(step, list(LADDER[step]))], "step string, features array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_artifact(spark: SparkSession, path: str) -> tuple[PipelineModel, str]:
    """The model and its step; ValueError if its features are no longer the step's."""
    about = spark.read.schema("step string, features array<string>").json(f"{path}/about").first()
    if tuple(about.features) != LADDER.get(about.step):
        raise ValueError(f"the model at {path} was fitted to other features than {about.step} has")
    return PipelineModel.load(f"{path}/model"), about.step


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    return out.select("id", "part", "y", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def constant_scores(train: DataFrame, rows: DataFrame) -> DataFrame:
    """The training prevalence for every row."""
    return rows.select("id", "part", "y").crossJoin(F.broadcast(train.agg(F.avg("y").alias("score"))))  # one row


def average_precision(y: np.ndarray, s: np.ndarray, w: np.ndarray | None = None) -> float:
    w = np.ones(len(y)) if w is None else w
    order = np.argsort(-s, kind="stable")
    y, s, w = y[order], s[order], w[order]
    last = np.r_[s[1:] != s[:-1], True]
    tp, n = np.cumsum(w * y)[last], np.cumsum(w)[last]
    return float((np.diff(np.r_[0, tp]) * np.divide(tp, n, out=np.zeros_like(tp), where=n > 0)).sum() / tp[-1]) if len(tp) and tp[-1] else float("nan")


def bootstrap_delta(a: DataFrame, b: DataFrame, resamples: int = 1000, seed: int = 20260101, confidence: float = 0.95) -> DataFrame:
    """Interval of AP(b) - AP(a) over paired Poisson resamples, whose weights come from each row's id: every resample is
    a grouped sum over distinct scores, in Spark."""
    pairs = a.select("id", "y", F.col("score").alias("sa")).join(b.select("id", F.col("score").alias("sb")), "id")
    u = F.pmod(F.xxhash64(F.lit(seed), "id", "r"), F.lit(1 << 40)) / float(1 << 40)
    weight = F.lit(0)
    for edge in np.cumsum([np.exp(-1), np.exp(-1), np.exp(-1) / 2, np.exp(-1) / 6, np.exp(-1) / 24, np.exp(-1) / 120]):
        weight = weight + (u >= float(edge)).cast("int")
    drawn = pairs.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", weight).where("w > 0")

    def ap(s: str, name: str) -> DataFrame:
        by = drawn.groupBy("r", s).agg(F.sum(F.col("w") * F.col("y")).alias("p"), F.sum("w").alias("n"))
        w = Window.partitionBy("r").orderBy(F.desc(s)).rowsBetween(Window.unboundedPreceding, 0)
        run = by.withColumns({"tp": F.sum("p").over(w), "tn": F.sum("n").over(w)})
        return run.groupBy("r").agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("tn")), F.sum("p")).alias(name))

    tail = (1 - confidence) / 2
    return ap("sa", "a").join(ap("sb", "b"), "r").select((F.col("b") - F.col("a")).alias("d")).where("d IS NOT NULL").agg(F.count("*").alias("n_resamples"), F.percentile("d", tail).alias("low"), F.percentile("d", 1 - tail).alias("high"), F.avg("d").alias("mean"))


def gates(roc_b2: float, pr_b2: float, roc_f2: float, pr_f2: float, pr_f1: float, low: float, lift: float = 1.10) -> dict[str, bool]:
    return {"lift": pr_f2 >= lift * pr_b2, "roc": roc_f2 >= roc_b2, "interval": low > 0, "f1": pr_f1 > pr_b2}


def assert_not_evaluated(spark, path: str) -> None:
    """FileExistsError if results are already there: a holdout is scored once."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileExistsError(path)

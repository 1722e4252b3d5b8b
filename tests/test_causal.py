import random
from statistics import median

import pytest

from antecede.config import DetectionConfig, SplitConfig
from antecede.operators import causal, detection, graph, split, state, stats, target_history

HIST = [(0, "A", 100, 10.0), (1, "A", 150, 20.0), (2, "A", 200, 30.0), (3, "A", 200, 40.0), (4, "B", 100, 5.0), (5, "A", 300, 50.0)]
COLS = "i int, grp string, dt long, amt double"


def by_id(df, *names):
    return {r.i: tuple(r[n] for n in names) for r in df.collect()}


def test_history(spark):
    df = spark.createDataFrame(HIST, COLS)
    assert by_id(causal.prior_count(df, "grp", "dt"), "prior_count") == {0: (0,), 1: (1,), 2: (2,), 3: (2,), 4: (0,), 5: (4,)}
    got = by_id(causal.prior_amount_stats(df, "grp", "amt", "dt"), "prior_sum", "prior_count", "prior_mean")
    assert got[0] == (0.0, 0, None) and got[2] == got[3] == (30.0, 2, 15.0) and got[5] == (100.0, 4, 25.0)
    assert by_id(causal.time_since_last(df, "grp", "dt"), "time_since_last") == {0: (None,), 1: (50,), 2: (50,), 3: (50,), 4: (None,), 5: (100,)}
    others = spark.createDataFrame([(*r[:3], o) for r, o in zip(HIST, "XYXZPY", strict=True)], "i int, grp string, dt long, other string")
    assert by_id(causal.prior_distinct_other(others, "grp", "other", "dt"), "prior_distinct_other_count") == {0: (0,), 1: (1,), 2: (2,), 3: (2,), 4: (0,), 5: (3,)}


def test_null_groups_have_no_history(spark):
    df = spark.createDataFrame([(0, None, 1, 1.0), (1, None, 2, 1.0), (2, "A", None, 1.0)], COLS)
    assert by_id(causal.prior_count(df, "grp", "dt"), "prior_count") == {0: (None,), 1: (None,), 2: (None,)}
    assert len(causal.windowed_robust_stats(df, "grp", "amt", "dt", 2).collect()) == 3


def test_windows(spark):
    df = spark.createDataFrame([(k, "A", 100 + 50 * k, 10.0 * (k + 1)) for k in range(5)], COLS)
    got = by_id(causal.windowed_robust_stats(df, "grp", "amt", "dt", 2), "prior_count_in_window", "prior_median", "prior_mad")
    assert got[1] == (1, 10.0, 0.0) and got[3] == (2, 25.0, 5.0) and got[4] == (2, 35.0, 5.0) and got[0][1] is None
    tie = spark.createDataFrame([(k, "A", dt, amt) for k, (dt, amt) in enumerate([(1, 10.0), (1, 20.0), (1, 30.0), (2, 100.0), (3, 999.0)])], COLS)
    assert by_id(causal.windowed_robust_stats(tie, "grp", "amt", "dt", 3), "prior_count_in_window", "prior_median", "prior_mad")[4] == (4, 25.0, 10.0)
    with pytest.raises(ValueError):
        causal.windowed_robust_stats(df, "grp", "amt", "dt", 0)


def test_random_against_brute_force(spark):
    r = random.Random(0)
    rows = [(k, r.choice("ABC"), r.randrange(15), float(r.randrange(9)), r.choice(["p", "q", "r", "s", None])) for k in range(60)]
    df = spark.createDataFrame(rows, COLS + ", other string")
    wide = by_id(causal.windowed_robust_stats(df, "grp", "amt", "dt", 4), "prior_count_in_window", "prior_median")
    distinct = by_id(causal.prior_distinct_other(df, "grp", "other", "dt"), "prior_distinct_other_count")
    windowed = by_id(causal.windowed_distinct_other(df, "grp", "other", "dt", 4), "prior_distinct_other_count_in_window", "prior_count_in_window")
    for k, g, dt, _, _ in rows:
        before = sorted((x for x in rows if x[1] == g and x[2] < dt), key=lambda x: -x[2])
        held = []
        for t in sorted({x[2] for x in before}, reverse=True):
            if len(held) >= 4:
                break
            held += [x for x in before if x[2] == t]
        assert distinct[k][0] == len({x[4] for x in before} - {None})
        assert windowed[k] == (len({x[4] for x in held} - {None}), len(held)) or (not held and windowed[k][1] in (0, None))
        if held:
            assert wide[k] == (len(held), median(x[3] for x in held))


def test_rows_order_and_future_do_not_matter(spark):
    df = spark.createDataFrame(HIST, COLS)
    later = spark.createDataFrame([*HIST[::-1], (9, "A", 300, 1e6), (10, "A", 400, 1.0)], COLS)
    f = lambda d: by_id(causal.windowed_robust_stats(causal.prior_amount_stats(d, "grp", "amt", "dt"), "grp", "amt", "dt", 3), "prior_sum", "prior_median")
    a, b = f(df), f(later)
    assert all(a[k] == b[k] for k in a)


def test_detector_flags(spark):
    rows = [(k, g, dt, a) for k, (g, dt, a) in enumerate([("A", 1, 5.0), ("A", 2, 5.0), ("A", 3, 5.0), ("B", 1, 10.0), ("B", 2, 12.0), ("B", 3, 8.0), ("B", 4, 50.0), ("C", 1, 10.0), ("C", 2, 12.0), ("C", 3, 8.0), ("C", 4, 10.5)])]
    df = spark.createDataFrame(rows, COLS)
    got = by_id(detection.behavior_score(df, "grp", "amt", "dt", DetectionConfig(window=3, min_history=1)), "flag")
    assert got[0] == ("insufficient_history",) and got[2] == ("zero_mad",) and got[6] == ("scored_outlier",) and got[10] == ("scored_normal",)


def test_target_history(spark):
    df = spark.createDataFrame([(0, "A", 100, 1, "train"), (1, "B", 150, 0, "train"), (2, "A", 200, 0, "train"), (3, "A", 300, 1, "train")], "i int, grp string, dt long, y int, part string")
    from antecede.config import SmoothingConfig

    got = by_id(target_history.prior_target_rate(df, "grp", "dt", "y", SmoothingConfig(k=2)), "prior_target_count", "prior_event_count", "smoothed_rate", "global_cold_start")
    assert got[0] == (0, 0, None, True) and got[1] == (0, 0, 1.0, False)
    assert got[2][2] == pytest.approx(2 / 3) and got[3][2] == pytest.approx((1 + 2 / 3) / 4)
    with pytest.raises(ValueError):
        target_history.require_sources(df, "part", ["validation"])


def test_split(spark):
    assert not SplitConfig().problems() and SplitConfig((("train", 1, 5), ("embargo_1", 5, 6), ("validation", 7, 8), ("embargo_2", 9, 9), ("holdout", 10, 10))).problems()
    df = spark.createDataFrame([(k, d) for k, d in enumerate([1, 130, 131, 138, 161, 168, 200])], "id int, day int")
    parts = [r.part for r in split.assign_partition(df, SplitConfig()).orderBy("id").collect()]
    assert parts == ["train", "train", "embargo_1", "validation", "embargo_2", "holdout", None]
    r = split.validate_split(split.assign_partition(df, SplitConfig()), SplitConfig(), "id").first()
    assert r.n_unassigned == 1 and not r.valid and r.chronological


def test_components(spark):
    df = spark.createDataFrame([("D1", "P1", 100), ("D1", "P2", 200), ("D2", "P1", 200), ("D1", "P1", 300)], "a string, b string, dt long")
    got = [(r.a_component_size, r.b_component_size, r.same_component, r.merged_component_size) for r in graph.causal_component_metrics(df, "a", "b", "dt").orderBy("dt", "a").collect()]
    assert got == [(1, 1, False, 2), (2, 1, False, 3), (1, 2, False, 3), (4, 4, True, 4)]
    with pytest.raises(ValueError):
        graph.causal_component_metrics(spark.createDataFrame([(None, "P", 1)], "a string, b string, dt long"), "a", "b", "dt")


def test_state_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "K1", 10, 1.0, 1, "train"), (2, "K1", 20, 2.0, 0, "embargo_1"), (3, "K2", 30, 3.0, 0, "holdout")], "id long, grp string, dt long, amt double, y int, part string")
    st = state.initial_state(df)
    assert st.buffer.count() == 3 and {r.grp: (r.n_positive, r.n_events) for r in st.counters.collect()} == {"K1": (1, 1), "K2": (0, 1)}
    batch = spark.createDataFrame([(1, "K1", 10, 1.0), (4, "K1", 40, 4.0), (4, "K1", 40, 4.0)], "id long, grp string, dt long, amt double")
    st2 = state.record_observed(st, batch)
    assert st2.buffer.count() == 4 and state.record_observed(st2, batch).buffer.count() == 4
    with pytest.raises(ValueError):
        state.record_observed(st, spark.createDataFrame([(1, "K1", 10, 9.0)], "id long, grp string, dt long, amt double"))
    labels = spark.createDataFrame([(101, "K1", 1), (102, "K1", 0)], "id long, grp string, y int")
    st3 = state.update_resolved(st2, labels)
    assert {r.grp: (r.n_positive, r.n_events) for r in state.update_resolved(st3, labels).counters.collect()}["K1"] == (2, 3)
    state.save_state(st3, str(tmp_path / "state"))
    assert state.load_state(spark, str(tmp_path / "state")).buffer.count() == 4
    from antecede.streaming.state_stream import stream_into_state

    batch.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, "K9", 1, 1.0)], batch.schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream_into_state(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    assert state.load_state(spark, str(tmp_path / "state")).buffer.count() == 5


def test_metrics(spark):
    r = random.Random(3)
    rows = [(float(r.randrange(6)), r.randrange(2)) for _ in range(50)]
    got = stats.score_metrics(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert got.roc_auc == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))
    assert stats.score_metrics(spark.createDataFrame([(1.0, 1)], "s double, y int"), "s", "y").first().roc_auc is None


def test_all_queries_run_and_match_sql(spark):
    """The smallest tables; the driver runs the larger ones."""
    import os

    import duckdb

    from antecede.plans import queries as plans

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    db = duckdb.connect()
    for t in ("orders", "lineitem", "documents", "labels", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    norm = lambda v: repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    for name in ("row_features", "windowed_robust", "prior_distinct", "prior_target_rate_validation", "freq_adjusted_overlap", "state_counts_after_update", "dominant_exclusion"):
        df = plans.QUERIES[name](spark, d)
        want = db.execute(plans.SQL[name])
        cols = [c[0] for c in want.description]
        assert sorted(tuple(map(norm, r)) for r in want.fetchall()) == sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()), name

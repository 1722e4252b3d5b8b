from antecede.llm import jaccard_join


def test_rounds_tidy_the_driver_and_send_small_tables(spark, monkeypatch):
    """The driver's heap must not grow from round to round, and few pivots must not cost a shuffle's tasks."""
    calls, sent = [], []
    tidy, send = jaccard_join.tidy, jaccard_join._sent
    monkeypatch.setattr(jaccard_join, "tidy", lambda s: (calls.append(1), tidy(s)))
    monkeypatch.setattr(jaccard_join, "_sent", lambda t: (sent.append(1), send(t))[1])
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join([*words, f"x{k}"])) for k in range(5)] + [(9, "other words stand here")]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), direct=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {**dict.fromkeys(range(5), 0), 9: 9}
    assert len(calls) >= 4 and len(sent) >= 3

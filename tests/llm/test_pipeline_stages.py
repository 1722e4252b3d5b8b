"""Helpers and stages against plain computations: hot keys, nulls, repeated rows and ids, empty tables."""

import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from antecede.llm import language_id
from antecede.llm.common import attached, looked_up, stored

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_lookup_with_a_hot_key_equals_a_left_join(spark):
    rows = [(k % 7 and 1, k) for k in range(5000)] + [(k, k) for k in range(2, 3000)] + [(None, k) for k in range(50)]
    left = spark.createDataFrame(rows, "key int, v int")
    right = stored(spark.createDataFrame([(k, f"of {k}", k * 2) for k in range(0, 2500, 1)] + [(None, "never", 0)], "key int, name string, more int"), "lookup")
    want = sorted((k, v, f"of {k}" if k is not None and k < 2500 else None) for k, v in ((k, v) for k, v in rows if k is not None))
    for out in (looked_up(left, right, ["key"]), attached(left, right, ["key"], 0), attached(left, right, ["key"], 10**6)):
        got = out.collect()
        assert sorted((x.key, x.v, x.name) for x in got if x.key is not None) == want
        assert sum(x.key is None and x.name is None for x in got) == 50 and len(got) == len(rows)
    assert looked_up(left.where("v < 0"), right, ["key"]).count() == 0


def near_copies(seed=3):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(40):
        base = [r.choice(words) for _ in range(60)]
        rows.append((2 * k, " ".join(base)))
        if k % 2:
            base[r.randrange(60)] = "other"
            rows.append((2 * k + 1, " ".join(base)))
    return rows


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    odd = [(5000, "five words are just enough"), (5000, "five words are just enough"), (None, "five words are just enough"), (6000, None), (6000, None), (6001, ""), (0, "a clean text with the id of another one"), (None, "no id and no copy of this one")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*near_copies(), *odd]]
    docs = spark.createDataFrame(rows, COLUMNS)
    sets = [shingles(x[1]) for x in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    members = {}
    for k, g in enumerate(group):
        members.setdefault(g if sets[k] else ("none", k), []).append(k)
    first = lambda ks: min(ks, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    want = sorted(str((rows[k][0], rows[k][1])) for k in map(first, members.values()))
    got = pipeline.dedup_documents(spark, docs, "")
    assert sorted(str((x.doc_id, x.text)) for x in got.collect()) == want and got.columns == list(pipeline.COLUMNS)


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_take_empty_tables_and_odd_rows(spark, name, stage):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, "", "", "", 0), (None, "x " * 3000, "en", "src1", 6000), (2, "same line\nsame line", "de", "src1", 19), (2, "same line\nsame line", "de", "src1", 19)], COLUMNS)
    out = stage(spark, docs.where("doc_id > 9"), "")
    assert out.count() == 0
    kept = stage(spark, docs, "")
    assert kept.count() <= 5 and (kept.columns == list(pipeline.COLUMNS) or name == "sentencepiece")


def test_language_stage_by_either_way_of_the_hosts(spark):
    """Posteriors and decisions are the same with the hosts' priors sent to all tasks and looked up, with and without the texts."""
    r = random.Random(8)
    tongues = {"aa": "banana cabana havana", "bb": "strength rhythm crypts", "cc": "queue eerie aerie"}
    rows = []
    for k in range(300):
        lang = r.choice([*tongues])
        declared = lang if k % 5 else r.choice([*tongues, None])
        rows.append((k, " ".join(r.choice(tongues[lang].split()) for _ in range(r.randint(0, 30))), declared, f"host{k % 9 if k % 3 else 0}", 0))
    docs = spark.createDataFrame(rows + rows[:3], COLUMNS).withColumn("predicted", F.lit("x"))
    found = [
        sorted((x.doc_id, x.predicted or "", round(x.confidence, 9), x.accepted) for x in language_id.identify(docs, F.col("lang"), F.col("source"), keep_text=keep, broadcast_numbers=n).collect())
        for keep in (True, False) for n in (10**6, 0)
    ]
    assert all(x == found[0] for x in found) and len(found[0]) == 303 and sum(x[3] for x in found[0]) > 250

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.llm import language_id

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def rows_of(sizes, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for lang, size in sizes.items():
        words = ["".join(r.choice(list(LETTERS), 5)) for _ in range(12)]
        rows += [(f"{lang}{k}", " ".join(r.choice(words, 40)), lang, "h") for k in range(size)]
    return rows


@pytest.mark.parametrize("sizes", [{"big": 1200, "rare": 5}, {f"l{k:02}": 6 for k in range(70)}])
def test_every_declared_language_with_text(spark, sizes):
    rows = rows_of(sizes)
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    got = {x.doc_id: x for x in language_id.identify(docs, F.col("lang"), F.col("source")).collect()}
    assert {k for k, _, lang, _ in rows if got[k].predicted != lang or not got[k].accepted} == set()


def test_a_few_words_make_no_language(spark):
    docs = spark.createDataFrame([*rows_of({"big": 100}), ("x", "some words", "tiny", "h")], "doc_id string, text string, lang string, source string")
    assert language_id.languages(docs, F.col("lang"), "text") == ["big"]


def test_sparse_evidence_is_the_sum_of_logs():
    r = np.random.default_rng(2)
    at = r.choice(40 * 3, 50, replace=False)
    counts = r.integers(1, 9, 50)
    dense = np.zeros((40, 3))
    dense[at // 3, at % 3] = counts
    seen = (dense.sum(axis=1) > 0).sum()
    logs = np.log((dense + language_id.TRIGRAM_COUNT) / (dense.sum(axis=0) + language_id.TRIGRAM_COUNT * seen))
    codes = r.integers(0, 40, 30).astype(np.uint32)
    got = language_id.Model(at, counts, 3).evidence(codes)
    assert np.allclose(got, [*logs[codes].sum(axis=0), 30 * np.log(1 / seen)], atol=1e-4)

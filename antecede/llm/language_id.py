"""Language identification by Bayesian evidence fusion (operator 4).

Evidence for a row's language, multiplied as likelihoods and normalised:

* its whole text, by letter trigrams in a naive Bayes model with an additional background class (all
  trigrams alike). A long text's trigrams repeat each other, so ``n`` of them count as ``n / (1 + n / TEXT_WEIGHT)``;
* the language that its markup or metadata declares, by P(declared | language);
* its address suffix, by P(suffix | language);
* its host's prior, smoothed hierarchically: host towards suffix, suffix towards the whole corpus.

Every declared value whose rows have ``LEAST_CHARS`` characters of text together is a language, whatever its share. The trigram counts
come from all rows of these languages, thin ones being smoothed; they are kept sparsely (a trigram has entries only for the
languages that use it), so their number is not limited. The other tables are grouped counts over all rows of the language that the
text alone speaks for. Only tables that grow with the languages but not with the rows leave Spark; hosts are a table that is sent to
every task where it is measured small and joined otherwise, hot hosts apart.

A row is accepted when its best language, not the background, has a posterior of ``threshold`` at least.
A null or empty text, or one without letters, has no language (null) and is rejected. Null hosts, suffixes and
declared languages are values like others, named by the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.llm.common import forget_others, looked_up, rows_of, stored, whole

#: Trigrams that a long text counts as.
TEXT_WEIGHT = 60.0
#: Pseudo-counts: of trigrams, of declared languages and suffixes, and of the level above a host or suffix.
TRIGRAM_COUNT, EVIDENCE_COUNT, PRIOR_COUNT = 0.05, 20.0, 10.0
#: Characters of text that make a declared value a language.
LEAST_CHARS = 1000
#: Posterior from which on a row is accepted.
THRESHOLD = 0.5
#: Numbers of the evidence tables together up to which they are sent to every task (8 bytes each); beyond it rows are joined to theirs.
BROADCAST_NUMBERS = 4_000_000
_CODES = 1 << 18
#: Trigrams that a task holds before it adds them up.
_HELD = 1 << 21

_CLASS = np.zeros(256, np.uint32)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37


def trigrams(text: str) -> np.ndarray:
    """Codes of the letter trigrams of a text; what is no letter counts as a space, and none is at a trigram's middle."""
    t = _CLASS[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    return ((t[:-2] << np.uint32(12)) | (t[1:-1] << np.uint32(6)) | t[2:])[t[1:-1] > 0]


def languages(docs: DataFrame, declared: Column, text_col: str) -> list[str]:
    found = docs.where(declared != "").groupBy(declared.alias("l")).agg(F.sum(F.length(text_col)).alias("n")).where(F.col("n") >= LEAST_CHARS)
    return sorted(r.l for r in found.select("l").collect())


class Model:
    """Log likelihoods of trigrams by language, the background last: those of a trigram that a language does not have, and what others have more."""

    def __init__(self, at: np.ndarray, counts: np.ndarray, n: int):
        at, counts = at[order := np.argsort(at, kind="stable")], counts[order]
        code, self.language = at // n, (at % n).astype(np.int32)
        self.starts = np.searchsorted(code, np.arange(_CODES + 1))
        seen = max(1, int((np.diff(self.starts) > 0).sum()))
        total = np.bincount(self.language, counts, n) + TRIGRAM_COUNT * seen
        self.base = np.append(np.log(TRIGRAM_COUNT / total), np.log(1.0 / seen))
        self.more = np.log((counts + TRIGRAM_COUNT) / TRIGRAM_COUNT).astype(np.float32)

    def evidence(self, codes: np.ndarray) -> np.ndarray:
        """Sums over the trigrams."""
        first, size = self.starts[codes], self.starts[codes + np.uint32(1)] - self.starts[codes]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        return len(codes) * self.base + np.bincount(self.language[at], self.more[at], len(self.base))


def train(docs: DataFrame, names: list[str], text_col: str, declared: Column) -> Model:
    of = {name: k for k, name in enumerate(names)}
    n = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        held: list[np.ndarray] = []
        size, at, total = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def add_up():
            new, counts = np.unique(np.concatenate(held), return_counts=True)
            both, place = np.unique(np.concatenate([at, new]), return_inverse=True)
            return both, np.bincount(place, np.concatenate([total, counts])).astype(np.int64)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), rows_of(batch.column(1)), strict=True):
                if (k := of.get(name)) is not None:
                    codes = trigrams(text)
                    held.append(codes.astype(np.int64) * n + k)
                    size += len(codes)
                if size >= _HELD:
                    at, total = add_up()
                    held, size = [], 0
                    if len(at) >= _HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total)], ["at", "n"])
                        at, total = at[:0], total[:0]
        if held:
            at, total = add_up()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total)], ["at", "n"])

    found = docs.select(declared, whole(text_col)).mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    return Model(found.column("at").to_numpy(), found.column("n").to_numpy(), n)


def text_evidence(docs: DataFrame, model: Model, text_col: str, keep_text: bool) -> DataFrame:
    """``docs`` with ``_ll``, the damped log likelihoods by language (null without letters)."""
    keep = [c for c in docs.columns if c != text_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        table = sent.value
        for batch in batches:
            out = []
            for text in rows_of(batch.column(len(keep))):
                codes = trigrams(text) if text else ()
                out.append((table.evidence(codes) / (1 + len(codes) / TEXT_WEIGHT)).tolist() if len(codes) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *([batch.column(len(keep))] if keep_text else []), pa.array(out, pa.list_(pa.float64()))], [*keep, *([text_col] if keep_text else []), "_ll"])

    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *([f"`{text_col}` string"] if keep_text else []), "_ll array<double>"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], whole(text_col).alias(text_col)).mapInArrow(run, fields)


def _best(column: str) -> Column:
    """Place of the largest element, the first on ties."""
    return F.array_position(F.col(column), F.array_max(column)).cast("int") - 1


class Evidence:
    """The tables that documents are judged by."""

    def __init__(self, scored: DataFrame, names: list[str], broadcast_numbers: int = BROADCAST_NUMBERS):
        n = len(names)
        self.names = names
        spoken = scored.where("_ll IS NOT NULL").withColumn("_l", _best("_ll"))
        counts = spoken.where(F.col("_l") < n)
        total = {r._l: r["count"] for r in counts.groupBy("_l").count().collect()}
        everything = sum(total.values())
        self.prior = [(total.get(k, 0) + 1.0) / (everything + n) for k in range(n)]
        prior = F.array(*[F.lit(p) for p in self.prior])
        smooth = lambda above: F.transform("_by", lambda c, k: (c + PRIOR_COUNT * F.get(above, k)) / (F.col("_n") + PRIOR_COUNT))
        suffixes = self._counts(counts, n, "_suffix").select("_suffix", smooth(prior).alias("_above"))
        hosts = self._counts(counts, n, "_host", "_suffix").join(suffixes, "_suffix")
        hosts = hosts.select("_host", "_suffix", F.transform(smooth(F.col("_above")), lambda x: F.log(x)).alias("_prior"))
        self.tables = [(["_host", "_suffix"], stored(hosts, "hosts"))]
        #: Log likelihoods of a declared language and of a suffix, by language.
        self.tables += [([c], stored(self._likelihood(counts, c, total, n), "evidence")) for c in ("_declared", "_suffix")]
        #: Whether all tables can be sent to every task.
        self.small = sum(t.count() for _, t in self.tables) * (n + 4) <= broadcast_numbers

    @staticmethod
    def _counts(counts: DataFrame, n: int, *by: str) -> DataFrame:
        """``_n`` rows of each value, ``_by`` language."""
        found = counts.groupBy(*by, "_l").agg(F.count("*").alias("_c")).groupBy(*by).agg(F.sum("_c").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_l", "_c"))).alias("_m"))
        return found.select(*by, "_n", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0))).alias("_by"))

    @staticmethod
    def _likelihood(counts: DataFrame, column: str, total: dict[int, int], n: int) -> DataFrame:
        """Log P(value | language) for values that are frequent enough to tell; others say nothing."""
        everything = max(1, sum(total.values()))
        sizes = F.array(*[F.lit(total.get(k, 0)) for k in range(n)])
        return Evidence._counts(counts, n, column).select(column, F.transform("_by", lambda c, k: F.log((c + EVIDENCE_COUNT * F.col("_n") / everything) / (F.get(sizes, k) + EVIDENCE_COUNT))).alias(f"{column}_ll"))

    def judge(self, scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """``scored`` without helper columns, with ``predicted``, ``confidence`` and ``accepted``."""
        n = len(self.names)
        none = F.array(*[F.lit(0.0)] * n)
        prior = F.array(*[F.lit(float(np.log(p))) for p in self.prior])
        joined = scored
        for keys, table in self.tables:
            joined = joined.join(F.broadcast(table), keys, "left") if self.small else looked_up(joined, table, keys)
        parts = F.arrays_zip(F.slice("_ll", 1, n).alias("t"), F.coalesce("_prior", prior).alias("h"), F.coalesce("_declared_ll", none).alias("d"), F.coalesce("_suffix_ll", none).alias("s"))
        mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / n  # noqa: E731  the background knows neither host nor declared language
        background = F.element_at("_ll", n + 1) + F.least(mean(F.coalesce(F.col("_prior"), prior)) + mean(F.coalesce(F.col("_declared_ll"), none)) + mean(F.coalesce(F.col("_suffix_ll"), none)), F.lit(0.0))
        joined = joined.withColumn("_score", F.when(F.col("_ll").isNotNull(), F.concat(F.transform(parts, lambda x: x["t"] + x["h"] + x["d"] + x["s"]), F.array(background))))
        joined = joined.withColumn("_k", _best("_score")).withColumn("_most", F.array_max("_score"))
        joined = joined.withColumn("confidence", 1.0 / F.aggregate("_score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_most"))))
        names = F.array(*[F.lit(x) for x in self.names])
        predicted = F.when(F.col("_k") < n, F.get(names, F.col("_k")))
        out = joined.withColumn("predicted", predicted).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        return out.withColumn("accepted", F.col("predicted").isNotNull() & (F.col("confidence") >= threshold)).drop("_score", "_k", "_most", "_ll", "_prior", "_declared_ll", "_suffix_ll", "_host", "_suffix", "_declared")


#: Columns that the result adds; columns of these names are replaced.
ADDED = ("predicted", "confidence", "accepted")


def prepared(docs: DataFrame, declared: Column, host: Column, suffix: Column) -> DataFrame:
    return docs.drop(*ADDED).withColumns({"_declared": whole(declared), "_host": whole(host), "_suffix": whole(suffix)})


def identify(docs: DataFrame, declared: Column, host: Column, suffix: Column | None = None, text_col: str = "text", keep_text: bool = False, threshold: float = THRESHOLD, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """Columns of ``docs`` (the text only if asked for) with ``predicted``, ``confidence``, ``accepted``.

    Texts that are kept do not travel with the evidence: with few hosts a second pass judges them where they are read; else
    rows are judged without their text, and each text gets the decision of its evidence's 128-bit hash.
    """
    kept = [c for c in docs.columns if c not in (*ADDED, *([] if keep_text else [text_col]))]
    result = [*[F.col(f"`{c}`") for c in kept], *ADDED]
    ready = prepared(docs, declared, host, F.lit("") if suffix is None else suffix)
    names = languages(ready, F.col("_declared"), text_col)
    if not names:
        return ready.withColumns({"predicted": F.lit(None).cast("string"), "confidence": F.lit(0.0), "accepted": F.lit(False)}).select(*result)
    model = train(ready, names, text_col, F.col("_declared"))
    if not keep_text:
        scored = stored(text_evidence(ready, model, text_col, False), "languages")
        return Evidence(scored, names, broadcast_numbers).judge(scored, threshold).select(*result)
    evidence_of = ("_declared", "_host", "_suffix", text_col)
    ready = ready.withColumn("_mark", F.struct(F.xxhash64(*evidence_of), F.xxhash64(F.lit(1), *evidence_of)))
    slim = stored(text_evidence(ready.select(*evidence_of, "_mark"), model, text_col, False), "languages")
    evidence = Evidence(slim, names, broadcast_numbers)
    if evidence.small:
        return evidence.judge(text_evidence(ready.drop("_mark"), model, text_col, True), threshold).select(*result)
    judged = stored(evidence.judge(slim, threshold).select("_mark", *ADDED).dropDuplicates(["_mark"]), "judged")
    return looked_up(ready, judged, ["_mark"], slim.groupBy("_mark").agg(F.count("*").alias("_n"))).select(*result)


def identify_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """``identify`` for web pages: declared by the markup's lang, suffix and host from the address; tags are no text."""
    from antecede.llm.html_wrappers import host_of

    text = F.regexp_replace(F.regexp_replace(whole(html_col), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[A-Za-z0-9#]+;", " ")
    declared = F.lower(F.regexp_extract(whole(html_col), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    host = host_of(url_col)
    keep = [c for c in pages.columns if c not in (html_col, "_text", "_lang", "_at")]
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], text.alias("_text"), declared.alias("_lang"), host.alias("_at"))
    return identify(rows, F.col("_lang"), F.col("_at"), F.element_at(F.split("_at", r"\."), -1), "_text", threshold=threshold).withColumnRenamed("_lang", "declared").drop("_at")

"""Personal data by bootstrapped contextual extraction (operator 2), with DataFrame operations only.

Four kinds of plain entities (email, ip, card, phone) are found by pattern and checked; they are always kept. Every token with a digit or an at
sign is an instance. Plain entities, and tokens of 32 letters and digits or more with eight of each (secrets), are seeds;
short tokens, small numbers, versions, dates and times are known to be none; the others are open. Instances meet lexical patterns: the two words before
them, the words on both sides, their form, and the word before or after with their form's class (tokens without letters or digits, as an
equals sign, are skipped; entities of several tokens only have the first two). Over the graph of patterns and distinct instances Spark iterates:

* a pattern with ``MIN_SEEDS`` seeds or found instances has the confidence ``p / (p + n + SMOOTH)``, ``p`` being the sum of their
  scores and ``n`` the instances known to be none; patterns from ``MIN_CONFIDENCE`` on are kept;
* an open instance's score is the noisy-or of the kept patterns that hold it; from ``MIN_SCORE`` on it is found, gets the kind of its most
  confident pattern, and counts in the next round, so that it brings patterns of its own.

Found instances and secrets are unseen identifiers: wherever they occur and touch no plain entity, they are added to the spans. A pattern and an instance are one edge
however often they meet, so copies of a document add no weight. Sums are formed on the map side first, and every text is read once.

Definitions: a null text counts as empty; positions are code points, ends exclusive; rows that share an id are told apart; other columns are
not read. The regular expressions
match what the plain ones would, leftmost and without overlap, but are written so that no text
makes them backtrack or recurse (runs are possessive and start at a run's start or where the last match ended). Places are summed up in blocks, so that
a text's cost grows with its length, however many entities it has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.llm.common import attached, stored, whole

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
# The entities' forms, equal in matches to the plain expressions of the contract.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

#: Positive instances that a pattern needs; its least confidence and what smooths it; least score of a found instance; rounds.
MIN_SEEDS, MIN_CONFIDENCE, SMOOTH, MIN_SCORE, ROUNDS = 3, 0.8, 0.5, 0.9, 3
#: Matches whose places are summed up one after the other.
BLOCK = 128
#: Characters of a token that can be a seed; longer ones are open instances.
LONGEST_SEED = 320
#: Rows of a table of patterns or instances up to which it is sent to every task.
BROADCAST_ROWS = 200_000
#: Labels of instances that are no seeds.
OPEN, NONE = -1, -2


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, hit, before, after>>`` of a pattern's matches, with the texts between them, whose lengths give the places."""
    size = lambda x: (F.length(x["before"]) + F.length(x["hit"])).cast("bigint")
    none, zero = F.expr("cast(array() as array<bigint>)"), F.lit(0).cast("bigint")

    def pieces(found: Column) -> Column:
        zipped = F.arrays_zip(found["hits"].alias("hit"), found["gaps"].alias("before"), F.slice(found["gaps"], 2, F.size(found["gaps"])).alias("after"))
        return F.filter(zipped, lambda x: x["hit"].isNotNull())

    def blocks(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, BLOCK))

    def running(lengths: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), none.alias("all"))
        return F.aggregate(lengths, start, lambda t, n: F.struct((t["at"] + n).alias("at"), F.array_append(t["all"], t["at"]).alias("all")), lambda t: t["all"])

    def placed(cut: Column) -> Column:
        firsts = running(F.transform(cut, lambda block: F.aggregate(block, zero, lambda t, x: t + size(x))), zero)
        inner = lambda b: F.arrays_zip(b["block"].alias("x"), running(F.transform(b["block"], size), b["first"]).alias("at"))
        return F.flatten(F.transform(F.arrays_zip(cut.alias("block"), firsts.alias("first")), inner))

    def span(p: Column) -> Column:
        start = p["at"] + F.length(p["x"]["before"])
        return F.struct(start.alias("start"), (start + F.length(p["x"]["hit"])).alias("end"), p["x"]["hit"].alias("hit"), p["x"]["before"].alias("before"), p["x"]["after"].alias("after"))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return F.transform(_bound(_bound(_bound(found, pieces), blocks), placed), span)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    backwards = F.transform(F.split(F.reverse(digits), ""), lambda c: F.ascii(c) - 48)
    doubled = F.transform(backwards, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, x * 2 - 9).otherwise(x * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) > 3, False).otherwise(F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(hit)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _checked(found: Column, rank: int, kind: str) -> Column:
    good = F.filter(found, lambda m: _valid(kind, m["hit"]))
    several = lambda m: F.array_compact(F.array(*_around(m, None)))  # noqa: E731  tokens that are an entity have their patterns in ``found``
    patterns = lambda m: F.when(F.contains(m["hit"], F.lit(" ")), several(m))
    return F.transform(good, lambda m: F.struct(F.lit(rank).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), m["hit"].alias("hit"), patterns(m).alias("patterns")))


def _number_of(spans: str, rank: int) -> Column:
    return F.size(F.filter(spans, lambda m: m["rank"] == rank)).cast("long")


def base_spans(text: Column) -> Column:
    """``array<struct<rank, start, end, hit, patterns>>`` of the plain entities, by kind and start; those of several tokens with their patterns."""
    parts = []
    for rank, kind in enumerate(BASE):
        found = _checked(matches(text, PATTERNS[kind]), rank, kind)
        needed = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
        if kind != "email":
            needed = needed & F.rlike(text, F.lit("[0-9]"))
        parts.append(F.when(needed, found).otherwise(F.expr("cast(array() as array<struct<rank:int,start:bigint,end:bigint,hit:string,patterns:array<string>>>)")))
    return F.concat(*parts)


def _seed(token: Column, raw: Column) -> Column:
    """Label of a token: its kind if it is a seed."""
    digits = F.length(_digits(token))
    return (
        F.when(F.length(raw) > LONGEST_SEED, OPEN)
        .when(F.rlike(token, F.lit(rf"^{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")), 0)
        .when(F.rlike(token, F.lit(r"^[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++$")) & _valid("ip", token), 1)
        .when(F.rlike(token, F.lit(r"^[0-9]++(?:-[0-9]++)*+$")) & _valid("card", token), 2)
        .when(F.rlike(raw, F.lit(r"^\+[0-9][().0-9-]+[0-9]$")) & _valid("phone", raw), 3)
        .when(F.rlike(token, F.lit(r"^[A-Za-z0-9_-]{32,}$")) & (digits >= 8) & (F.length(F.regexp_replace(token, "[^A-Za-z]", "")) >= 8), 4)
        .when((F.length(token) <= 6) | F.rlike(token, F.lit(r"^[0-9]{1,6}([.,:/-][0-9]{1,4}){0,2}$")), NONE)
        .otherwise(OPEN)
    )


def _form(token: Column) -> Column:
    """A token's form: the length of a number or of a hexadecimal string, else its kinds of characters in order."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]+", "9"), r"\p{Lu}+", "A"), r"\p{L}+", "a")
    return (
        F.when(F.rlike(token, F.lit("^[0-9]+$")), F.concat(F.lit("num"), F.length(token).cast("string")))
        .when((F.length(token) >= 16) & F.rlike(token, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), F.concat(F.lit("hex"), F.length(token).cast("string")))
        .otherwise(F.substring(kinds, 1, 40))
    )


def _class(token: Column, form: Column) -> Column:
    return F.when(F.rlike(form, F.lit("^num")), form).when(F.contains(token, F.lit("@")), "mail").when(F.rlike(token, F.lit(r"^[0-9.,:/-]+$")), form).otherwise("mix")


def _words(text: Column) -> Column:
    """The words of a short text, lower-cased, without their punctuation."""
    clean = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, r"^\p{Punct}++", ""), r"(?<!\p{Punct})\p{Punct}++$", ""))
    return F.filter(clean, lambda w: w != "")


#: Characters of the texts around a token in which its context words are looked for; a word that is cut there is left out.
CONTEXT = 160


def _around(m: Column, cls: Column | None) -> list[Column]:
    """The patterns of the words around a span: two words before, one before and one after; with a class of forms also one before, one after."""
    left = _words(F.regexp_replace(F.substring(F.concat(F.lit(" "), m["before"]), -CONTEXT, CONTEXT), r"^\S++\s", " "))
    right = _words(F.regexp_replace(F.substring(F.concat(m["after"], F.lit(" ")), 1, CONTEXT), r"\s\S++$", " "))
    one, two, after = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2)), F.try_element_at(right, F.lit(1))
    of = lambda *parts: F.when(reduce(lambda x, y: x & y, [p.isNotNull() for p in parts[1:]]), F.concat_ws(" ", F.lit(parts[0]), *parts[1:]))
    return [of("LL", two, one), of("B", one, after), *([] if cls is None else [of("L", one, cls), of("R", after, cls)])]


def _patterns(m: Column, token: Column) -> Column:
    form = _form(token)
    return F.array_compact(F.array(F.concat_ws(" ", F.lit("F"), form), *_around(m, _class(token, form))))


def _instance(m: Column) -> Column:
    """A token without the punctuation around it."""
    raw = F.regexp_replace(m["hit"], r"(?<!\p{Punct})\p{Punct}++$", "")
    cut = F.struct(raw.alias("raw"), F.regexp_replace(raw, r"^\p{Punct}++", "").alias("token"))

    def described(c: Column) -> Column:
        start = m["start"] + F.length(c["raw"]) - F.length(c["token"])
        return F.struct(start.alias("start"), (start + F.length(c["token"])).alias("end"), c["token"].alias("hit"), _seed(c["token"], c["raw"]).alias("label"), _patterns(m, c["token"]).alias("patterns"))

    return _bound(cut, described)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, id, base, found``: entities and instances of every whole text, the latter with their patterns; the only pass over the texts."""
    text = F.col("_text")
    with_text = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("_text"))
    found = F.filter(F.transform(F.when(F.rlike(text, F.lit("[0-9@]")), matches(text, _CANDIDATE)), _instance), lambda m: m["end"] > m["start"])
    out = with_text.select("id", base_spans(text).alias("base"), found.alias("found"))
    spans = F.transform("base", lambda m: F.struct(m["rank"].alias("rank"), m["start"].alias("start"), m["end"].alias("end")))
    seeds = F.transform(F.filter("base", lambda m: m["patterns"].isNotNull()), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["hit"].alias("hit"), m["rank"].alias("label"), m["patterns"].alias("patterns")))
    out = out.select("id", spans.alias("base"), F.concat(seeds, F.coalesce("found", F.slice(seeds, 1, 0))).alias("found"))
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "pii-scan")


def bootstrap(scanned: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``pattern, confidence, kind`` of kept patterns and ``hit, score, kind`` of found instances."""
    uses = scanned.select(F.explode("found").alias("m")).select(F.explode("m.patterns").alias("pattern"), F.col("m.hit").alias("hit"), F.col("m.label").alias("label"))
    edges = stored(uses.groupBy("pattern", "hit").agg(F.max("label").alias("label")), "pii-edges")
    found, patterns = None, None
    for _ in range(rounds):
        scored = edges.withColumn("score", F.lit(0.0)).withColumn("kind", F.lit(None).cast("int")) if found is None else attached(edges, found, ["hit"], BROADCAST_ROWS)
        seed = F.col("label") >= 0
        scored = scored.select("pattern", "label", F.when(seed, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"), F.when(seed, F.col("label")).otherwise(F.col("kind")).alias("kind"))
        # whole millionths: sums then do not depend on their order
        counts = [F.sum(F.when(F.col("kind") == k, F.round(F.col("score") * 1e6).cast("long")).otherwise(0)).alias(f"_n{k}") for k in range(len(KINDS))]
        sums = scored.groupBy("pattern").agg(F.count_if(F.col("score") > 0).alias("_seeds"), F.count_if(F.col("label") == NONE).alias("_none"), *counts).where(F.col("_seeds") >= min_seeds)
        p = reduce(lambda x, y: x + y, [F.col(f"_n{k}") for k in range(len(KINDS))]) / 1e6
        most = F.greatest(*[F.col(f"_n{k}") for k in range(len(KINDS))])
        kind = reduce(lambda rest, k: F.when(F.col(f"_n{k}") == most, k).otherwise(rest), range(len(KINDS) - 2, -1, -1), F.lit(len(KINDS) - 1))
        kept = sums.select("pattern", (p / (p + F.col("_none") + SMOOTH)).alias("confidence"), kind.alias("kind")).where(F.col("confidence") >= min_confidence)
        patterns = stored(kept, "pii-patterns")
        doubt = F.greatest(F.lit(1.0) - F.col("confidence"), F.lit(1e-6))
        met = attached(edges.where(F.col("label") == OPEN), patterns, ["pattern"], BROADCAST_ROWS).where("confidence IS NOT NULL")
        scores = met.groupBy("hit").agg((1 - F.exp(-F.sum(F.round(-F.log(doubt) * 1e6).cast("long")) / 1e6)).alias("score"), F.max(F.struct("confidence", -F.col("kind"))).alias("_best"))
        found = stored(scores.where(F.col("score") >= min_score).select("hit", "score", (-F.col("_best.col2")).cast("int").alias("kind")), "pii-found")
    return patterns, found


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _apart(more: DataFrame, scanned: DataFrame) -> DataFrame:
    """Spans (``row, rank, start, end``) that overlap no plain entity of their row: by running maxima and minima over a row's spans in order."""
    plain = scanned.select("row", F.explode("base").alias("b")).join(more.select("row").distinct(), "row", "left_semi").select("row", F.lit(None).cast("int").alias("rank"), "b.start", "b.end")
    both = more.select("row", "rank", "start", "end").unionByName(plain)
    is_plain = F.col("rank").isNull()
    up = Window.partitionBy("row").orderBy("start", F.col("rank").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.col("rank").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_end", F.max(F.when(is_plain, F.col("end"))).over(up)).withColumn("_start", F.min(F.when(is_plain, F.col("start"))).over(down))
    free = (F.coalesce("_end", F.lit(0)) <= F.col("start")) & (F.coalesce("_start", F.col("end")) >= F.col("end"))
    return both.where(~is_plain & free).select("row", "rank", "start", "end")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered, n_spans`` for each row."""
    scanned = scan(docs, id_col, text_col)
    _, found = bootstrap(scanned, **bounds)
    uses = scanned.select("row", F.explode("found").alias("m")).select("row", "m.start", "m.end", "m.hit", "m.label").where(F.col("label").isin(OPEN, KINDS.index("secret")))
    met = attached(uses, found.select("hit", "kind"), ["hit"], BROADCAST_ROWS)
    met = met.withColumn("rank", F.when(F.col("label") >= 0, F.col("label")).otherwise(F.col("kind"))).where("rank IS NOT NULL")
    more = _apart(stored(met.select("row", "rank", "start", "end"), "pii-more"), scanned).groupBy("row").agg(F.collect_list(F.struct("rank", "start", "end")).alias("more"))
    none = F.expr("cast(array() as array<struct<rank:int,start:bigint,end:bigint>>)")
    out = scanned.select("row", "id", "base").join(more, "row", "left").withColumn("more", F.coalesce("more", none))
    every = F.array_sort(F.concat("base", "more"))
    counts = [_number_of("base", k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    added = F.size("more").cast("long")
    return out.select(
        F.col("id").alias(id_col), *counts, F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _joined(every).alias("spans"),
        added.alias("n_discovered"), (F.size("base") + added).alias("n_spans"),
    )

"""Registered queries over the test tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.config import PARTITIONS, SUFFICIENCY_THRESHOLDS, SplitConfig
from antecede.functions import columns as C
from antecede.operators import causal, detection, graph, links, model, profile, split, state, stats, target_history
from antecede.sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Days since 1970 of the orders' first and last day.
SPLIT = SplitConfig.scaled(9131, 11535)
DRIFT_DAY = 10333

O = "o AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000000 AS dt, o_custkey AS grp, o_totalprice AS amt, CAST(o_orderstatus = 'F' AS INT) AS y, o_orderpriority AS cat, CAST(epoch_us(o_orderdate) // 86400000000 AS INT) AS day FROM orders)"  # noqa: E741
P = O + ", p AS (SELECT *, CASE " + " ".join(f"WHEN day BETWEEN {lo} AND {hi} THEN '{n}'" for n, lo, hi in SPLIT.ranges) + " END AS part FROM o)"
L = "l AS (SELECT l_orderkey * 10 + l_linenumber AS id, epoch_us(l_shipdate) // 86400000000 AS dt, l_suppkey AS grp, l_extendedprice AS amt, l_partkey AS other, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem)"
# whole buckets before each (grp, dt): bucket j counts while the rows strictly between are fewer than N
W = lambda src, n: f"b AS (SELECT grp, dt, count(*) AS n FROM {src} GROUP BY ALL), c AS (SELECT grp, dt, sum(n) OVER (PARTITION BY grp ORDER BY dt) AS upto, sum(n) OVER (PARTITION BY grp ORDER BY dt) - n AS before FROM b), w AS (SELECT c.grp, c.dt, r.* EXCLUDE (grp, dt) FROM c JOIN c AS d ON c.grp = d.grp AND d.dt < c.dt AND c.before - d.upto < {n} JOIN {src} AS r ON r.grp = d.grp AND r.dt = d.dt)"
PCTS = ", ".join(f"avg(CASE WHEN c >= {t} THEN 100.0 ELSE 0.0 END) AS pct_ge_{t}" for t in SUFFICIENCY_THRESHOLDS)
H1 = "k AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY dt) - 1 AS c FROM p)"


def query(sql: str | None = None, ctes: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {ctes}\n" if ctes else "") + sql
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def parts(s, d) -> DataFrame:
    return split.assign_partition(A.orders(s, d), SPLIT)


def counted(s, d) -> DataFrame:
    return causal.prior_count(parts(s, d), "grp", "dt", "c")


@query("SELECT doc_id AS id, round(ln(1 + n_chars), 9) AS amt_log1p, CAST(0 AS DOUBLE) AS amt_decimal_part FROM documents")
def amount_columns(s, d):
    df = A.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("amt"))
    return rounded(df.select("id", C.log1p_amount("amt").alias("amt_log1p"), C.decimal_part("amt").alias("amt_decimal_part")), "amt_log1p", places=9)


@query("SELECT id, round(ln(1 + amt), 9) AS amt_log1p, round(amt - floor(amt), 6) AS amt_decimal_part, CAST((dt // 3600) % 24 AS INT) AS hour_of_day, CAST((dt // 86400) % 7 AS INT) AS day_of_week, CAST(id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS INT) AS has_identity FROM o", O)
def row_features(s, d):
    ids = A.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    out = C.feature_frame(A.orders(s, d), ids, "id", "dt", "amt")
    return rounded(rounded(out, "amt_log1p", places=9), "amt_decimal_part")


@query("SELECT doc_id, CAST(doc_id IN (SELECT doc_id FROM labels) AS INT) AS has_identity FROM documents")
def has_match_flag(s, d):
    return C.with_match_flag(A.table(s, d, "documents").select("doc_id"), A.table(s, d, "labels"), "doc_id")


@query("SELECT id, day, part FROM p", P)
def assign_partition(s, d):
    return parts(s, d).select("id", "day", "part")


@query(f"SELECT n.part, coalesce(c, 0) AS n_rows, lo AS first_day, hi AS last_day FROM (SELECT unnest({list(PARTITIONS)}) AS part) n LEFT JOIN (SELECT part, count(*) AS c, min(day) AS lo, max(day) AS hi FROM p GROUP BY part) x USING (part)", P)
def partition_counts(s, d):
    return split.partition_counts(parts(s, d))


@query(f"SELECT (SELECT count(*) FROM p WHERE part IS NULL) AS n_unassigned, (SELECT count(*) FROM (SELECT id FROM p GROUP BY id HAVING count(DISTINCT part) > 1)) AS n_ids_in_several, 5 - (SELECT count(DISTINCT part) FROM p) AS n_empty, true AS chronological, 0 AS n_range_problems, (SELECT count(*) FROM p WHERE part IS NULL) = 0 AND (SELECT count(DISTINCT part) FROM p) = {len(PARTITIONS)} AS valid", P)
def validate_split(s, d):
    return split.validate_split(parts(s, d), SPLIT, "id")


@query("SELECT lang || '|' || source AS k, count(*) AS n_rows FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def group_key(s, d):
    return C.with_group_key(A.table(s, d, "documents").select("lang", "source"), ["lang", "source"], "k").groupBy("k").agg(F.count("*").alias("n_rows"))


@query("SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN lang || '|' || quality END AS k FROM documents d LEFT JOIN labels USING (doc_id)")
def node_key(s, d):
    df = A.table(s, d, "documents").select("doc_id", "lang").join(A.table(s, d, "labels"), "doc_id", "left")
    return df.select("doc_id", C.key(["lang", "quality"]).alias("k"))


@query("SELECT id, (SELECT count(*) FROM l AS q WHERE q.grp = l.grp AND q.dt < l.dt) AS prior_count FROM l", L)
def prior_count(s, d):
    return causal.prior_count(A.lines(s, d), "grp", "dt").select("id", "prior_count")


@query("SELECT id, round(coalesce(sum(amt) OVER w, 0), 2) AS prior_sum, count(amt) OVER w AS prior_count, round(avg(amt) OVER w + 1e-7, 4) AS prior_mean FROM l WINDOW w AS (PARTITION BY grp ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", L)
def prior_amount_stats(s, d):
    out = causal.prior_amount_stats(A.lines(s, d), "grp", "amt", "dt").withColumn("prior_mean", F.col("prior_mean") + 1e-7)  # off the ties of rounding
    return rounded(rounded(out, "prior_sum", places=2), "prior_mean", places=4).select("id", "prior_sum", "prior_count", "prior_mean")


@query("SELECT id, dt - (SELECT max(q.dt) FROM l AS q WHERE q.grp = l.grp AND q.dt < l.dt) AS time_since_last FROM l", L)
def time_since_last(s, d):
    return causal.time_since_last(A.lines(s, d), "grp", "dt").select("id", "time_since_last")


_ROBUST = W("l", 20) + ", m AS (SELECT grp, dt, median(amt) AS prior_median, count(*) AS n FROM w GROUP BY ALL), a AS (SELECT w.grp, w.dt, median(abs(amt - prior_median)) AS prior_mad FROM w JOIN m USING (grp, dt) GROUP BY ALL)"


@query("SELECT id, round(prior_median, 4) AS prior_median, round(prior_mad, 4) AS prior_mad, coalesce(n, 0) AS prior_count_in_window FROM l LEFT JOIN m USING (grp, dt) LEFT JOIN a USING (grp, dt)", L + ", " + _ROBUST)
def windowed_robust(s, d):
    return rounded(causal.windowed_robust_stats(A.lines(s, d), "grp", "amt", "dt", 20), "prior_median", "prior_mad", places=4).select("id", "prior_median", "prior_mad", "prior_count_in_window")


_SCORED = (
    "v AS (SELECT * REPLACE (ln(1 + amt) AS amt) FROM p), " + _ROBUST.replace("FROM l ", "FROM v ").replace("JOIN l AS", "JOIN v AS")
    + ", z AS (SELECT v.*, prior_median, prior_mad, coalesce(n, 0) AS nw, CASE WHEN coalesce(n, 0) >= 5 AND prior_mad > 1e-9 THEN 0.6745 * (amt - prior_median) / prior_mad END AS zs FROM v LEFT JOIN m USING (grp, dt) LEFT JOIN a USING (grp, dt))"
    + ", f AS (SELECT *, CASE WHEN nw < 5 THEN 'insufficient_history' WHEN zs IS NULL THEN 'zero_mad' WHEN abs(zs) >= 3.5 THEN 'scored_outlier' ELSE 'scored_normal' END AS flag FROM z)"
)


@query("SELECT id, round(amt, 6) AS amt_log1p, nw AS prior_count_in_window, round(zs, 6) AS modified_zscore, flag FROM f", P + ", " + _SCORED)
def behavior_score(s, d):
    out = detection.behavior_score(parts(s, d), "grp", "amt", "dt")
    return rounded(out, "amt_log1p", "modified_zscore").select("id", "amt_log1p", "prior_count_in_window", "modified_zscore", "flag")


@query("SELECT part, count(*) AS n_rows, " + ", ".join(f"round(count(*) FILTER (flag = '{f}') * 100.0 / count(*), 6) AS pct_{f}" for f in detection.FLAGS) + " FROM f GROUP BY part", P + ", " + _SCORED)
def behavior_flag_coverage(s, d):
    out = detection.flag_coverage(detection.behavior_score(parts(s, d), "grp", "amt", "dt"), "part")
    return rounded(out, *[f"pct_{f}" for f in detection.FLAGS])


@query(
    "SELECT count(*) AS n_rows, count(*) FILTER (flag = 'scored_outlier') AS n_outlier, round(avg(y) FILTER (flag = 'scored_outlier'), 9) AS rate_outlier, "
    "count(*) FILTER (flag = 'scored_normal') AS n_normal, round(avg(y) FILTER (flag = 'scored_normal'), 9) AS rate_normal, round((SELECT (sum(y * rk) - sum(y) * (sum(y) + 1) / 2.0) "
    "/ (sum(y) * (count(*) - sum(y))) FROM (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM (SELECT y, abs(zs) AS v FROM f "
    "WHERE part = 'validation' AND zs IS NOT NULL))), 6) AS auc_abs_z FROM f WHERE part = 'validation'",
    P + ", " + _SCORED,
)
def validation_outliers(s, d):
    scored = detection.behavior_score(parts(s, d), "grp", "amt", "dt").where("part = 'validation'")
    return rounded(rounded(detection.evaluate_validation_only(scored, "y"), "rate_outlier", "rate_normal", places=9), "auc_abs_z")


def _direction_sql(n: int) -> str:
    counts = f"(WITH {W('l', n)} SELECT grp, dt, count(DISTINCT other) AS k FROM w GROUP BY ALL)" if n else (
        "(SELECT x.grp, x.dt, count(*) AS k FROM (SELECT DISTINCT grp, dt FROM l) x JOIN (SELECT grp, other, min(dt) AS dt FROM l GROUP BY ALL) q ON q.grp = x.grp AND q.dt < x.dt GROUP BY ALL)"
    )
    shares = ", ".join(f"round(avg(CASE WHEN coalesce(k, 0) >= {t} THEN 100.0 ELSE 0.0 END), 6) AS pct_ge_{t}" for t in SUFFICIENCY_THRESHOLDS)
    return f"SELECT {n} AS window_size, count(*) AS n_rows, {shares} FROM l LEFT JOIN {counts} USING (grp, dt)"


@query(" UNION ALL ".join(map(_direction_sql, (0, 5, 10))), L)
def relationship_direction(s, d):
    out = links.relationship_direction(A.lines(s, d), "grp", "other", "dt", (5, 10))
    return rounded(out, *[f"pct_ge_{t}" for t in SUFFICIENCY_THRESHOLDS])


@query("SELECT id, coalesce(n, 0) AS prior_distinct_other_count FROM l LEFT JOIN (SELECT x.grp, x.dt, count(DISTINCT q.other) AS n FROM (SELECT DISTINCT grp, dt FROM l) x JOIN (SELECT grp, other, min(dt) AS dt FROM l GROUP BY ALL) q ON q.grp = x.grp AND q.dt < x.dt GROUP BY ALL) USING (grp, dt)", L)
def prior_distinct(s, d):
    return causal.prior_distinct_other(A.lines(s, d), "grp", "other", "dt").select("id", "prior_distinct_other_count")


@query("SELECT id, coalesce(k, 0) AS prior_distinct_other_count_in_window, coalesce(n, 0) AS prior_count_in_window FROM l LEFT JOIN (SELECT grp, dt, count(DISTINCT other) AS k, count(*) AS n FROM w GROUP BY ALL) USING (grp, dt)", L + ", " + W("l", 5))
def windowed_distinct(s, d):
    return causal.windowed_distinct_other(A.lines(s, d), "grp", "other", "dt", 5).select("id", "prior_distinct_other_count_in_window", "prior_count_in_window")


def _rate_sql(recipient: str) -> str:
    allowed = ", ".join(f"'{x}'" for x in target_history.SOURCES[recipient])
    return f"""SELECT id, fc AS prior_target_count, ec AS prior_event_count, round(CASE WHEN gc > 0 THEN gf / gc END, 9) AS global_rate, round(CASE WHEN ec > 0 THEN fc / ec END, 9) AS raw_rate,
 round((fc + 20 * (CASE WHEN gc > 0 THEN gf / gc END)) / (ec + 20), 9) AS smoothed_rate, ec >= 5 AS sufficient, gc = 0 AS global_cold_start
FROM (SELECT id, part, coalesce(sum(y) OVER w, 0) AS fc, count(y) OVER w AS ec, coalesce(sum(y) OVER g, 0) AS gf, count(y) OVER g AS gc FROM p WHERE part IN ({allowed})
 WINDOW w AS (PARTITION BY grp ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE part = '{recipient}'"""


def _rates(recipient: str):
    def run(s, d):
        out = target_history.target_history(parts(s, d), [recipient], "grp", "dt", "y")
        return rounded(out, "global_rate", "raw_rate", "smoothed_rate", places=9).select("id", "prior_target_count", "prior_event_count", "global_rate", "raw_rate", "smoothed_rate", "sufficient", "global_cold_start")

    run.__name__ = f"prior_target_rate_{recipient}"
    return query(_rate_sql(recipient), P)(run)


for _r in target_history.SOURCES:
    _rates(_r)


@query("SELECT day, count(*) AS n_rows FROM o GROUP BY day", O)
def daily_volume(s, d):
    return profile.daily_volume(A.orders(s, d), "day")


@query("SELECT day, count(y) AS n_labeled, CAST(sum(y) AS BIGINT) AS n_positive, round(sum(y) / count(y), 9) AS rate FROM o GROUP BY day", O)
def daily_rate(s, d):
    return rounded(profile.daily_rate(A.orders(s, d), "day", "y"), "rate", places=9)


@query("SELECT cat, day, count(*) AS n_rows FROM o GROUP BY ALL", O)
def daily_count_by_group(s, d):
    return profile.daily_count_by_group(A.orders(s, d), "cat", "day")


@query("SELECT cat, day, count(amt) AS n, round(sum(amt), 2) AS total, round(avg(amt), 4) AS mean, round(stddev_samp(amt), 4) AS std FROM o GROUP BY ALL", O)
def daily_amount_stats(s, d):
    return rounded(rounded(profile.daily_amount_stats_by_group(A.orders(s, d), "cat", "day", "amt"), "total", places=2), "mean", "std", places=4)


@query("SELECT 'doc_id' AS column_name, CAST(0 AS BIGINT) AS n_missing, 0.0::DOUBLE AS pct_missing UNION ALL SELECT 'lang', count(*) - count(lang), (count(*) - count(lang)) * 100.0::DOUBLE / count(*) FROM documents UNION ALL SELECT 'quality', count(*) - count(quality), round((count(*) - count(quality)) * 100.0::DOUBLE / count(*), 6) FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', count(*) - count(toxic), round((count(*) - count(toxic)) * 100.0::DOUBLE / count(*), 6) FROM documents LEFT JOIN labels USING (doc_id)")
def missingness(s, d):
    df = A.table(s, d, "documents").select("doc_id", "lang").join(A.table(s, d, "labels"), "doc_id", "left")
    return rounded(profile.missingness(df), "pct_missing")


@query("SELECT CAST(count(*) - count(DISTINCT (grp, other)) AS BIGINT) AS n_duplicates, count(*) AS n_rows, round((count(*) - count(DISTINCT (grp, other))) * 100.0 / count(*), 6) AS pct_duplicates FROM l", L)
def dup_rows(s, d):
    return rounded(profile.duplicate_rows(A.lines(s, d), ["grp", "other"]), "pct_duplicates")


@query("SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n_left_ids, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS n_matched, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_orphans, (SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS n_left_duplicates, (SELECT count(*) - count(DISTINCT doc_id) FROM labels) AS n_right_duplicates, round((SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) * 100.0 / (SELECT count(DISTINCT doc_id) FROM documents), 6) AS pct_matched, (SELECT count(*) = count(DISTINCT doc_id) FROM labels) AND (SELECT count(*) = count(DISTINCT doc_id) FROM documents) AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS is_clean")
def join_validation(s, d):
    return rounded(profile.join_validation(A.table(s, d, "documents").select("doc_id"), A.table(s, d, "labels").select("doc_id"), "doc_id").drop("first_orphans"), "pct_matched")


@query("SELECT size, count(*) AS n_groups FROM (SELECT grp, count(*) AS size FROM o GROUP BY grp) GROUP BY size", O)
def group_size_dist(s, d):
    return profile.group_sizes(A.orders(s, d), "grp")


@query("SELECT CASE WHEN n <= 2 THEN CAST(n AS VARCHAR) WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 25 THEN '11-25' WHEN n <= 100 THEN '26-100' ELSE '100+' END AS bucket, CAST(sum(n) AS BIGINT) AS n_rows, round(sum(k) / sum(n), 9) AS rate FROM (SELECT grp, count(*) AS n, sum(y) AS k FROM o GROUP BY grp) GROUP BY 1", O)
def rate_by_group_size(s, d):
    return rounded(profile.rate_by_group_size(A.orders(s, d), "grp", "y"), "rate", places=9)


@query("SELECT count(*) AS n_groups, count(*) FILTER (n = 1) AS n_singletons, max(n) AS max_size, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_size FROM (SELECT grp, count(*) AS n FROM o GROUP BY grp)", O)
def group_size_summary(s, d):
    return profile.group_size_summary(A.orders(s, d), "grp")


@query("SELECT CAST(coalesce(sum(n) FILTER (n >= 9), 0) AS BIGINT) AS n_shared, round(sum(k) FILTER (n >= 9) / sum(n) FILTER (n >= 9), 9) AS rate_shared, CAST(coalesce(sum(n) FILTER (n < 9), 0) AS BIGINT) AS n_single, round(sum(k) FILTER (n < 9) / sum(n) FILTER (n < 9), 9) AS rate_single, CAST(sum(n) AS BIGINT) AS n_overall, round(sum(k) / sum(n), 9) AS rate_overall FROM (SELECT grp, count(*) AS n, sum(y) AS k FROM o GROUP BY grp)", O)
def shared_rate(s, d):
    return rounded(profile.shared_key_rates(A.orders(s, d), "grp", "y", 9), "rate_shared", "rate_single", "rate_overall", places=9)


_PCT = [f"pct_ge_{t}" for t in SUFFICIENCY_THRESHOLDS]
_RPCT = ", ".join(f"round(avg(CASE WHEN c >= {t} THEN 100.0 ELSE 0.0 END), 6) AS pct_ge_{t}" for t in SUFFICIENCY_THRESHOLDS)


@query(f"SELECT count(*) AS n_rows, {_RPCT} FROM k", P + ", " + H1)
def sufficiency_thresholds(s, d):
    return rounded(profile.sufficiency(counted(s, d), "c"), *_PCT)


@query(f"SELECT part, count(*) AS n_rows, {_RPCT} FROM k WHERE part IS NOT NULL GROUP BY part", P + ", " + H1)
def sufficiency_by_partition(s, d):
    return rounded(profile.sufficiency_by(counted(s, d), "c", "part", PARTITIONS), *_PCT)


@query("SELECT min(c) AS min, quantile_cont(c, 0.25) AS p25, quantile_cont(c, 0.5) AS p50, quantile_cont(c, 0.75) AS p75, quantile_cont(c, 0.9) AS p90, quantile_cont(c, 0.99) AS p99, max(c) AS max, round(avg(c), 6) AS mean FROM k", P + ", " + H1)
def count_distribution(s, d):
    return rounded(profile.count_distribution(counted(s, d), "c"), "mean")


@query(f"SELECT kk AS k, count(*) AS n_rows, {_RPCT} FROM k JOIN (SELECT grp, row_number() OVER (ORDER BY count(*) DESC, grp) AS pl FROM p GROUP BY grp) USING (grp), (SELECT unnest([1, 3, 5, 10]) AS kk) WHERE pl > kk GROUP BY kk", P + ", " + H1)
def dominant_exclusion(s, d):
    return rounded(profile.dominant_exclusion(counted(s, d), "grp", "c"), *_PCT)


@query("SELECT kk AS k, CAST(sum(n) AS BIGINT) AS n_rows, round(sum(n) * 100.0 / (SELECT count(*) FROM l), 6) AS pct_rows FROM (SELECT other, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, other) AS pl FROM l GROUP BY other), (SELECT unnest([1, 3, 5, 10]) AS kk) WHERE pl <= kk GROUP BY kk", L)
def topk_concentration(s, d):
    return rounded(profile.top_k_concentration(A.lines(s, d), "other"), "pct_rows")


@query("SELECT part, count(*) AS n_rows, count(*) FILTER (cat IS NOT NULL AND grp IS NOT NULL) AS n_valid FROM p GROUP BY part", P)
def row_coverage(s, d):
    return links.row_coverage(parts(s, d), "grp", "cat", "part")


_PAIRS = L + ", x AS (SELECT grp, other, min(dt) AS f FROM l GROUP BY ALL), t AS (SELECT grp, max(dt) AS last FROM l GROUP BY grp), q AS (SELECT grp, other FROM x JOIN t USING (grp) WHERE f < last), fan AS (SELECT t.grp, count(q.other) AS fanout FROM t LEFT JOIN q USING (grp) GROUP BY t.grp)"


@query("SELECT grp, fanout FROM fan", _PAIRS)
def fan_out(s, d):
    return links.fan_out(A.lines(s, d), "grp", "other", "dt")


@query("SELECT count(*) AS n_anchors, round(avg(pct), 6) AS mean_overlap, coalesce(avg(pct) >= 20, false) AS signal FROM (SELECT grp, avg(CASE WHEN h > 1 THEN 100.0 ELSE 0.0 END) AS pct FROM (SELECT q.*, count(*) OVER (PARTITION BY other) AS h FROM q JOIN fan USING (grp) WHERE fanout >= (SELECT quantile_cont(fanout, 0.99) FROM fan)) GROUP BY grp)", _PAIRS)
def overlap_m5(s, d):
    return rounded(links.overlap(A.lines(s, d), "grp", "other", "dt"), "mean_overlap")


_HIGH = "hi AS (SELECT grp, fanout FROM (SELECT *, rank() OVER (ORDER BY fanout DESC) AS r FROM fan WHERE fanout > 0) WHERE r <= greatest(10, CAST(ceil((SELECT count(*) FROM fan) * 0.01) AS BIGINT)))"


@query("SELECT * FROM hi", _PAIRS + ", " + _HIGH)
def high_fanout(s, d):
    return links.high_fanout(links.fan_out(A.lines(s, d), "grp", "other", "dt"), "grp")


@query("SELECT other, count(*) AS n_anchors, round(count(*) / (SELECT count(*) FROM fan), 9) AS prevalence FROM q GROUP BY other", _PAIRS)
def partner_prevalence(s, d):
    df = A.lines(s, d)
    n = df.select("grp").distinct().count()
    return rounded(links.partner_prevalence(links.causal_pairs(df, "grp", "other", "dt"), "other", n), "prevalence", places=9)


@query("SELECT n AS n_anchors, h AS n_high, round(o, 6) AS observed, round(e, 6) AS expected, round(CASE WHEN h >= 2 THEN o / greatest(e, 0.5) END, 6) AS lift, coalesce(h >= 2 AND o / greatest(e, 0.5) >= 2, false) AS signal FROM (SELECT (SELECT count(*) FROM fan) AS n, (SELECT count(*) FROM hi) AS h, avg(o) AS o, avg(e) AS e FROM (SELECT grp, avg(CASE WHEN c > 1 THEN 100.0 ELSE 0.0 END) AS o, avg((1 - pow(1 - pr, (SELECT count(*) FROM hi) - 1)) * 100) AS e FROM (SELECT q.grp, q.other, count(*) OVER (PARTITION BY q.other) AS c FROM q JOIN hi USING (grp)) JOIN (SELECT other, count(*) / (SELECT count(*) FROM fan) AS pr FROM q GROUP BY other) USING (other) GROUP BY grp))", _PAIRS + ", " + _HIGH)
def freq_adjusted_overlap(s, d):
    return rounded(links.adjusted_overlap(A.lines(s, d), "grp", "other", "dt"), "observed", "expected", "lift")


@query(f"SELECT (SELECT count(*) FROM o WHERE day < {DRIFT_DAY}) AS n_early, (SELECT count(*) FROM o WHERE day >= {DRIFT_DAY}) AS n_late, round((SELECT avg(amt) FROM o WHERE day < {DRIFT_DAY}), 4) AS mean_early, round((SELECT avg(amt) FROM o WHERE day >= {DRIFT_DAY}), 4) AS mean_late, 0.0::DOUBLE AS pct_missing_early, 0.0::DOUBLE AS pct_missing_late, round(max(abs(a / (SELECT count(*) FROM o WHERE day < {DRIFT_DAY}) - b / (SELECT count(*) FROM o WHERE day >= {DRIFT_DAY}))), 9) AS ks_statistic FROM (SELECT sum(CAST(day < {DRIFT_DAY} AS INT)) OVER (ORDER BY amt) AS a, sum(CAST(day >= {DRIFT_DAY} AS INT)) OVER (ORDER BY amt) AS b FROM o)", O)
def ks_statistic(s, d):
    return rounded(rounded(stats.ks_statistic(A.orders(s, d), "amt", F.col("day") < DRIFT_DAY), "mean_early", "mean_late", places=4), "ks_statistic", places=9)


@query(f"SELECT k AS n_categories, round(sum((a - (a + b) * ta / (ta + tb)) ** 2 / ((a + b) * ta / (ta + tb)) + (b - (a + b) * tb / (ta + tb)) ** 2 / ((a + b) * tb / (ta + tb))), 6) AS chi2, k - 1 AS df FROM (SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb, count(*) OVER () AS k FROM (SELECT cat, count(*) FILTER (day < {DRIFT_DAY}) AS a, count(*) FILTER (day >= {DRIFT_DAY}) AS b FROM o GROUP BY cat)) GROUP BY k", O)
def chi2_statistic(s, d):
    return rounded(stats.chi2_statistic(A.orders(s, d), "cat", F.col("day") < DRIFT_DAY), "chi2")


@query("SELECT count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_positive, round((sum(y * rk) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) AS roc_auc, round((SELECT sum(p * tp / tn) / sum(p) FROM (SELECT p, sum(p) OVER (ORDER BY v DESC) AS tp, sum(n) OVER (ORDER BY v DESC) AS tn FROM (SELECT round(amt, -3) AS v, sum(y) AS p, count(*) AS n FROM o GROUP BY 1))), 9) AS average_precision FROM (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM (SELECT y, round(amt, -3) AS v FROM o))", O)
def score_metrics(s, d):
    return rounded(stats.score_metrics(A.orders(s, d).withColumn("v", F.round("amt", -3)), "v", "y"), "roc_auc", "average_precision", places=9)


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(corr({c}, CAST(l_returnflag = 'R' AS INT)), 9) AS correlation FROM lineitem" for c in _NUM))
def target_corr(s, d):
    df = A.table(s, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(stats.target_correlation(df, _NUM, "y"), "correlation", places=9)


@query("SELECT count(*) AS n_rows, round(corr(a, b), 9) AS spearman FROM (SELECT rank() OVER (ORDER BY id) + (count(*) OVER (PARTITION BY id) - 1) / 2.0 AS a, rank() OVER (ORDER BY dt) + (count(*) OVER (PARTITION BY dt) - 1) / 2.0 AS b FROM o)", O)
def id_time_spearman(s, d):
    return rounded(stats.order_correlation(A.orders(s, d), "id", "dt"), "spearman", places=9)


@query("SELECT round(pct, 4) AS pct_missing, count(*) AS n_columns, round(max(abs(r)), 9) AS max_abs, round(avg(abs(r)), 9) AS mean_abs FROM (" + " UNION ALL ".join(f"SELECT (count(*) - count({c})) * 100.0 / count(*) AS pct, corr({c}, CAST(lang = 'en' AS INT)) AS r FROM documents LEFT JOIN labels USING (doc_id)" for c in ("n_chars", "quality", "toxic")) + ") GROUP BY 1")
def missing_blocks(s, d):
    df = A.table(s, d, "documents").join(A.table(s, d, "labels"), "doc_id", "left").select("n_chars", "quality", "toxic", (F.col("lang") == "en").cast("int").alias("y"))
    out = stats.missing_blocks(profile.missingness(df.drop("y")), stats.target_correlation(df, ["n_chars", "quality", "toxic"], "y"))
    return rounded(out, "max_abs", "mean_abs", places=9).drop("top_column")


@query("SELECT CAST(greatest(len(list_filter((SELECT quantile_cont(amt, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) FROM o), lambda e: e < amt)) - 1, 0) AS INT) AS bucket, count(*) AS n_rows, round(avg(y), 9) AS rate FROM o GROUP BY 1", O)
def decile_rate(s, d):
    return rounded(stats.decile_rates(A.orders(s, d), "amt", "y"), "rate", places=9)


_EDGES = (50000, 100000, 200000, 400000, 10000000)


@query("SELECT b AS bucket, count(o.id) AS n_rows, round(avg(y), 9) AS rate FROM (SELECT CAST(unnest(range(6)) AS INT) AS b) LEFT JOIN o ON b = " + " + ".join(f"CAST(amt >= {e} AS INT)" for e in _EDGES) + " GROUP BY b", O)
def fixed_bucket_rate(s, d):
    return rounded(stats.bucket_rates(A.orders(s, d), C.fixed_bucket(F.col("amt"), _EDGES), "y", 6), "rate", places=9)


@query("SELECT part, 'amt' AS column_name, round(avg(amt), 4) AS mean, round(stddev_samp(amt), 4) AS std, 0.0::DOUBLE AS pct_missing FROM p GROUP BY part UNION ALL SELECT part, 'y', round(avg(y), 4), round(stddev_samp(y), 4), 0.0 FROM p GROUP BY part", P)
def summary_by_partition(s, d):
    return rounded(stats.summary_by(parts(s, d), "part", ["amt", "y"]), "mean", "std", places=4)


_STATE = P + ", seen AS (SELECT * FROM p WHERE part IN ('train', 'embargo_1', 'validation')), batch AS (SELECT * FROM p WHERE part IN ('validation', 'embargo_2', 'holdout'))"


def _state(s, d):
    df = parts(s, d)
    return state.initial_state(df.where(F.col("part").isin("train", "embargo_1", "validation"))), df.where(F.col("part").isin("validation", "embargo_2", "holdout")).select("id", "grp", "dt", "amt", "y")


@query("SELECT id, grp, dt, amt FROM batch WHERE id NOT IN (SELECT id FROM seen)", _STATE)
def dedupe_new_rows(s, d):
    st, batch = _state(s, d)
    return state.new_rows(batch, st.seen, state.BUFFER)


@query("SELECT grp, count(*) AS n, round(sum(amt), 2) AS total, max(dt) AS last FROM p WHERE part IS NOT NULL GROUP BY grp", _STATE)
def buffer_after_record(s, d):
    st, batch = _state(s, d)
    out = state.record_observed(st, batch).buffer.groupBy("grp").agg(F.count("*").alias("n"), F.sum("amt").alias("total"), F.max("dt").alias("last"))
    return rounded(out, "total", places=2)


@query("SELECT grp, CAST(sum(y) AS BIGINT) AS n_positive, count(*) AS n_events FROM p WHERE part IS NOT NULL AND part <> 'embargo_1' GROUP BY grp", _STATE)
def state_counts_after_update(s, d):
    st, batch = _state(s, d)
    return state.update_resolved(st, batch).counters


@query("SELECT count(*) AS n_buffer, count(DISTINCT grp) AS n_groups, (SELECT CAST(sum(y) AS BIGINT) FROM seen WHERE part <> 'embargo_1') AS n_positive, (SELECT count(*) FROM seen WHERE part <> 'embargo_1') AS n_events, (SELECT count(*) FROM seen WHERE part <> 'embargo_1') AS n_resolved FROM seen", _STATE)
def state_summary(s, d):
    return state.summary(_state(s, d)[0])


@query()
def score_requests(s, d):
    st, batch = _state(s, d)
    return state.score_inputs(st, batch.drop("y"))


def _monthly_edges(s, d):
    return A.lines(s, d).select("id", F.col("grp"), F.col("other"), F.floor(F.col("dt") / 30).alias("dt"))


@query()
def component_metrics(s, d):
    """All edges between suppliers and parts; ``dt`` is a 30-day month."""
    return graph.causal_component_metrics(_monthly_edges(s, d), "grp", "other", "dt")


@query()
def component_summary(s, d):
    return graph.component_summary(component_metrics(s, d))


def _matrix(s, d):
    ids = A.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return model.ladder_matrix(C.with_match_flag(A.orders(s, d), ids, "id"), SPLIT, ["train", "validation"])


@query("SELECT f.id, f.part, f.y, round(f.amt, 6) AS amt_log1p, has_identity, f.nw AS prior_count_in_window, round(coalesce(f.zs, 0), 6) AS modified_zscore, CAST(f.flag = 'insufficient_history' AS INT) AS flag_insufficient_history FROM f JOIN (SELECT id, CAST(id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS INT) AS has_identity FROM p) i ON i.id = f.id WHERE f.part IN ('train', 'validation')", P + ", " + _SCORED)
def ladder_matrix(s, d):
    return rounded(_matrix(s, d), "amt_log1p", "modified_zscore").select("id", "part", "y", "amt_log1p", "has_identity", "prior_count_in_window", "modified_zscore", "flag_insufficient_history")


@query()
def lr_score(s, d):
    m = model.matrix(_matrix(s, d), "F2").persist()
    fitted = model.fit(m.where("part = 'train'"), "F2")
    return stats.score_metrics(model.score(fitted, m.where("part = 'validation'")), "score", "y")

"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.llm import audio_fingerprint, embedding_dedup, html_wrappers, jaccard_join, language_id, line_dedup, mixing, pii, sentencepiece_codec, token_store
from antecede.llm.common import load, tokenizer_path


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(load(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language_id.identify(docs, F.col("lang"), F.col("source"))


def lid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_pages(load(spark, sf_dir, "pages"))


def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(load(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of ``embeddings`` as recordings (``melody``); every hundredth asks for all that align with it, one row a query
    and thousand matches."""
    return audio_fingerprint.report(load(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, "vec_id", "embedding", audio_fingerprint.melody)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", line_dedup.kept_sha256(F.col("text")).alias("kept_sha256"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(spark, sf_dir, tokenizer_path("word_bpe_49k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(load(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=90)


#: The production mixture of ``documents``: weights by level, share of the corpus's tokens, epochs.
MIX_WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 4.0, "de": 2.0, "es": 2.0, "fr": 2.0}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 3, 17


def mix_levels() -> dict:
    """Domain, language and source of ``documents``; a source's number decides its domain."""
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("source", "([0-9]{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return {"domain": F.concat(F.lit("d"), (number % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return mixing.mix_slim(docs, mix_levels(), MIX_WEIGHTS, F.floor(F.col("_all") * MIX_SHARE), MIX_EPOCHS, MIX_SEED)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_pii, op3_sentencepiece, op4_language_id, op5_html_wrappers, op6_audio_fingerprint, op7_line_dedup, op8_token_store, op9_jaccard_join, op10_mixing, lid_pages)}


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, r.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: Least id that each node of ``edges (a, b)``, given in both directions, reaches.
_COMPONENTS = "reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a), least_of AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"

OP1_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), good AS (
  SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), half AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id < q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.95
), edges AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half), {_COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM edges WHERE a = vec_id) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM v LEFT JOIN least_of ON a = vec_id
"""

OP9_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets), half AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM sh p JOIN sh q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(p.n) + any_value(q.n) - count(*))
), edges AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half), {_COMPONENTS}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM sets LEFT JOIN least_of ON a = doc_id
"""


def _weight_sql(level: str) -> str:
    table = MIX_WEIGHTS.get(level, {})
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1.0 END" if table else "1.0"


def mixing_sql(documents: str = "documents", share: float = MIX_SHARE, epochs: int = MIX_EPOCHS) -> str:
    """The mixture in SQL, leaf by leaf over all rows; ends in a table ``mixed``."""
    ctes = [
        f"slim AS (SELECT doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1), '') AS BIGINT), 0) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM {documents})",
        "leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM slim GROUP BY ALL)",
        f"l0 AS (SELECT CAST(least(floor(coalesce(sum(tokens), 0) * {share}), coalesce(sum(tokens), 0) * {epochs}) AS DOUBLE) AS budget FROM leaves)",
    ]
    above: list[str] = []
    for n, level in enumerate(("domain", "lang", "source"), 1):
        own = [*above, level]
        cols, part = ", ".join(own), "PARTITION BY " + ", ".join(above) if above else ""
        on = f"JOIN l{n - 1} USING ({', '.join(above)})" if above else "CROSS JOIN l0"
        ctes += [
            f"c{n} AS (SELECT * FROM (SELECT {cols}, CAST(sum(tokens) * {epochs} AS DOUBLE) AS cap, CAST({_weight_sql(level)} AS DOUBLE) AS w FROM leaves GROUP BY {cols}) {on} WHERE cap > 0)",
            f"r{n} AS (SELECT *, row_number() OVER k AS k, (budget - (sum(cap) OVER u - cap)) / (sum(w) OVER a - sum(w) OVER u + w) AS rate FROM c{n} WINDOW a AS ({part}), k AS ({part} ORDER BY cap / w, {level}), u AS ({part} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
            f"l{n} AS (SELECT {cols}, CASE WHEN cap / w <= rate THEN cap ELSE w * arg_min(rate, k) FILTER (cap / w > rate) OVER ({part}) END AS budget FROM r{n})",
        ]
        above = own
    ctes += [
        "given AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN CAST(floor(coalesce(budget, 0) + 1e-6) AS BIGINT) // tokens ELSE 0 END AS epoch, CASE WHEN tokens > 0 THEN CAST(floor(coalesce(budget, 0) + 1e-6) AS BIGINT) % tokens ELSE 0 END AS rest FROM leaves LEFT JOIN l3 USING (domain, lang, source))",
        f"keyed AS (SELECT slim.*, epoch, rest, md5('{MIX_SEED}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM slim JOIN given USING (domain, lang, source))",
        "mixed AS (SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM keyed)",
    ]
    return "WITH " + ",\n".join(ctes)


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op9_jaccard_join": OP9_SQL, "op7_line_dedup": OP7_SQL, "op10_mixing": mixing_sql() + "\nSELECT * FROM mixed"}

"""A corpus through five of the training-data operators, each stage on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.llm import jaccard_join, language_id, line_dedup, mixing, sentencepiece_codec
from antecede.llm.common import drop_stored, load, stored, tokenizer_path
from antecede.llm.queries import MIX_SEED, MIX_WEIGHTS, mix_levels

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the kept tokens that the mixture takes; every document at most once.
MIX_SHARE = 0.9
MIN_DOCS = 10
#: Rows that go up to which their numbers are sent to every task (8 bytes each); beyond it they are joined.
BROADCAST_ROWS = 2_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the others go."""
    return language_id.identify(docs, F.col("lang"), F.col("source"), keep_text=True).where("accepted").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; ``n_chars`` follows the text."""
    out = line_dedup.drop_repeated_lines(docs, min_docs=MIN_DOCS)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8) stays: the least id, nulls last; of rows with one id, one.
    Rows without words are in no group and all stay."""
    rows = stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = jaccard_join.join(rows, "_row", "text", size=5, percent=80).where("n_shingles > 0").select("_row", "component_id")
    shared = stored(groups.join(groups.groupBy("component_id").agg(F.count("*").alias("_size")).where("_size > 1"), "component_id").join(rows.select("_row", "doc_id"), "_row"), "grouped")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    stays = shared.groupBy("component_id").agg(F.min_by("_row", order).alias("_stays"))
    gone = stored(shared.join(stays, "component_id").where("_row <> _stays").select("_row"), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, "_row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents."""
    out = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, F.floor(F.col("_all") * MIX_SHARE), 1, MIX_SEED)
    return out.where("copies > 0").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document as digests, with its language and source."""
    return sentencepiece_codec.digests(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("jaccard_join", dedup_documents), ("mixing", mix_sources), ("sentencepiece", encode)]
#: Language models and byte-pair encoding are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written and read again."""
    docs, before = load(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
            if before is not None:
                drop_stored(before)
            before = docs
    return docs

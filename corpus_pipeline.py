"""The corpus pipeline: documents in, shard places of the documents that stay out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfsense.llm.common import read, stored
from shelfsense.llm.decontaminate import decontaminate
from shelfsense.llm.jaccard import near_duplicates
from shelfsense.llm.language import UNKNOWN, identify, learn
from shelfsense.llm.mixing import Mix, mixture
from shelfsense.llm.queries import LANG_SHARES, SHARDS, SOURCE_SHARES, TOPIC_SHARES
from shelfsense.llm.sharding import ring_shards

#: Cosine below which a text is in none of the learned languages.
MIN_SCORE = 0.05
#: Share of the tokens the mixing stage keeps at most; the target shares come first.
KEEP = 0.95
#: No SQL: bundling random vectors and raking are not written in SQL; tested by brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without letters or unlike all languages go.

    Prototypes are learned from all rows with a text and a language. Where nothing is learned
    no language is known and every document goes.
    """
    # The row travels in a struct, past columns of its own that are named like the results.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = identify(rows, learn(docs), keep=("row",))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies.

    Of rows that repeat an id the first by text stays. Rows without an id cannot be grouped by
    it and stay.
    """
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    rows = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(
        F.struct(*docs.columns).alias("row"), "doc_id", F.row_number().over(first).alias("nth")
    )
    return rows.where("nth = 1").select("row.*").union(docs.where("doc_id is null").select(*docs.columns))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows.

    Null and empty texts have none and stay; repeated rows are judged alike. Without benchmark
    items, or without documents, nothing changes.
    """
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that their tokens meet the target shares in expectation.

    Rows of a source or language without a target go, those where it is null among them. Rows
    equal in id and text go or stay together. An empty table stays empty.
    """
    shares = Mix(SOURCE_SHARES, LANG_SHARES, TOPIC_SHARES)
    hashed = F.xxhash64("text").alias("mix_text_hash")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang", "source", hashed)
    chosen = (
        mixture(rows, shares, keep=KEEP, keyed_by=("doc_id", "mix_text_hash"))
        .where("sampled")
        .select(F.col("doc_id").alias("mix_id"), F.col("mix_text_hash").alias("mix_hash"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("mix_id")) & (F.col("mix_text_hash") == F.col("mix_hash"))
    return rows.join(chosen, same, "left_semi").select("row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, counts at most one apart.

    A null text has size 16; rows without id are placed by their text; equal rows take
    neighbouring slots. An empty table gives no rows; only the places come out.
    """
    return ring_shards(docs, SHARDS, load=1.0)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_free", benchmark_free),
    ("mixed", mixed),
    ("sharded", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

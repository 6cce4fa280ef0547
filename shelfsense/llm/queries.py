"""The registered queries: thin digests of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import checks
from .common import id_remainder, read, stored

SHARDS = 40


# Token shares wanted by the mixing query and by the pipeline.
SOURCE_SHARES = {f"src{i}": 0.05 for i in range(20)}
LANG_SHARES = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}
TOPIC_SHARES = {"legal": 0.05, "noise": 0.05, "prose": 0.85, "table": 0.05}


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, learn

    docs = read(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    found = identify(docs, learn(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = train(docs.where(~held_out), labels.where(~held_out))
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mix, mixture

    mix = Mix(SOURCE_SHARES, LANG_SHARES, TOPIC_SHARES)
    return mixture(read(spark, sf_dir, "documents"), mix, keep=0.5)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(read(spark, sf_dir, "pages"))


def op10_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .preference import preference_pairs

    return preference_pairs(read(spark, sf_dir, "conversations"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets, written

    found = find_secrets(read(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load factor 1: the law is ``rows``, counts at most one apart."""
    from .sharding import ring_shards

    placed = ring_shards(read(spark, sf_dir, "documents"), SHARDS, load=1.0)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, row_of, write_archives

    pages = read(spark, sf_dir, "pages")
    kind = dict(pages.dtypes)["page_id"]
    folder = scratch_path(spark, "warc")
    files = stored(write_archives(pages, folder), "archives")
    return read_archives(files, folder).where("record_type in ('response', 'revisit')").select(
        row_of("record_id", kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        row_of("refers_to", kind).alias("refers_to"),
    )


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clusters import cluster_vectors, with_totals

    return with_totals(cluster_vectors(read(spark, sf_dir, "embeddings"))).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_html_extraction": op9_html_extraction,
    "op10_preference_formatting": op10_preference_formatting,
    "op11_warc": op11_warc,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL: dict[str, str] = checks.SQL

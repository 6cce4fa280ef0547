"""Streams of new reviews and pages.

Every job reads a folder as a stream, handles what is new (``availableNow``) and keeps
its place in a checkpoint, so a second run over the same input does nothing. Batches go
through the same operators as batch tables and are written under their batch number: a
batch that is repeated after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .. import schemas
from ..operators.extract import extract_reviews
from ..operators.joins import lookup_join, unprocessed_products
from ..operators.merge import new_rows_only
from ..operators.nlp import nlp_incremental
from ..operators.sentiment import carried_words, sentiment_table, with_sentiment
from ..sources.readers import is_file, path_exists

Batch = Callable[[DataFrame, int], DataFrame]  # the new rows and the batch number

BATCH = StructField("batch", LongType())
HARVESTED = StructType(
    [StructField("page_no", IntegerType()), StructField("position", IntegerType()),
     *schemas.REVIEW.fields]
)

def parquet_stream(
    spark: SparkSession, path: str, schema: StructType, **options
) -> DataFrame:
    """New files of the folder at ``path``; a single file is watched in its folder."""
    reader = spark.readStream.schema(schema).options(**options)
    if is_file(spark, path):
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_available(
    stream: DataFrame,
    transform: Batch,
    out: str,
    checkpoint: str,
    after: Callable[[SparkSession, int], None] | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Transform everything that is new and append it to ``out``; waits until done.

    ``after`` runs when a batch has been written and before it counts as done, so it is repeated
    with the batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch, batch_id).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if after:
            after(batch.sparkSession, batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def written(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/batch=*")


def written_before(
    spark: SparkSession, out: str, schema: StructType, batch_id: int
) -> DataFrame:
    """Output of earlier batches. The batch's own folder is left out: it may hold the
    result of a first attempt, which must not make the rows look already stored."""
    if not path_exists(spark, out):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(StructType([*schema.fields, BATCH])).parquet(out)
    return stored.filter(F.col("batch") < batch_id).drop("batch")


def enrich_reviews(words: DataFrame, concatenate: bool = False, key: str = "seq") -> Batch:
    """Sentences, words and sentiment for a batch of new reviews.

    Where the lexicon goes along with the plan a batch is enriched in one narrow pass. With a
    larger one the rows are hashed by ``key``, and scoring and the join of the scores find them in
    place.
    """
    lexicon = carried_words(words)

    def transform(batch: DataFrame, _: int) -> DataFrame:
        if lexicon is not None:
            # Scores first: the steps of scoring would carry the words and sentences along.
            rows = nlp_incremental(with_sentiment(batch, lexicon), concatenate)
            if "sentiment_analysis" in batch.columns:
                return rows
            return rows.select(*[c for c in rows.columns if c != "sentiment_analysis"], "sentiment_analysis")
        spread = batch.repartition(key)
        scores = sentiment_table(spread, words, key)
        return nlp_incremental(spread, concatenate).join(scores, key, "left")

    return transform


def resume_harvest(products: DataFrame, out: str) -> Batch:
    """Reviews out of a batch of pages, for products without stored reviews.

    Reads what was written before; ``known_keys`` does without.
    """
    urls = products.select("product_url").distinct()

    def transform(pages: DataFrame, batch_id: int) -> DataFrame:
        stored = written_before(pages.sparkSession, out, HARVESTED, batch_id)
        todo = unprocessed_products(urls, stored)
        return lookup_join(extract_reviews(pages, "page_no"), todo, "product_url", "left_semi")

    return transform


def dedup_batches(out: str, schema: StructType, key: str = "review_id", order: str = "seq") -> Batch:
    """Rows whose key is neither repeated in the batch nor written before.

    Repeats collapse on the map side, so a key with very many copies stays cheap. Reads what was
    written before; ``known_keys`` does without.
    """

    def transform(batch: DataFrame, batch_id: int) -> DataFrame:
        stored = written_before(batch.sparkSession, out, schema, batch_id)
        return new_rows_only(stored, batch, key, order)

    return transform


def harvest_pages(products: DataFrame) -> Batch:
    """Reviews out of a batch of pages of the given products."""
    urls = products.select("product_url").distinct()

    def transform(pages: DataFrame, _: int) -> DataFrame:
        return lookup_join(extract_reviews(pages, "page_no"), urls, "product_url", "left_semi")

    return transform


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, with changes in the checkpoint."""
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_append(stream: DataFrame, out: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Append the rows of a stateful stream to ``out``; waits until all that is there is done."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    query = writer.trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query


def stream_dedup(
    stream: DataFrame,
    event_time: str,
    delay: str = "1 day",
    key: str = "review_id",
    spread_by: str | None = None,
    salts: int = 64,
) -> DataFrame:
    """Drop rows repeating a key within ``delay`` of its first arrival.

    A key is forgotten when the watermark, the latest time seen less ``delay``, has passed its own
    time by ``delay``: the state holds the keys of that span and no more. Rows older than
    the watermark are late and are dropped.

    With ``spread_by`` (a column that differs between copies) copies of one key first
    meet in up to ``salts`` tasks, and only one row from each goes on to the final step.
    """
    marked = stream.withWatermark(event_time, delay)
    if spread_by:
        salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
        marked = (
            marked.withColumn("_salt", salt)
            .dropDuplicatesWithinWatermark([key, "_salt"])
            .drop("_salt")
        )
    return marked.dropDuplicatesWithinWatermark([key])


def progress_metrics(run: str = "run") -> Batch:
    """Counts of a batch, one row, to be appended to a metrics table."""

    def transform(batch: DataFrame, _: int) -> DataFrame:
        text = F.coalesce(F.col("body"), F.lit(""))
        return batch.agg(
            F.lit(run).alias("run"),
            F.count(F.lit(1)).alias("processed"),
            F.count_if(F.length(F.trim(text)) > 0).alias("with_text"),
            F.count_if(F.col("rating").isNotNull()).alias("rated"),
        )

    return transform


def observed_progress(query: StreamingQuery, name: str) -> list[dict]:
    """What ``df.observe(name, ...)`` reported for the batches Spark still remembers; a
    ``progress.ProgressLog`` keeps those of all batches."""
    reports = []
    for progress in query.recentProgress:
        metrics = progress.observedMetrics.get(name)
        if metrics is not None:
            reports.append({"batch": progress.batchId, **metrics.asDict()})
    return reports

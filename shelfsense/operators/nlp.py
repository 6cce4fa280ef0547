"""Sentences, words and keywords of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.html import computed
from ..functions.text import is_blank
from .filters import missing_field
from .joins import reviews_with_products

NLP_COLUMNS = (
    "sentences", "words", "nlp_processed_at", "nlp_concatenated", "nlp_text_used",
)


def nlp_values(concatenate: bool, run_ts: Column | None) -> dict[str, Column]:
    """The enrichment columns from ``_text`` and ``_marked``, NULL where those are."""
    stamp = F.current_timestamp() if run_ts is None else run_ts
    text = F.col("_text")
    done = text.isNotNull()
    return {
        "sentences": tokens.sentences(text, F.col("_marked")),
        "words": tokens.words(text, F.col("_marked")),
        "nlp_processed_at": F.when(done, stamp),
        "nlp_concatenated": F.when(done, F.lit(concatenate)),
        "nlp_text_used": text,
    }


def nlp_enrich(
    reviews: DataFrame,
    concatenate: bool = False,
    run_ts: Column | None = None,
    skip_processed: bool = False,
) -> DataFrame:
    """Add sentences, words and bookkeeping; rows with blank text keep NULLs.

    ``skip_processed`` keeps the values of rows that have sentences already. One
    projection over one scan, no shuffle.
    """
    text = tokens.combine_text(F.col("title"), F.col("body"), concatenate)
    skip = skip_processed and "sentences" in reviews.columns
    todo = F.col("sentences").isNull() if skip else F.lit(True)
    values = nlp_values(concatenate, run_ts)
    if skip:
        values = {
            name: F.when(todo, value).otherwise(F.col(name)) if name in reviews.columns else value
            for name, value in values.items()
        }
    others = [c for c in reviews.columns if c not in values]
    # Sentences and words share the marked text.
    used = reviews.withColumn("_text", F.when(todo & ~is_blank(text), text))
    marked = computed(used, {"_marked": tokens.mark_sentences(F.col("_text"))})
    return marked.select(*others, *[value.alias(name) for name, value in values.items()])


def nlp_incremental(
    reviews: DataFrame,
    concatenate: bool = False,
    skip_processed: bool = True,
    run_ts: Column | None = None,
) -> DataFrame:
    """The newly enriched rows: those lacking sentences (or all), blank texts left out."""
    todo = reviews
    if skip_processed and "sentences" in reviews.columns:
        todo = missing_field(reviews, "sentences")
    return nlp_enrich(todo, concatenate, run_ts).filter(F.col("nlp_text_used").isNotNull())


def nlp_result(enriched: DataFrame, *keep: str) -> DataFrame:
    """Per-review counts of an enrichment run."""
    return enriched.select(
        *keep,
        "review_id",
        F.size("sentences").alias("sentences_count"),
        F.size("words").alias("words_count"),
        F.col("sentences").isNotNull().alias("updated"),
    )


def word_uses(
    texts: DataFrame, text: str, by: str, stop_words=tokens.STOP_WORDS, min_length: int = 3
) -> DataFrame:
    """``by``, ``word`` and ``uses``: how often each word occurs, stop words and short tokens left
    out. Counting combines on the map side."""
    word = F.lower(F.col("_word"))
    return (
        texts.filter(~is_blank(F.col(text)))
        .select(by, F.explode(tokens.words(F.col(text))).alias("_word"))
        .select(by, word.alias("word"))
        .filter((F.length("word") >= min_length) & ~F.col("word").isin(*stop_words))
        .groupBy(by, "word")
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def most_used(uses: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` most used words per ``by``; the rank filter keeps ``n`` rows per group in every
    task before the groups are brought together."""
    rank = Window.partitionBy(by).orderBy(F.desc("uses"), "word")
    return uses.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= n)


def top_keywords(
    texts: DataFrame,
    text: str,
    by: str,
    n: int = 10,
    stop_words=tokens.STOP_WORDS,
    min_length: int = 3,
) -> DataFrame:
    """The ``n`` most frequent words per ``by``."""
    return most_used(word_uses(texts, text, by, stop_words, min_length), by, n)


def top_keywords_by_product(
    reviews: DataFrame, products: DataFrame, by: str, n: int = 10, text: str = "body", order: str = "k"
) -> DataFrame:
    """The ``n`` most frequent words of reviews per ``by``, a column of their products.

    Words are counted per product first; counts are joined with products, texts never.
    """
    counts = word_uses(reviews.select("product_url", text), text, "product_url")
    named = reviews_with_products(counts, products, by, order=order)
    return most_used(named.groupBy(by, "word").agg(F.sum("uses").alias("uses")), by, n)

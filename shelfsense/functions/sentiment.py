"""Fusion of the two sentiment scores into label, confidence and struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from .text import clamp, round_n


def combined_score(compound: Column, polarity: Column) -> Column:
    return (compound + polarity) / 2


def sentiment_label(combined: Column, threshold: float = fixed.LABEL_THRESHOLD) -> Column:
    return (
        F.when(combined >= threshold, F.lit("positive"))
        .when(combined <= -threshold, F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def confidence(
    compound: Column,
    polarity: Column,
    agreement_weight: float = fixed.AGREEMENT_WEIGHT,
    intensity_weight: float = fixed.INTENSITY_WEIGHT,
) -> Column:
    """Weighted agreement of the two scores and strength of their mean, unrounded."""
    agreement = F.lit(1) - F.abs(compound - polarity) / 2
    intensity = F.abs(combined_score(compound, polarity))
    return clamp(agreement * agreement_weight + intensity * intensity_weight, 0.0, 1.0)


def sentiment_struct(
    blank: Column,
    compound: Column,
    positive: Column,
    negative: Column,
    neutral: Column,
    polarity: Column,
) -> Column:
    """The stored struct; blank text is neutral without scores."""
    combined = combined_score(compound, polarity)

    def scored(value: Column) -> Column:
        return F.when(~blank, value)

    scores = F.struct(
        round_n(compound, 3).alias("compound"),
        round_n(positive, 3).alias("positive"),
        round_n(negative, 3).alias("negative"),
        round_n(neutral, 3).alias("neutral"),
    )
    return F.struct(
        F.when(blank, F.lit("neutral")).otherwise(sentiment_label(combined)).alias("sentiment"),
        F.when(blank, F.lit(0.0))
        .otherwise(round_n(confidence(compound, polarity), 3))
        .alias("confidence_score"),
        scored(round_n(combined, 3)).alias("combined_score"),
        scored(scores).alias("vader_scores"),
        F.when(blank, F.lit(0.0)).otherwise(round_n(polarity, 3)).alias("textblob_polarity"),
        F.when(blank, F.lit(fixed.BLANK_METHOD))
        .otherwise(F.lit(fixed.SCORED_METHOD))
        .alias("method"),
    )

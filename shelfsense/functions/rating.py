"""Numbers read out of rating widgets and review sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, group, strip

# --- fixed values -----------------------------------------------------------
COUNT = r"\((\d+)\)"
LEADING_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)"
STARS = rf"(\d+){SPACE}+out of 5 stars"
HELPFUL = rf"(\d+){SPACE}+people found"
# --- end of fixed values ----------------------------------------------------


def review_count(text: Column) -> Column:
    """The first number in brackets."""
    return group(text, COUNT).try_cast("bigint")


def parse_rating(text: Column) -> Column:
    """The number a text starts with, if it lies in 0..5."""
    value = group(strip(text), LEADING_NUMBER, 0).try_cast("double")
    return F.when(value.between(0, 5), value)


def rating_with_fallback(text: Column, *alternatives: Column) -> Column:
    """The main rating, or the first usable alternative when it is missing or zero."""
    main = parse_rating(text)
    others = F.coalesce(*[parse_rating(a) for a in alternatives])
    return F.when(main.isNull() | (main == 0), F.coalesce(others, main)).otherwise(main)


def has_reviews(total: Column, average: Column) -> Column:
    """Zero counts as missing."""
    zero = F.lit(0)
    return (F.coalesce(total, zero) != 0) | (F.coalesce(average, zero) != 0)


def stars(label: Column) -> Column:
    return group(label, STARS).try_cast("int")


def helpful_count(label: Column) -> Column:
    return F.coalesce(group(label, HELPFUL).try_cast("int"), F.lit(0))


def phrase_hits(text: Column, phrases) -> Column:
    """How many of the phrases occur in the text."""
    return reduce(lambda a, b: a + b, (text.contains(p).cast("int") for p in phrases))

"""Fields derived from a raw listing: id, brand, category, price, discount."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from .text import SPACE, group, strip

# --- fixed values -----------------------------------------------------------
PRODUCT_ID = r"(\d+p)\.html"
FIRST_PRICE = r"\$(\d+(?:\.\d{2})?)"
FIRST_PRICE_THOUSANDS = r"\$(\d[\d,]*(?:\.\d{2})?)"
SAVE = rf"Save{SPACE}+(\d+)%{SPACE}+\(\$?([\d,]+\.?\d*)\)"
PRICE_WAS = r"price was \$?([\d,]+\.?\d*)"
ENDS = rf"Ends{SPACE}+([^\n]+)"
# --- end of fixed values ----------------------------------------------------


def product_id(url: Column) -> Column:
    return group(url, PRODUCT_ID)


def brand(title: Column, brands=fixed.BRANDS, other: str = fixed.UNKNOWN_BRAND) -> Column:
    """The first brand in list order found in the title, whatever the case."""
    low = F.lower(title)
    return reduce(
        lambda rest, name: F.when(low.contains(name.lower()), F.lit(name)).otherwise(rest),
        reversed(brands),
        F.lit(other),
    )


def category(
    title: Column,
    buckets=fixed.CATEGORIES,
    other: str = fixed.OTHER_CATEGORY,
    untitled: str = fixed.UNTITLED_CATEGORY,
) -> Column:
    """The first bucket one of whose words is a substring of the title."""
    low = F.lower(title)

    def has_word(words) -> Column:
        return reduce(lambda a, b: a | b, (low.contains(word) for word in words))

    chain = reduce(
        lambda rest, bucket: F.when(has_word(bucket[1]), F.lit(bucket[0])).otherwise(rest),
        reversed(buckets),
        F.lit(other),
    )
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit(untitled)).otherwise(chain)


def _amount(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def clean_price(price: Column, thousands: bool = False) -> Column:
    """The first dollar amount on the first line.

    As shown on the page, ``$1,299.99`` reads as 1.0; ``thousands=True`` accepts commas.
    """
    first_line = strip(F.split_part(price, F.lit("\n"), F.lit(1)))
    pattern = FIRST_PRICE_THOUSANDS if thousands else FIRST_PRICE
    return _amount(group(first_line, pattern))


def discount_percentage(price: Column) -> Column:
    return group(price, SAVE, 1).try_cast("int")


def discount_amount(price: Column) -> Column:
    return _amount(group(price, SAVE, 2))


def original_price(price: Column) -> Column:
    return _amount(group(price, PRICE_WAS))


def discount_ends(price: Column) -> Column:
    return strip(group(price, ENDS))


def has_discount(price: Column) -> Column:
    found = F.regexp_like(price, F.lit(SAVE)) | F.regexp_like(price, F.lit(PRICE_WAS))
    return F.coalesce(found, F.lit(False))


def unreadable_discount(price: Column) -> Column:
    """True when an amount was announced but is not a number (commas only)."""
    saved, was = group(price, SAVE, 2), group(price, PRICE_WAS)
    return (saved.isNotNull() & _amount(saved).isNull()) | (
        was.isNotNull() & _amount(was).isNull()
    )


def discount(price: Column) -> Column:
    """The whole discount as a struct, NULL unless something marks a discount."""
    return F.when(
        has_discount(price),
        F.struct(
            discount_percentage(price).alias("discount_percentage"),
            discount_amount(price).alias("discount_amount"),
            original_price(price).alias("original_price"),
            discount_ends(price).alias("ends_date"),
            F.lit(True).alias("has_discount"),
        ),
    )

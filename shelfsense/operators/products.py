"""Product cleaning: derived columns, rejects, and the cleaned record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import product as p
from ..functions.text import strip_or_empty
from .joins import products_with_ratings

TEXT_FIELDS = ("title", "description", "sku", "detailed_title")


def reject_reason(df: DataFrame, strict_nulls: bool = False) -> Column:
    """Why a raw product cannot be cleaned, NULL when it can.

    ``strict_nulls`` also rejects a text field that is explicitly null. Where the reader
    recorded which fields those were (column ``null_fields``) only they count, otherwise
    any NULL does.
    """
    price = F.col("price")
    reason = F.when(p.product_id(F.col("product_url")).isNull(), F.lit("no_product_id")).when(
        p.unreadable_discount(price), F.lit("unreadable_discount")
    )
    if strict_nulls:
        for field in TEXT_FIELDS:
            if "null_fields" in df.columns:
                missing = F.coalesce(F.array_contains("null_fields", field), F.lit(False))
            elif field in df.columns:
                missing = F.col(field).isNull()
            else:
                continue
            reason = reason.when(missing, F.lit(f"null_{field}"))
    return reason


def with_reject_reason(products: DataFrame, strict_nulls: bool = False) -> DataFrame:
    return products.withColumn("reject_reason", reject_reason(products, strict_nulls))


def valid_products(products: DataFrame, strict_nulls: bool = False) -> DataFrame:
    marked = with_reject_reason(products, strict_nulls)
    return marked.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_products(products: DataFrame, strict_nulls: bool = False) -> DataFrame:
    return with_reject_reason(products, strict_nulls).filter(F.col("reject_reason").isNotNull())


def derive_product(products: DataFrame, thousands: bool = False) -> DataFrame:
    """The derived columns of the cleaned record, one narrow projection."""
    title, price = F.col("title"), F.col("price")
    text = {
        field: strip_or_empty(F.col(field))
        for field in TEXT_FIELDS
        if field in products.columns
    }
    return products.withColumns(
        {
            "product_id": p.product_id(F.col("product_url")),
            "brand": p.brand(title),
            "category": p.category(title),
            "raw_price": price,
            "discount": p.discount(price),
            "price": p.clean_price(price, thousands),
            **text,
        }
    )


def clean_products(
    products: DataFrame,
    ratings: DataFrame,
    run_ts: Column | None = None,
    strict_nulls: bool = False,
    thousands: bool = False,
) -> DataFrame:
    """Cleaned products: rejects removed, fields derived, ratings looked up."""
    stamp = F.current_timestamp() if run_ts is None else run_ts
    valid = valid_products(products, strict_nulls)
    rated = products_with_ratings(derive_product(valid, thousands), ratings)
    return rated.withColumns({"created_at": stamp, "updated_at": stamp}).drop("null_fields")


def flatten_discount(products: DataFrame) -> DataFrame:
    fields = ("discount_percentage", "discount_amount", "original_price", "ends_date",
              "has_discount")
    return products.withColumns({f: F.col(f"discount.{f}") for f in fields}).drop("discount")

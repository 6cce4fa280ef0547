"""Record types as explicit Spark schemas; readers never infer."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _I, _L, _B, _T = (
    StringType(), DoubleType(), IntegerType(), LongType(), BooleanType(), TimestampType(),
)

PRODUCT_LISTING = _struct(title=_S, product_url=_S, price=_S, search_url=_S)
PRODUCT_DETAILS = _struct(detailed_title=_S, detailed_price=_S, sku=_S, description=_S)
PRODUCT_RAW = StructType(PRODUCT_LISTING.fields + PRODUCT_DETAILS.fields)

DISCOUNT = _struct(
    discount_percentage=_I, discount_amount=_D, original_price=_D, ends_date=_S, has_discount=_B,
)
PRODUCT_CLEAN = _struct(
    product_id=_S, title=_S, brand=_S, category=_S, product_url=_S, price=_D, raw_price=_S,
    discount=DISCOUNT, average_rating=_D, total_reviews=_L, description=_S, sku=_S,
    search_url=_S, detailed_title=_S, detailed_price=_S, created_at=_T, updated_at=_T,
)

RATING_SUMMARY = _struct(average_rating=_D, total_reviews=_L, has_reviews=_B)
PRODUCT_RATING = _struct(
    product_title=_S, product_url=_S, average_rating=_D, total_reviews=_L,
    rating_distribution=MapType(_I, _L), extracted_at=_T, thread_id=_S,
)

REVIEW = _struct(
    review_id=_S, product_url=_S, rating=_I, title=_S, body=_S, date=_S, reviewer=_S,
    verified_purchaser=_B, helpful_count=_I,
)
NLP_COLUMNS = _struct(
    sentences=ArrayType(_S), words=ArrayType(_S), nlp_processed_at=_T, nlp_concatenated=_B,
    nlp_text_used=_S,
)
REVIEW_NLP = StructType(REVIEW.fields + NLP_COLUMNS.fields)
NLP_RESULT = _struct(review_id=_S, sentences_count=_I, words_count=_I, updated=_B)

VALENCE_SCORES = _struct(compound=_D, positive=_D, negative=_D, neutral=_D)
SENTIMENT = _struct(
    sentiment=_S, confidence_score=_D, combined_score=_D, vader_scores=VALENCE_SCORES,
    textblob_polarity=_D, method=_S,
)
REVIEW_SENTIMENT = StructType(
    REVIEW_NLP.fields
    + _struct(sentiment_analysis=SENTIMENT, sentiment_updated_at=_T).fields
)

PRICE = _struct(product_id=_S, timestamp=_T, current_price=_D)
HARVEST_RESULT = _struct(
    product_url=_S, product_title=_S, reviews=ArrayType(REVIEW), rating_summary=RATING_SUMMARY,
    success=_B, error=_S,
)
PAGE = _struct(page_id=_L, url=_S, html=_S)

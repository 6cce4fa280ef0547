"""Pieces of checking SQL."""

from ..functions.text import SPACE, WHITESPACE


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def rn(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,9)), {digits}) AS DOUBLE)"


def avg(x: str, digits: int = 6) -> str:
    return rn(
        f"(CAST(sum(CAST({x} AS DECIMAL(28,9))) AS DOUBLE) / nullif(count({x}), 0))", digits
    )


def pct(part: str, whole: str) -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100"
        " ELSE 0.0 END"
    )


def iso(ts: str) -> str:
    return (
        f"CASE WHEN microsecond({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S')"
        f" ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def group(x: str, pattern: str, i: int = 1) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {i}), '')"


PRODUCT_ID = group("product_url", r"(\d+p)\.html")
BRAND = """CASE WHEN lower(title) LIKE '%supercycle%' THEN 'Supercycle'
  WHEN lower(title) LIKE '%raleigh%' THEN 'Raleigh' WHEN lower(title) LIKE '%stratus%' THEN 'Stratus'
  WHEN lower(title) LIKE '%marvel%' THEN 'Marvel' WHEN lower(title) LIKE '%hot wheels%' THEN 'Hot Wheels'
  ELSE 'Unknown' END"""
CATEGORY = """CASE WHEN coalesce(title, '') = '' THEN 'general'
  WHEN regexp_matches(lower(title), 'kids''|children|youth') THEN 'kids_bikes'
  WHEN regexp_matches(lower(title), 'mountain|dual-suspension|hardtail') THEN 'mountain_bikes'
  WHEN regexp_matches(lower(title), 'comfort|cruiser|women''s') THEN 'comfort_bikes'
  WHEN regexp_matches(lower(title), 'road|hybrid') THEN 'road_bikes' ELSE 'bikes' END"""
PRICE = (
    f"TRY_CAST(regexp_extract({strip('split_part(price, chr(10), 1)')}, "
    r"'\$(\d+(?:\.\d{2})?)', 1) AS DOUBLE)"
)
_SAVE = rf"Save{SPACE}+(\d+)%{SPACE}+\(\$?([\d,]+\.?\d*)\)"
_WAS = r"price was \$?([\d,]+\.?\d*)"
DISCOUNT_PCT = f"TRY_CAST({group('price', _SAVE, 1)} AS INTEGER)"
DISCOUNT_AMOUNT = f"TRY_CAST(replace({group('price', _SAVE, 2)}, ',', '') AS DOUBLE)"
ORIGINAL_PRICE = f"TRY_CAST(replace({group('price', _WAS)}, ',', '') AS DOUBLE)"
ENDS = strip(group("price", rf"Ends{SPACE}+([^\n]+)"))
HAS_DISCOUNT = (
    f"coalesce(regexp_matches(price, '{_SAVE}') OR regexp_matches(price, '{_WAS}'), false)"
)

# Cleaned products: one row per raw product with an id.
CLEANED = f"""cleaned AS (
  SELECT k, {PRODUCT_ID} AS product_id, {strip("coalesce(title, '')")} AS title, {BRAND} AS brand,
    {CATEGORY} AS category, product_url, {PRICE} AS price, price AS raw_price,
    CASE WHEN {HAS_DISCOUNT} THEN {DISCOUNT_PCT} END AS discount_percentage,
    CASE WHEN {HAS_DISCOUNT} THEN {DISCOUNT_AMOUNT} END AS discount_amount,
    CASE WHEN {HAS_DISCOUNT} THEN {ORIGINAL_PRICE} END AS original_price,
    CASE WHEN {HAS_DISCOUNT} THEN {ENDS} END AS ends_date,
    CASE WHEN {HAS_DISCOUNT} THEN true END AS has_discount,
    {strip("coalesce(description, '')")} AS description, {strip("coalesce(sku, '')")} AS sku,
    search_url, {strip("coalesce(detailed_title, '')")} AS detailed_title, detailed_price
  FROM raw_products WHERE {PRODUCT_ID} IS NOT NULL)"""

# One product per URL, the one with the lowest key.
BY_URL = f"""by_url AS (
  SELECT product_url, {BRAND} AS brand, {CATEGORY} AS category, k, title, {PRODUCT_ID} AS product_id
  FROM products_raw QUALIFY row_number() OVER (PARTITION BY product_url ORDER BY k) = 1)"""

"""Extraction from stored HTML.

The checking SQL of the derived pages states what went into them, so it does not share
any pattern with the engine; the given pages are checked with plain expressions.
"""

from pyspark.sql import functions as F

from ..functions import product
from ..functions import rating as r
from ..functions.html import INVISIBLE
from ..operators import extract
from . import sqlkit as q
from .. import fixed_values as fixed
from .registry import Tables, query

URL = "product_url"
PAGES_SHOWN = 3  # the limit that ``paginate_union`` is about
# The references that the given pages hold; the last comes last, so that "&amp;lt;" stays "&lt;".
ENTITIES = (
    ("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'),
    ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)
_VISIBLE = f"regexp_replace(html, '{INVISIBLE}', '', 'g')"


def _decode(x: str) -> str:
    for name, char in ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


# --- listing cards ----------------------------------------------------------
@query(
    "cards_first_selector",
    rf"""SELECT page_id, row_number() OVER (PARTITION BY page_id) AS position, length(card) AS card_chars,
    card LIKE '%<h1>%' AS headed FROM (SELECT page_id,
      unnest(regexp_extract_all({_VISIBLE}, '(?is)<article(?:\s[^>]*)?>(.*?)</article\s*>', 1)) AS card FROM pages)""",
)
def cards_first_selector(t: Tables):
    rows = extract.card_rows(t.pages, "page_id")
    return rows.select(
        "page_id", F.col("position").cast("bigint").alias("position"),
        F.length("card").cast("bigint").alias("card_chars"),
        F.col("card").contains("<h1>").alias("headed"),
    )


@query(
    "cards_by_selector",
    """SELECT k, CAST(CASE k % 6 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END
    AS INTEGER) AS cards FROM products_raw""",
)
def cards_by_selector(t: Tables):
    return extract.with_cards(t.listing_pages).select("k", F.size("cards").alias("cards"))


def _cards(t: Tables):
    return extract.card_fields(t.product_cards.withColumnRenamed("html", "card"))


_CARD = f"""card AS (SELECT k, search_url, CASE WHEN k % 5 <> 0 THEN {q.strip('title')} END AS title,
  CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN '/help' ELSE product_url END AS product_url, {q.strip('price')} AS price
  FROM products_raw)"""


@query("card_title", f"WITH {_CARD} SELECT k, title FROM card")
def card_title(t: Tables):
    return _cards(t).select("k", "title")


@query("card_link", f"WITH {_CARD} SELECT k, product_url FROM card")
def card_link(t: Tables):
    return _cards(t).select("k", URL)


@query("card_price", f"WITH {_CARD} SELECT k, price FROM card")
def card_price(t: Tables):
    return _cards(t).select("k", "price")


@query(
    "card_gate",
    f"""WITH {_CARD} SELECT k, title, product_url, price, search_url FROM card
    WHERE coalesce(title, '') <> '' AND coalesce(product_url, '') <> ''""",
)
def card_gate(t: Tables):
    return extract.card_gate(_cards(t)).select("k", "title", URL, "price", "search_url")


_T, _P = q.strip("title"), q.strip("coalesce(price, '')")
_KEY = "CAST(k AS VARCHAR)"
_PAGE = f"'https://shop.example.com/en/list/' || {_KEY} || '.html'"
LISTING = f"""listing AS (
  SELECT k, CAST(1 AS INTEGER) AS position, {_T} AS title,
    CASE WHEN k % 6 = 4 THEN {_PAGE} || '?q=product' ELSE product_url END AS product_url,
    CASE WHEN k % 6 IN (0, 2) THEN {_P} END AS price, {_PAGE} AS search_url FROM products_raw WHERE k % 6 <> 5
  UNION ALL SELECT k, 2, {q.strip("'Second & ' || title")}, 'https://shop.example.com/en/list/help/more.html', NULL, {_PAGE}
    FROM products_raw WHERE k % 6 = 0
  UNION ALL SELECT k, 2, 'Second', 'https://shop.example.com/en/pdp/other-' || {_KEY} || 'p.html', NULL, {_PAGE}
    FROM products_raw WHERE k % 6 = 1)"""


@query("card_listing", f"WITH {LISTING} SELECT k, position, title, product_url, price, search_url FROM listing")
def card_listing(t: Tables):
    return extract.product_listing(t.listing_pages, "k")


@query("pages_without_cards", f"SELECT k, {_PAGE} AS url FROM products_raw WHERE k % 6 = 5")
def pages_without_cards(t: Tables):
    return extract.pages_without_cards(t.listing_pages).select("k", "url")


# --- blocks in blocks, cards in cards ----------------------------------------
_SHOP = "'https://shop.example.com"
_NESTED = f"""card AS (
  SELECT k, CAST(1 AS INTEGER) AS position, 'Kit ' || {_KEY} || ' caf' || chr(233) || chr(174) AS title,
    {_SHOP}/en/pdp/kit-' || {_KEY} || 'p.html' AS product_url, 100 + k % 900 + 0.5 AS amount,
    k % 3 = 0 AS discounted, CASE k % 3 WHEN 0 THEN 'August 07, 2025' WHEN 1 THEN 'May' || chr(160) || '1' END AS ends
  FROM products_raw
  UNION ALL SELECT k, 2, 'Part ' || chr(8217) || {_KEY} || chr(8217) || ' &lt; ' || chr(8217) || chr(128690),
    {_SHOP}/en/pdp/part-' || {_KEY} || 'p.html', NULL, false, NULL FROM products_raw
  UNION ALL SELECT k, 3, 'Spare' || chr(10) || {_KEY}, {_SHOP}/help', NULL, false, NULL FROM products_raw)"""


@query("nested_cards", f"WITH {_NESTED} SELECT k, position, title, product_url FROM card")
def nested_cards(t: Tables):
    return extract.product_listing(t.nested_pages, "k").select("k", "position", "title", URL)


@query(
    "listing_discounts",
    f"""WITH {_NESTED} SELECT k, position, CAST(amount AS DOUBLE) AS price,
      CASE WHEN discounted THEN CAST(1 + k % 60 AS INTEGER) END AS discount_percentage,
      CASE WHEN discounted THEN CAST(1 + k % 40 + 0.25 AS DOUBLE) END AS discount_amount,
      CASE WHEN discounted THEN CAST(1000 + k % 1000 + 0.99 AS DOUBLE) END AS original_price,
      ends AS ends_date FROM card""",
)
def listing_discounts(t: Tables):
    """From stored pages to the discount columns, through a price block of several lines.

    A card's own price comes first, so the outer card does not take the price of the inner one.
    """
    price = F.col("price")
    return extract.product_listing(t.nested_pages, "k").select(
        "k", "position", product.clean_price(price).alias("price"),
        product.discount_percentage(price).alias("discount_percentage"),
        product.discount_amount(price).alias("discount_amount"),
        product.original_price(price).alias("original_price"),
        product.discount_ends(price).alias("ends_date"),
    )


# --- product details --------------------------------------------------------
@query(
    "product_details",
    rf"""SELECT page_id, {q.strip(_decode("regexp_replace(split_part(split_part(" + _VISIBLE
        + ", '<h1>', 2), '</h1>', 1), '<[^>]*>', '', 'g')"))} AS detailed_title,
    CAST(NULL AS VARCHAR) AS detailed_price, CAST(NULL AS VARCHAR) AS sku, CAST(NULL AS VARCHAR) AS description
    FROM pages""",
)
def product_details(t: Tables):
    return extract.product_details(t.pages, "page_id")


@query(
    "product_details_pages",
    f"""SELECT k AS page_id, {q.strip('title')} AS detailed_title, detailed_price, sku,
    {q.strip("coalesce(description, '')")} AS description FROM raw_products""",
)
def product_details_pages(t: Tables):
    return extract.product_details(t.detail_pages, "page_id")


# --- rating widget ----------------------------------------------------------
_COUNT = r"TRY_CAST(nullif(regexp_extract(count_text, '\((\d+)\)', 1), '') AS BIGINT)"


def _rating(column: str) -> str:
    number = rf"TRY_CAST(regexp_extract({column}, '^\s*([+-]?(?:\d+\.?\d*|\.\d+))', 1) AS DOUBLE)"
    return f"CASE WHEN {number} BETWEEN 0 AND 5 THEN {number} END"


_AVERAGE = (
    f"CASE WHEN coalesce({_rating('rating_text')}, 0) = 0 THEN "
    f"coalesce({_rating('alt_rating_text')}, {_rating('rating_text')}) ELSE {_rating('rating_text')} END"
)


@query("review_count", f"SELECT k, {_COUNT} AS total_reviews FROM rating_widgets")
def review_count(t: Tables):
    return t.rating_widgets.select("k", r.review_count(F.col("count_text")).alias("total_reviews"))


@query("avg_rating", f"SELECT k, {_rating('rating_text')} AS average_rating FROM rating_widgets")
def avg_rating(t: Tables):
    return t.rating_widgets.select("k", r.parse_rating(F.col("rating_text")).alias("average_rating"))


@query("avg_rating_fallback", f"SELECT k, {_AVERAGE} AS average_rating FROM rating_widgets")
def avg_rating_fallback(t: Tables):
    value = r.rating_with_fallback(F.col("rating_text"), F.col("alt_rating_text"))
    return t.rating_widgets.select("k", value.alias("average_rating"))


@query(
    "rating_summary",
    f"""SELECT k, product_url, CASE WHEN has THEN n END AS total_reviews, CASE WHEN has THEN a END AS average_rating,
    has AS has_reviews FROM (SELECT *, coalesce(n, 0) <> 0 OR coalesce(a, 0) <> 0 AS has
      FROM (SELECT k, product_url, {_COUNT} AS n, {_AVERAGE} AS a FROM rating_widgets))""",
)
def rating_summary(t: Tables):
    widgets = t.rating_widgets.select(
        "k",
        URL,
        r.review_count(F.col("count_text")).alias("total_reviews"),
        r.rating_with_fallback(F.col("rating_text"), F.col("alt_rating_text")).alias(
            "average_rating"
        ),
    )
    return extract.rating_summary(widgets)


_WIDGET = """widget AS (SELECT seq, product_url,
  CASE WHEN seq % 5 IN (0, 1, 3) THEN 'widget' WHEN seq % 5 = 2 THEN 'button' END AS opened_by,
  CAST(CASE seq % 5 WHEN 0 THEN seq % 90 WHEN 1 THEN seq % 9 WHEN 2 THEN 33 END AS BIGINT) AS total_reviews,
  CAST(CASE seq % 5 WHEN 0 THEN 4.1 WHEN 1 THEN 3.5 WHEN 3 THEN 2.5 END AS DOUBLE) AS average_rating
  FROM reviews_raw)"""


@query("rating_widget_pages", f"WITH {_WIDGET} SELECT seq, opened_by, total_reviews, average_rating FROM widget")
def rating_widget_pages(t: Tables):
    return extract.rating_widget(t.review_pages, "seq")


@query(
    "review_count_text_fallback",
    f"WITH {_WIDGET} SELECT seq, total_reviews FROM widget WHERE opened_by = 'button'",
)
def review_count_text_fallback(t: Tables):
    found = extract.rating_widget(t.review_pages, "seq")
    return found.filter(F.col("opened_by") == "button").select("seq", "total_reviews")


# --- review pages -----------------------------------------------------------
@query(
    "review_view_kind",
    """SELECT seq, CASE seq % 7 WHEN 0 THEN 'already_expanded' WHEN 1 THEN 'expanded_accordion'
    WHEN 2 THEN 'no_container_found' WHEN 3 THEN 'no_container_found' ELSE 'desktop_view' END AS view_kind
    FROM reviews_raw""",
)
def review_view_kind(t: Tables):
    return t.review_pages.select("seq", extract.review_view_kind(F.col("html")).alias("view_kind"))


_PHRASES = " + ".join(
    f"CAST(contains(page_text, '{p}') AS INTEGER)" for p in fixed.REVIEW_PHRASES
)


@query(
    "reviews_present",
    f"""SELECT seq, seq % 7 NOT IN (2, 3) AS in_container, seq % 7 = 0 AS open_panel, seq % 7 = 3 AS many_elements,
    {_PHRASES} >= 2 AS phrases, seq % 7 <> 2 OR {_PHRASES} >= 2 AS reviews_present
    FROM (SELECT seq, lower(regexp_replace({_VISIBLE}, '<[^>]*>', ' ', 'g')) AS page_text FROM review_pages)""",
)
def reviews_present(t: Tables):
    return extract.reviews_present(t.review_pages, "seq")


@query(
    "review_sections",
    """SELECT seq, CAST(1 AS INTEGER) AS position, html AS section FROM review_sections WHERE seq % 7 NOT IN (2, 3)
    UNION ALL SELECT seq, 2, '<section id="' || review_id || '-b"><h3>Reply</h3></section>' FROM review_sections
    WHERE seq % 7 NOT IN (2, 3)""",
)
def review_sections(t: Tables):
    return extract.review_sections(t.review_pages, "seq")


EXTRACTED = f"""extracted AS (
  SELECT seq, page_no, CAST(1 AS INTEGER) AS position, review_id, product_url,
    rating, {q.strip("replace(title, chr(10), ' ')")} AS title, {q.strip('body')} AS body, date, reviewer,
    verified_purchaser, helpful_count FROM reviews_raw WHERE seq % 7 NOT IN (2, 3)
  UNION ALL SELECT seq, page_no, 2, review_id || '-b', product_url, NULL, 'Reply', NULL,
    NULL, NULL, false, 0 FROM reviews_raw WHERE seq % 7 NOT IN (2, 3))"""


@query(
    "review_fields",
    f"""SELECT seq, review_id, rating, {q.strip("replace(title, chr(10), ' ')")} AS title, reviewer AS author, date,
    {q.strip('body')} AS content, verified_purchaser AS verified, helpful_count AS helpful FROM reviews_raw""",
)
def review_fields(t: Tables):
    sections = t.review_sections.select("seq", F.col("html").alias("section"))
    return extract.review_fields(sections)


@query(
    "review_format",
    f"""WITH {EXTRACTED} SELECT seq, position, review_id, product_url, rating, title, body, date, reviewer,
    verified_purchaser, helpful_count FROM extracted""",
)
def review_format(t: Tables):
    return extract.extract_reviews(t.review_pages, "seq")


@query(
    "review_position",
    f"WITH {EXTRACTED} SELECT seq, review_id, position FROM extracted",
)
def review_position(t: Tables):
    return extract.extract_reviews(t.review_pages, "seq").select("seq", "review_id", "position")


@query(
    "paginate_union",
    f"""WITH {EXTRACTED} SELECT product_url, page_no, position, review_id, body FROM extracted
    WHERE page_no <= {PAGES_SHOWN}""",
)
def paginate_union(t: Tables):
    pages = extract.paginate_union(t.review_pages, PAGES_SHOWN)
    return extract.extract_reviews(pages, "page_no").select(
        URL, "page_no", "position", "review_id", "body"
    )


@query("has_next_page", "SELECT seq, seq % 4 IN (0, 1) AS has_next FROM reviews_raw")
def has_next_page(t: Tables):
    return t.review_pages.select("seq", extract.has_next_page(F.col("html")).alias("has_next"))


@query(
    "pagination_text",
    "SELECT seq, CASE WHEN seq % 4 = 0 THEN '1 to 8' END AS pagination FROM reviews_raw",
)
def pagination_text(t: Tables):
    return extract.pagination_text(t.review_pages, "seq")

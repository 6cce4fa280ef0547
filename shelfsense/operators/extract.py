"""Records out of stored HTML: listing cards, product details, ratings, reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import rating as r
from ..functions.html import (
    after,
    attribute,
    balanced_inner,
    bind,
    computed,
    elements,
    first_inner,
    inner_text,
    needed_words,
    opener,
    opening_tag,
    rendered_text,
    tag_name,
    visible,
    with_texts,
)
from ..functions.text import non_empty
from ..functions.url import resolve_url

BUTTON = r"(?is)<button(?:\s[^>]*)?>(.*?)</button\s*>"
SECTION = "section[id^='bv-review-']"
ID_BV = r"[\s\"']id=(?:\"[^\"]*BV[^\"]*\"|'[^']*BV[^']*')"
LINK_OR_BUTTON = r"(?is)<(?:a|button)(?:\s[^>]*)?>.*?</(?:a|button)\s*>"


def _visible_pages(pages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    source = pages.select(*dict.fromkeys([*keep, "html"]))
    seen = computed(source, {"_html": visible(F.col("html"))})
    return seen if "html" in keep else seen.drop("html")


# --- listing pages ----------------------------------------------------------
def cards(html: Column, selectors=fixed.CARD_SELECTORS) -> Column:
    """Inner HTML of all cards: those of the first selector that matches anything."""

    def present(selector: str) -> Column:
        words = needed_words(selector) or [f"<{selector}"]
        named = reduce(lambda a, b: a & b, (html.contains(word) for word in words))
        return named & F.regexp_like(html, F.lit(opening_tag(selector)))

    chosen = F.array().cast("array<string>")
    for selector in reversed(selectors):
        chosen = F.when(present(selector), elements(html, selector)).otherwise(chosen)
    return chosen


def with_cards(pages: DataFrame, selectors=fixed.CARD_SELECTORS) -> DataFrame:
    seen = computed(pages, {"_html": visible(F.col("html"))})
    return computed(seen, {"cards": cards(F.col("_html"), selectors)}).drop("_html")


def card_rows(pages: DataFrame, *keep: str, selectors=fixed.CARD_SELECTORS) -> DataFrame:
    """One row per card, numbered from 1 within its page."""
    return (
        with_cards(pages, selectors)
        .select(*keep, F.posexplode("cards").alias("position", "card"))
        .withColumn("position", F.col("position") + 1)
    )


def pages_without_cards(pages: DataFrame, selectors=fixed.CARD_SELECTORS) -> DataFrame:
    return with_cards(pages, selectors).filter(F.size("cards") == 0).drop("cards")


def card_link(card: Column, base: Column | None = None, selectors=fixed.LINK_SELECTORS) -> Column:
    """The first product link, otherwise the first link of any kind."""
    tags = F.filter(F.array(*[opener(card, s) for s in selectors]), lambda tag: tag != "")
    link = bind(F.get(tags, 0), lambda tag: attribute(tag, "href"))
    return link if base is None else bind(link, lambda href: resolve_url(href, base))


def card_fields(card_table: DataFrame, card: str = "card", base: str | None = None) -> DataFrame:
    texts = with_texts(
        card_table, card, {"title": fixed.TITLE_SELECTORS, "price": fixed.PRICE_SELECTORS}, rendered_text
    )
    link = card_link(F.col(card), F.col(base) if base else None)
    return computed(texts, {"product_url": link})


def card_gate(fields: DataFrame) -> DataFrame:
    """Cards that carry both a title and a link."""
    return fields.filter(
        (F.coalesce(F.col("title"), F.lit("")) != "")
        & (F.coalesce(F.col("product_url"), F.lit("")) != "")
    )


def product_listing(pages: DataFrame, *keep: str, resolve: bool = True) -> DataFrame:
    """Listing records of all pages, the page's address as search_url."""
    rows = card_rows(pages, "url", *keep)
    fields = card_fields(rows, base="url" if resolve else None)
    return card_gate(fields).select(
        *keep, "position", "title", "product_url", "price", F.col("url").alias("search_url")
    )


# --- detail pages -----------------------------------------------------------
def product_details(pages: DataFrame, *keep: str) -> DataFrame:
    source = _visible_pages(pages, keep)
    fields = {
        "detailed_title": ("h1",),
        "detailed_price": fixed.PRICE_SELECTORS,
        "sku": fixed.SKU_SELECTORS,
        "description": fixed.DESCRIPTION_SELECTORS,
    }
    return with_texts(source, "_html", fields, rendered_text).select(*keep, *fields)


# --- rating widget ----------------------------------------------------------
def _inside_button(html: Column, tag: Column) -> Column:
    before = F.substr(html, F.lit(1), F.instr(html, tag) - 1)
    since = F.substring_index(before, "</button>", -1)
    return (tag_name(tag) == "button") | F.regexp_like(since, F.lit(r"(?i)<button[\s>]"))


def _star_button_text(html: Column) -> Column:
    """Text of the first button that shows a bracketed number and the word star."""
    texts = F.transform(
        F.regexp_extract_all(html, F.lit(BUTTON), F.lit(1)),
        lambda inner: F.regexp_replace(inner, "<[^>]*>", ""),
    )
    return F.get(
        F.filter(texts, lambda t: F.regexp_like(t, F.lit(r.COUNT)) & t.contains("star")), 0
    )


def rating_widget(pages: DataFrame, *keep: str) -> DataFrame:
    """total_reviews, average_rating and where they were found (``opened_by``)."""
    html = F.col("_html")
    tags = {
        "_count": fixed.COUNT_SELECTOR,
        "_rating": fixed.RATING_SELECTOR,
        **{f"_alt{i}": s for i, s in enumerate(fixed.ALT_RATING_SELECTORS)},
    }

    def text(name: str) -> Column:
        return F.when(F.col(name) != "", inner_text(first_inner(html, F.col(name))))

    def alternative(i: int) -> Column:
        tag = F.col(f"_alt{i}")
        return F.coalesce(non_empty(text(f"_alt{i}")), attribute(non_empty(tag), "data-rating"))

    found = (
        computed(
            _visible_pages(pages, keep), {name: opener(html, s) for name, s in tags.items()}
        )
        .withColumns(
            {
                "count_text": text("_count"),
                "rating_text": text("_rating"),
                "_in_button": (F.col("_count") != "") & _inside_button(html, F.col("_count")),
                "alternatives": F.array(
                    *[alternative(i) for i in range(len(fixed.ALT_RATING_SELECTORS))]
                ),
            }
        )
        .withColumn(
            "_widget",
            F.coalesce(
                F.col("_in_button") & F.col("count_text").contains("("), F.lit(False)
            ),
        )
        .withColumn("star_text", F.when(~F.col("_widget"), _star_button_text(html)))
    )
    found = computed(
        found.drop("_html", *tags),
        {
            "opened_by": F.when(F.col("_widget"), F.lit("widget")).when(
                F.col("star_text").isNotNull(), F.lit("button")
            )
        },
    )
    rating = F.col("rating_text")
    alternatives = [
        F.get("alternatives", i) for i in range(len(fixed.ALT_RATING_SELECTORS))
    ]
    opened = F.col("opened_by")
    numbers = {
        "total_reviews": F.when(opened == "widget", r.review_count(F.col("count_text"))).otherwise(
            r.review_count(F.col("star_text"))
        ),
        "average_rating": F.when(
            opened == "widget", r.rating_with_fallback(rating, *alternatives)
        ).when(opened == "button", r.parse_rating(rating)),
    }
    return found.select(
        *keep, "opened_by", *[value.alias(name) for name, value in numbers.items()]
    )


def rating_summary(widgets: DataFrame) -> DataFrame:
    """Add has_reviews; without reviews the two numbers are NULL."""
    has = r.has_reviews(F.col("total_reviews"), F.col("average_rating"))
    return widgets.withColumns(
        {
            "average_rating": F.when(has, F.col("average_rating")),
            "total_reviews": F.when(has, F.col("total_reviews")),
            "has_reviews": has,
        }
    )


# --- review pages -----------------------------------------------------------
def container(html: Column, element_id: str) -> Column:
    """Inner HTML of the element with that id, NULL when there is none."""
    return bind(
        opener(html, f"#{element_id}"),
        lambda tag: F.when(tag != "", balanced_inner(after(html, tag), tag_name(tag))),
    )


def review_view_kind(page: Column) -> Column:
    """How the page shows its reviews; comments and scripts do not count."""
    return bind(visible(page), _view_kind)


def _view_kind(html: Column) -> Column:
    button = opener(container(html, "BVRRContainer-mobile"), ".nl-accordion__button")
    return (
        F.when(
            F.coalesce(button, F.lit("")) != "",
            F.when(attribute(button, "aria-expanded") == "true", F.lit("already_expanded"))
            .otherwise(F.lit("expanded_accordion")),
        )
        .when(opener(html, "#BVRRContainer") != "", F.lit("desktop_view"))
        .otherwise(F.lit("no_container_found"))
    )


def _all_tags(html: Column, selector: str) -> Column:
    return F.regexp_extract_all(html, F.lit(opening_tag(selector)), F.lit(0))


def review_signals(html: Column, phrases=fixed.REVIEW_PHRASES) -> dict[str, Column]:
    """The four independent signs that reviews are on the page."""
    hidden = "nl-accordion__panel--hidden"
    panels = _all_tags(
        F.coalesce(container(html, "BVRRContainer-mobile"), F.lit("")), ".nl-accordion__panel"
    )
    by_class = F.filter(
        _all_tags(html, "[class*='bv-']"), lambda t: ~F.regexp_like(t, F.lit(ID_BV))
    )
    marked = F.filter(
        F.concat(by_class, _all_tags(html, "[id*='BV']")),
        lambda t: F.lower(
            F.concat_ws(" ", attribute(t, "class"), attribute(t, "id"))
        ).contains("review"),
    )
    text = F.lower(F.regexp_replace(html, "<[^>]*>", " "))
    return {
        "in_container": F.coalesce(
            F.regexp_like(
                container(html, "reviews_container"),
                F.lit(opening_tag(SECTION)),
            ),
            F.lit(False),
        ),
        "open_panel": F.exists(panels, lambda t: ~t.contains(hidden)),
        "many_elements": F.size(marked) >= fixed.MIN_REVIEW_ELEMENTS,
        "phrases": r.phrase_hits(text, phrases) >= fixed.MIN_REVIEW_PHRASES,
    }


def reviews_present(pages: DataFrame, *keep: str) -> DataFrame:
    signals = review_signals(F.col("_html"))
    return (
        computed(_visible_pages(pages, keep), signals)
        .select(
            *keep,
            *signals,
            reduce(lambda a, b: a | b, (F.col(s) for s in signals)).alias("reviews_present"),
        )
    )


def review_sections(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per review section inside the container, numbered from 1."""
    return (
        computed(
            _visible_pages(pages, keep),
            {"_inside": container(F.col("_html"), "reviews_container")},
        )
        .select(
            *keep,
            F.posexplode(elements(F.col("_inside"), SECTION, outer=True)).alias(
                "position", "section"
            ),
        )
        .withColumn("position", F.col("position") + 1)
    )


def review_fields(sections: DataFrame, section: str = "section") -> DataFrame:
    """The fields of a review section, under the names used on the page."""
    html = F.col(section)
    texts = with_texts(
        sections,
        section,
        {
            "title": ("h3",),
            "author": ("button[aria-label*='See'][aria-label*='profile']",),
            "date": (fixed.DATE_SELECTOR,),
            "content": (fixed.BODY_SELECTOR,),
        },
    )
    stars = opener(html, "[role='img'][aria-label*='out of 5 stars']")
    helpful = opener(html, "button[aria-label*='people found this review']")
    return texts.withColumns(
        {
            "review_id": attribute(opener(html, SECTION), "id"),
            "rating": r.stars(attribute(stars, "aria-label")),
            "verified": opener(html, "[title*='purchased the product']") != "",
            "helpful": r.helpful_count(attribute(helpful, "aria-label")),
        }
    ).drop(section)


def review_format(fields: DataFrame, *keep: str) -> DataFrame:
    """Stored review records; product_url is the address that was asked for."""
    return fields.select(
        *keep,
        "review_id",
        "product_url",
        "rating",
        "title",
        F.col("content").alias("body"),
        "date",
        F.col("author").alias("reviewer"),
        F.col("verified").alias("verified_purchaser"),
        F.col("helpful").alias("helpful_count"),
    )


def extract_reviews(pages: DataFrame, *keep: str) -> DataFrame:
    """Pages to review records in one narrow pass."""
    sections = review_sections(pages, "product_url", *keep)
    return review_format(review_fields(sections), *keep, "position")


def paginate_union(
    pages: DataFrame, max_pages: int | None = None, page_no: str = "page_no"
) -> DataFrame:
    """The review pages of every product; with ``max_pages`` the first ones only."""
    if max_pages is None:
        return pages
    return pages.filter(F.col(page_no) <= max_pages)


def has_next_page(page: Column) -> Column:
    """Whether a link or button leads on; comments and scripts do not count."""
    return bind(visible(page), _leads_on)


def _leads_on(html: Column) -> Column:
    direct = attribute(non_empty(opener(html, "a.next[role='button']")), "href")

    def leads_on(element: Column) -> Column:
        tag = F.regexp_extract(element, "^<[^>]*>", 0)
        text = F.lower(F.regexp_replace(element, "<[^>]*>", ""))
        usable = ~F.regexp_like(tag, F.lit(r"(?i)^<button[^>]*\sdisabled[\s=>/]")) & ~F.regexp_like(
            tag, F.lit(r"(?i)\sstyle=[\"'][^\"']*display:\s*none")
        )
        return text.contains("next") & text.contains("review") & usable

    others = F.exists(F.regexp_extract_all(html, F.lit(LINK_OR_BUTTON), F.lit(0)), leads_on)
    return (F.coalesce(direct, F.lit("")) != "") | others


def pagination_text(pages: DataFrame, *keep: str) -> DataFrame:
    source = _visible_pages(pages, keep)
    texts = with_texts(source, "_html", {"pagination": (fixed.PAGINATION_SELECTOR,)})
    return texts.select(*keep, non_empty(F.col("pagination")).alias("pagination"))

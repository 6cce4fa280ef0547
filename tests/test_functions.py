"""Literal rows for the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfsense.functions import html, product, rating, sentiment, text, tokens, url


def values(spark, inputs, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v")).alias("x")).collect()]


def test_product_id(spark):
    urls = ["https://x/en/pdp/x-26-in-black-0710110p.html?rq=q", None, "", "https://x/clearance.html"]
    assert values(spark, urls, product.product_id) == ["0710110p", None, None, None]


def test_brand(spark):
    titles = ["marvel stratus kids", "HOT WHEELS car", "", None, "other"]
    assert values(spark, titles, product.brand) == [
        "Stratus", "Hot Wheels", "Unknown", "Unknown", "Unknown",
    ]


def test_price(spark):
    prices = ["$159.99", "$159", "$1,299.99", "159.99", "\n$5.00", None, " $7.5\n$9.00"]
    assert values(spark, prices, product.clean_price) == [
        159.99, 159.0, 1.0, None, None, None, 7.0,
    ]
    assert values(spark, ["$1,299.99"], lambda c: product.clean_price(c, True)) == [1299.99]


def test_category(spark):
    titles = ["Kids' Mountain Bike", "Broadside", "Trike", "", None, "Women's road", "HARDTAIL"]
    assert values(spark, titles, product.category) == [
        "kids_bikes", "road_bikes", "bikes", "general", "general", "comfort_bikes",
        "mountain_bikes",
    ]


def test_discount(spark):
    full = "$450.00\nSave 17% ($90.00)\nprice was $1,529.99\nEnds August 07, 2025 "
    found, ends_only, odd_space, none = values(
        spark,
        [full, "$5.00\nEnds May 1", "Save\xa05% ($1,000)", None],
        product.discount,
    )
    assert found.asDict() == {
        "discount_percentage": 17, "discount_amount": 90.0, "original_price": 1529.99,
        "ends_date": "August 07, 2025", "has_discount": True,
    }
    assert ends_only is None and none is None
    assert odd_space.discount_percentage == 5 and odd_space.discount_amount == 1000.0
    assert values(spark, ["$5.00\nEnds May 1"], product.discount_ends) == ["May 1"]


def test_unreadable_discount(spark):
    prices = ["price was ,", "Save 5% (,)", "price was $5", None]
    assert values(spark, prices, lambda c: F.coalesce(product.unreadable_discount(c), F.lit(False))) == [
        True, True, False, False,
    ]


def test_strip_removes_what_python_removes(spark):
    texts = [" \t a b \n", " x　", "\x1c\x85y\xa0", "", "  "]
    assert values(spark, texts, text.strip) == [t.strip() for t in texts]


def test_single_blanks(spark):
    texts = ["a\tb c　d\xa0e\x1ff g"]
    assert values(spark, texts, text.single_blanks) == ["a b c d e f g"]


def test_round_clamp_preview(spark):
    assert values(spark, [2.675, -0.9994999999999999, None], lambda c: text.round_n(c, 2), "double") == [
        2.68, -1.0, None,
    ]
    assert values(spark, [-1.0, 0.5, 2.0, None], lambda c: text.clamp(c, 0.0, 1.0), "double") == [
        0.0, 0.5, 1.0, None,
    ]
    assert values(spark, ["abcdef", "abc"], lambda c: text.preview(c, 3)) == ["abc...", "abc"]


def test_iso_format(spark):
    moments = [datetime.datetime(2025, 8, 5, 23, 35, 19), datetime.datetime(2025, 8, 5, 0, 0, 0, 12)]
    assert values(spark, moments, text.iso_format, "timestamp_ntz") == [m.isoformat() for m in moments]


def test_rating_numbers(spark):
    assert values(spark, ["4.1 out of 5", "7.5", "n/a", " .5x", "-1", "0"], rating.parse_rating) == [
        4.1, None, None, 0.5, None, 0.0,
    ]
    assert values(spark, ["(12) x (3)", "( 4 )", None], rating.review_count) == [12, None, None]
    assert values(spark, ["0", "3", None], lambda c: rating.rating_with_fallback(c, F.lit("9"), F.lit("2.5"))) == [
        2.5, 3.0, 2.5,
    ]
    row = spark.range(1).select(rating.has_reviews(F.lit(0), F.lit(None).cast("double")).alias("x"))
    assert row.first().x is False


def test_sentences(spark):
    texts = ['I left. "Why?" he said!  Ok', "Dr. Who came, e.g. today. Fine.", "  ", "One\ntwo...  Three"]
    assert values(spark, texts, tokens.sentences) == [
        ["I left.", '"Why?"', "he said!", "Ok"],
        ["Dr. Who came, e.g. today.", "Fine."],
        [],
        ["One\ntwo...", "Three"],
    ]


def test_words(spark):
    texts = [
        "I'm not very happy. I can't, won't; cannot!",
        'He said "no (way)" -- 3,000.50 dollars: \'Tis the dogs\' end...',
        "U.S. price, yes.",
    ]
    assert values(spark, texts, tokens.words) == [
        ["I", "'m", "not", "very", "happy", ".", "I", "ca", "n't", ",", "wo", "n't", ";", "can", "not", "!"],
        ["He", "said", "``", "no", "(", "way", ")", "''", "--", "3,000.50", "dollars", ":", "'T", "is",
         "the", "dogs", "'", "end", "..."],
        ["U.S", ".", "price", ",", "yes", "."],
    ]


def test_combine_text(spark):
    df = spark.createDataFrame([("t", "b"), ("", "b"), (None, "b"), ("t", None)], "t string, b string")
    build = lambda flag: tokens.combine_text(F.col("t"), F.col("b"), flag)
    got = [tuple(r) for r in df.select(build(True), build(False)).collect()]
    assert got == [("t b", "b"), ("b", "b"), ("b", "b"), ("t ", "")]


def test_fusion(spark):
    df = spark.createDataFrame(
        [(-0.659, -0.625), (0.1, 0.1), (-0.1, -0.1), (0.0999, 0.0999)], "v double, t double"
    )
    v, t = F.col("v"), F.col("t")
    combined = sentiment.combined_score(v, t)
    got = df.select(
        text.round_n(combined, 3), sentiment.sentiment_label(combined),
        text.round_n(sentiment.confidence(v, t), 3),
    ).collect()
    assert tuple(got[0]) == (-0.642, "negative", 0.847)
    assert [r[1] for r in got[1:]] == ["positive", "negative", "neutral"]


@pytest.mark.parametrize(
    "selector, page, tag",
    [
        (".price", '<p class="old-price"><b class="a price">', '<b class="a price">'),
        ("a[href*='pdp']", '<article href="pdp"><a id=1 href="/pdp/x">', '<a id=1 href="/pdp/x">'),
        ("[role='img'][aria-label*='stars']", '<i aria-label="5 stars" role="img">', '<i aria-label="5 stars" role="img">'),
        ("#box", "<div class='box'><div id='box'>", "<div id='box'>"),
        ("h1", "<h10><H1 class=x>", "<H1 class=x>"),
        ("button[aria-label*='See'][aria-label*='profile']", "<button aria-label=\"See O'Hara profile\">",
         "<button aria-label=\"See O'Hara profile\">"),
        ("section[id^='bv-review-']", '<section id="x-bv-review-1"><section id="bv-review-2">',
         '<section id="bv-review-2">'),
    ],
)
def test_opener(spark, selector, page, tag):
    assert values(spark, [page], lambda c: html.opener(c, selector)) == [tag]


def test_elements_follow_nesting(spark):
    page = '<div class="c"><div>a</div><div><div>b</div></div></div><div>x</div><div class="c">d</div>'
    assert values(spark, [page], lambda c: html.elements(c, ".c")) == [
        ["<div>a</div><div><div>b</div></div>", "d"]
    ]


def test_elements_inside_each_other_and_unclosed(spark):
    pages = ['<p><i class="c">a<i class="c">b</i></i><i class="c">d', '<img class="c"><b class="c">e</b>', ""]
    assert values(spark, pages, lambda c: html.elements(c, ".c")) == [
        ['a<i class="c">b</i>', "b", "d"], ["", "e"], [],
    ]


def test_entities_and_invisible(spark):
    assert values(spark, ["a &amp;lt; <b>b</b> &lt;c&gt; "], html.inner_text) == ["a &lt; b <c>"]
    page = "<script>var x='<p>';</script><!-- <p> --><style>p{}</style><p>y</p>"
    assert values(spark, [page], html.visible) == ["<p>y</p>"]


def test_resolve_url(spark):
    base = "https://shop.example.com/en/list/1.html?q=a#top"
    links = ["https://o/x", "//cdn/x", "/en/y", "z.html", "?q=b", "#s", ""]
    assert values(spark, links, lambda c: url.resolve_url(c, F.lit(base))) == [
        "https://o/x", "https://cdn/x", "https://shop.example.com/en/y",
        "https://shop.example.com/en/list/z.html", "https://shop.example.com/en/list/1.html?q=b",
        "https://shop.example.com/en/list/1.html?q=a#s", base,
    ]

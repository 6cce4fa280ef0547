"""Product and review tables derived from the given ones.

One SQL text per table, run by Spark (``{name}`` stands for a DataFrame) and by the
checking engine (``{name}`` stands for a view), so both see the same rows.
"""

FIXTURES: dict[str, str] = {}

FIXTURES["products_raw"] = """
WITH p AS (
  SELECT p_partkey AS k, p_name AS nm, CAST(round(CAST(p_retailprice * 100 AS DECIMAL(18,4))) AS BIGINT) AS cents FROM {part}
), m AS (
  SELECT k, nm, concat('$', CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING), '.',
                       lpad(CAST(cents % 100 AS STRING), 2, '0')) AS money FROM p
)
SELECT k,
  concat(CASE k % 6 WHEN 0 THEN 'Supercycle ' WHEN 1 THEN 'RALEIGH ' WHEN 2 THEN 'Hot Wheels '
                    WHEN 3 THEN 'Stratus ' ELSE '' END,
         nm,
         CASE k % 9 WHEN 0 THEN concat(' Kids', chr(39), ' Mountain Bike') WHEN 1 THEN ' Mountain Bike'
                    WHEN 2 THEN ' Hardtail' WHEN 3 THEN ' Comfort Cruiser' WHEN 4 THEN ' Hybrid'
                    WHEN 5 THEN concat(' Women', chr(39), 's Road Bike') WHEN 6 THEN ' Broadside'
                    ELSE '  ' END) AS title,
  CASE WHEN k % 25 = 24 THEN 'https://shop.example.com/en/pdp/clearance.html'
       ELSE concat('https://shop.example.com/en/pdp/', replace(nm, ' ', '-'), '-',
                   lpad(CAST(k - k % 50 % 2 AS STRING), 7, '0'), 'p.html?rq=q') END AS product_url,
  CASE k % 7 WHEN 0 THEN NULL
             WHEN 1 THEN concat(money, chr(10), 'Save 29% ($80.00)', chr(10), 'price was $1,279.99', chr(10), 'Ends August 07, 2025 ')
             WHEN 2 THEN concat(money, chr(10), 'price was ', money)
             WHEN 3 THEN concat(money, chr(10), 'Ends August 07, 2025')
             WHEN 4 THEN concat('$1,', lpad(CAST(k % 1000 AS STRING), 3, '0'), '.99')
             WHEN 5 THEN concat(chr(10), money)
             ELSE money END AS price,
  concat('https://shop.example.com/en/search-results.html?q=', split_part(nm, ' ', 2)) AS search_url
FROM m
"""

FIXTURES["product_details"] = """
SELECT p_partkey AS k,
  concat(' ', p_name, ' ') AS detailed_title,
  concat('$', CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING), '.00') AS detailed_price,
  CASE WHEN p_partkey % 30 = 29 THEN NULL ELSE concat('SKU ', CAST(p_partkey AS STRING)) END AS sku,
  CASE WHEN p_partkey % 45 = 44 THEN NULL ELSE concat(chr(9), p_type, ' ', p_name, chr(10)) END AS description
FROM {part} WHERE p_partkey % 17 <> 16
"""

# A quarter of the documents are dealt over all products, the others over the first twentieth of
# them, so both the number of products with reviews and the reviews of a product grow. page_no
# numbers a product's pages; of every ninth product the first page was not stored, and products that
# share an address have several first pages.
FIXTURES["reviews_raw"] = """
SELECT concat('bv-review-', CAST(d.doc_id - (CASE WHEN d.doc_id % 40 = 39 THEN 1 ELSE 0 END) AS STRING)) AS review_id,
  CASE WHEN d.doc_id % 40 = 13 THEN 'https://shop.example.com/en/pdp/gone-9999999p.html' ELSE p.product_url END AS product_url,
  CASE WHEN d.doc_id % 11 = 10 THEN NULL ELSE CAST(1 + d.doc_id % 5 AS INT) END AS rating,
  CASE WHEN d.doc_id % 9 = 8 THEN '' ELSE substr(d.text, 1, 30) END AS title,
  CASE WHEN d.doc_id % 50 = 49 THEN '   '
       ELSE concat(CASE d.doc_id % 8 WHEN 0 THEN 'Not very good! ' WHEN 1 THEN 'GREAT bike but terrible seat. '
                                     WHEN 2 THEN 'Extremely bad, I am told. ' WHEN 3 THEN 'Love it!!!!! '
                                     WHEN 4 THEN 'Is it ok?? ' WHEN 5 THEN 'I was never happy. '
                                     WHEN 6 THEN 'Hardly useful. ' ELSE '' END, d.text) END AS body,
  concat(CAST(1 + d.doc_id % 6 AS STRING),
         CASE d.doc_id % 3 WHEN 0 THEN ' days ago' WHEN 1 THEN ' weeks ago' ELSE ' months ago' END) AS date,
  concat('user', CAST(d.doc_id % 37 AS STRING)) AS reviewer,
  coalesce(l.quality, 0) = 1 AS verified_purchaser,
  CAST(d.n_chars % 7 AS INT) AS helpful_count,
  d.doc_id AS seq,
  CAST(floor(d.doc_id / d.dealt) AS INT) + (CASE WHEN p.k % 9 = 5 THEN 2 ELSE 1 END) AS page_no
FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN n ELSE greatest(CAST(floor(n / 20) AS BIGINT), 1) END AS dealt
      FROM (SELECT *, (SELECT count(*) FROM {part}) AS n FROM {documents}) counted) d
JOIN (SELECT k, product_url FROM {products_raw}) p ON p.k = d.doc_id % d.dealt
LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

FIXTURES["ratings_summary"] = """
SELECT product_url, CAST(round(CAST(avg(rating) AS DECIMAL(18,9)), 1) AS DOUBLE) AS average_rating, count(*) AS total_reviews
FROM {reviews_raw} WHERE seq % 13 <> 0 AND rating IS NOT NULL GROUP BY product_url
"""

FIXTURES["review_sections"] = """
SELECT seq, review_id, product_url, page_no,
  concat('<section id="', review_id, '">',
    CASE WHEN rating IS NULL THEN '' ELSE concat('<div role="img" aria-label="', CAST(rating AS STRING), ' out of 5 stars"></div>') END,
    '<h3> ', replace(replace(replace(replace(title, chr(10), ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ' </h3><button aria-label="See ', reviewer, ' profile">', reviewer, '</button>',
    '<span class="bv-rnr__g3jej5-1">', date, '</span><div class="bv-rnr__sc-16dr7i1-3">', replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</div>',
    CASE WHEN verified_purchaser THEN '<i title="They purchased the product"></i>' ELSE '' END,
    '<button aria-label="', CAST(helpful_count AS STRING), ' people found this review helpful"></button></section>') AS html
FROM {reviews_raw}
"""

FIXTURES["product_cards"] = """
SELECT k, search_url,
  concat('<article>',
    CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN concat('<span class="card-title">', title, '</span>') ELSE concat('<h3> ', title, '</h3>') END,
    CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN '<a href="/help">help</a>' ELSE concat('<a href="', product_url, '">open</a>') END,
    CASE WHEN price IS NULL THEN '' ELSE concat('<span class="price">', price, '</span>') END, '</article>') AS html
FROM {products_raw}
"""

FIXTURES["rating_widgets"] = """
SELECT k, product_url,
  CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN '4.1 out of 5' WHEN 2 THEN '0' WHEN 3 THEN '7.5' WHEN 4 THEN 'n/a' ELSE '3' END AS rating_text,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'no reviews' WHEN 2 THEN '(0)' ELSE concat('(', CAST(k % 90 AS STRING), ' )(', CAST(k % 90 AS STRING), ')') END AS count_text,
  CASE k % 3 WHEN 0 THEN NULL ELSE '2.5' END AS alt_rating_text
FROM {products_raw}
"""

FIXTURES["valence_lexicon"] = """
SELECT word, CAST(valence AS DECIMAL(18,6)) AS valence FROM (VALUES
  ('good', 1.9), ('great', 3.1), ('terrible', -2.1), ('bad', -2.5), ('love', 3.2), ('happy', 2.7),
  ('useful', 1.9), ('ok', 1.2), ('with', 0.4), ('from', -0.3), ('pour', 0.2), ('para', -0.2), ('von', 0.1)) AS t(word, valence)
"""

FIXTURES["polarity_lexicon"] = """
SELECT word, CAST(polarity AS DECIMAL(18,6)) AS polarity FROM (VALUES
  ('good', 0.7), ('great', 0.8), ('terrible', -1.0), ('bad', -0.7), ('love', 0.5), ('happy', 0.8),
  ('useful', 0.3), ('ok', 0.5), ('with', 0.1), ('from', -0.1)) AS t(word, polarity)
"""

FIXTURES["modifiers"] = """
SELECT word, kind, CAST(value AS DECIMAL(18,6)) AS value FROM (VALUES
  ('very', 'booster', 0.293), ('extremely', 'booster', 0.293), ('hardly', 'booster', -0.293),
  ('very', 'intensity', 1.3), ('extremely', 'intensity', 1.4), ('hardly', 'intensity', 0.5),
  ('not', 'negator', -0.74), ('never', 'negator', -0.74)) AS t(word, kind, value)
"""

FIXTURES["raw_products"] = """
SELECT p.k, p.title, p.product_url, p.price, p.search_url,
  d.detailed_title, d.detailed_price, d.sku, d.description
FROM {products_raw} p LEFT JOIN {product_details} d ON p.k = d.k
"""

# Stored listing pages in six layouts, one per card selector and one without cards.
FIXTURES["listing_pages"] = """
SELECT k, title, product_url, price,
  concat('https://shop.example.com/en/list/', CAST(k AS STRING), '.html') AS url,
  concat('<!DOCTYPE html><html><head><script>var x = "<article><h3>no</h3></article>";</script></head>',
    '<body><!-- <article><h3>old</h3></article> --><nav><a href="/home">home</a></nav>',
    CASE k % 6
      WHEN 0 THEN concat('<article class="tile"><h2> ', title, ' </h2><a href="', product_url,
        '">open</a><span class="price now"><b>', coalesce(price, ''), '</b></span></article>',
        '<article><h3> </h3><p class="item-name">Second &amp; ', title,
        '</p><a href="help/more.html">more</a></article>')
      WHEN 1 THEN concat('<div data-testid="product-tile"><div><div class="card-title">', title,
        '</div></div><a href="', product_url, '">open</a></div><div>between</div>',
        '<div data-testid="product-tile"><h4>Second</h4><div><a href="/en/pdp/other-', CAST(k AS STRING),
        'p.html">open</a></div></div>')
      WHEN 2 THEN concat('<div class="grid"><div class="wide product-card"><div class="a"><div class="b"><h1>', title,
        '</h1></div></div><div><span data-testid="price-box">', coalesce(price, ''), '</span></div><a href="',
        product_url, '">open</a></div><div class="footer"><h1>not a card</h1></div></div>')
      WHEN 3 THEN concat('<ul><li class="product-tile"><a title="named" href="', product_url, '">', title,
        '</a></li><li class="product-tile"><em>no link</em></li></ul>')
      WHEN 4 THEN concat('<section class="my-productbox"><h3>', title, '</h3><a href="?q=product">open</a></section>')
      ELSE '<p>nothing here</p>' END,
    '</body></html>') AS html
FROM {products_raw}
"""

FIXTURES["detail_pages"] = """
SELECT k AS page_id, product_url AS url,
  concat('<html><head><style>.sku {{}}</style></head><body><h1> ', title, ' </h1>',
    CASE WHEN detailed_price IS NULL THEN '' ELSE concat('<div class="big-price">', detailed_price, '</div>') END,
    CASE WHEN sku IS NULL THEN '' ELSE concat('<span data-testid="the-sku">', sku, '</span>') END,
    CASE WHEN description IS NULL THEN '<p class="detail"> </p>'
         ELSE concat('<p class="detail">', description, '</p>') END,
    '</body></html>') AS html
FROM {raw_products}
"""

# A stored review page: rating widget, container with two sections, pagination.
FIXTURES["review_pages"] = """
SELECT s.seq, s.review_id, s.product_url, s.page_no, s.html AS section,
  concat('<html><body>',
    CASE s.seq % 5
      WHEN 0 THEN concat('<button class="w"><span class="bv_numReviews_text"> (', CAST(s.seq % 90 AS STRING),
        ') </span></button><div class="bv_avgRating_component_container"> 4.1 out of 5 </div>')
      WHEN 1 THEN concat('<button><span class="bv_numReviews_text">(', CAST(s.seq % 9 AS STRING),
        ')</span></button><div class="bv_avgRating_component_container">0</div>',
        '<span class="bv-rating-value"></span><i data-rating="3.5"></i>')
      WHEN 2 THEN '<span class="bv_numReviews_text">(7)</span><button>4 stars <b>(33)</b></button>'
      WHEN 3 THEN '<button><span class="bv_numReviews_text">no number (yet)</span></button><p class="rating-value">7.5</p><p class="average-rating">2.5</p>'
      ELSE '<p>no widget</p>' END,
    CASE s.seq % 7
      WHEN 0 THEN '<div id="BVRRContainer-mobile"><button class="nl-accordion__button" aria-expanded="true">r</button><div class="nl-accordion__panel">p</div></div>'
      WHEN 1 THEN '<div id="BVRRContainer-mobile"><div><button class="nl-accordion__button" aria-expanded="false">r</button></div><div class="nl-accordion__panel nl-accordion__panel--hidden">p</div></div>'
      WHEN 2 THEN '<p>plain</p>'
      WHEN 3 THEN '<div class="bv-review-a"></div><div class="bv-review-b"></div><div class="bv-other"></div><i id="BV-Review"></i><i class="bv-x" id="BVReviewer"></i>'
      ELSE '<div id="BVRRContainer"></div>' END,
    CASE WHEN s.seq % 7 = 2 OR s.seq % 7 = 3 THEN ''
         ELSE concat('<div id="reviews_container"><div><div>intro</div></div>', s.html,
           '<section id="', s.review_id, '-b"><h3>Reply</h3></section></div>',
           '<section id="bv-review-outside"><h3>Outside</h3></section>') END,
    CASE s.seq % 4
      WHEN 0 THEN '<a class="prev next" role="button" href="/page">Next</a><div class="bv-rnr__sc-11r39gb-2"> 1 to 8 </div>'
      WHEN 1 THEN '<button>NEXT <b>Reviews</b></button><div class="bv-rnr__sc-11r39gb-2"> </div>'
      WHEN 2 THEN '<button disabled>Next Reviews</button><a style="display: none">next review</a>'
      ELSE '<a href="/other">Reviews</a>' END,
    '</body></html>') AS html
FROM {review_sections} s
"""

# Two generations of rating summaries: seq 1 is stored, later ones are new.
FIXTURES["ratings_history"] = """
SELECT product_url, average_rating, total_reviews,
  CAST('2025-08-01 00:00:00' AS TIMESTAMP) AS extracted_at, 1 AS seq FROM {ratings_summary}
UNION ALL
SELECT product_url, CAST(5 AS DOUBLE), total_reviews + 1,
  CAST('2025-08-02 10:30:00' AS TIMESTAMP), 2 FROM {ratings_summary} WHERE average_rating >= 3
UNION ALL
SELECT product_url, CAST(4.5 AS DOUBLE), total_reviews + 2,
  CAST('2025-08-02 10:30:00' AS TIMESTAMP), 3 FROM {ratings_summary} WHERE average_rating >= 3.1
"""

# Price history: every order line is an observation of its part's unit price.
FIXTURES["prices"] = """
SELECT concat(lpad(CAST(l_partkey AS STRING), 7, '0'), 'p') AS product_id, l_shipdate AS timestamp,
  l_extendedprice / l_quantity AS current_price,
  l_orderkey * 10 + l_linenumber AS line
FROM {lineitem}
"""

# Listing pages whose cards hold blocks inside blocks, a card inside a card, unquoted attributes
# and character references of all kinds.
FIXTURES["nested_pages"] = """
SELECT k, concat('https://shop.example.com/en/list/', CAST(k AS STRING), '.html') AS url,
  concat('<html><body><div class="product-card bundle"><div><h3><span>Kit</span> <b>', CAST(k AS STRING),
    '</b> caf&eacute;&reg;</h3></div><a href=/en/pdp/kit-', CAST(k AS STRING), 'p.html>open</a>',
    '<div class=price><div><div>$', CAST(100 + k % 900 AS STRING), '.50</div></div>',
    CASE k % 3 WHEN 0 THEN concat('<div class="save"><div>Save ', CAST(1 + k % 60 AS STRING), '% (&#36;', CAST(1 + k % 40 AS STRING),
      '.25)</div></div><p>price was <s>&#x24;1,', lpad(CAST(k % 1000 AS STRING), 3, '0'), '.99</s><br>Ends August 07, 2025<br/></p>')
      WHEN 1 THEN '<ul><li>Ends <em>May&nbsp;1</em></li></ul>' ELSE '' END, '</div>',
    '<div class="product-card"><h3>Part &#8217;', CAST(k AS STRING), '&rsquo; &amp;lt; &#146;&#128690;</h3>',
    '<a title="x href=/no" href=''/en/pdp/part-', CAST(k AS STRING), 'p.html''>open</a></div></div>',
    '<div class="product-card"><table><tr><td>Spare</td><td>', CAST(k AS STRING), '</td></tr></table>',
    '<h4>Spare<br>', CAST(k AS STRING), '</h4><a href="/help">help</a></div></body></html>') AS html
FROM {products_raw}
"""

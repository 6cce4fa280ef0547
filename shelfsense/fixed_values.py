"""Values that decide results. Every operator takes them as default arguments."""

# --- fixed values -----------------------------------------------------------
# Changing any of these changes what the engine computes.

BRANDS = ("Supercycle", "Raleigh", "Stratus", "Marvel", "Hot Wheels")
UNKNOWN_BRAND = "Unknown"

CATEGORIES = (
    ("kids_bikes", ("kids'", "children", "youth")),
    ("mountain_bikes", ("mountain", "dual-suspension", "hardtail")),
    ("comfort_bikes", ("comfort", "cruiser", "women's")),
    ("road_bikes", ("road", "hybrid")),
)
OTHER_CATEGORY = "bikes"
UNTITLED_CATEGORY = "general"

# Listing page: the first card selector that matches anything supplies all cards.
CARD_SELECTORS = (
    "article",
    "[data-testid*='product']",
    ".product-card",
    ".product-tile",
    "[class*='product']",
)
TITLE_SELECTORS = ("h1", "h2", "h3", "h4", "[class*='title']", "[class*='name']", "a[title]")
LINK_SELECTORS = ("a[href*='pdp']", "a[href*='product']", "a[href]")
PRICE_SELECTORS = (".price", "[class*='price']", "[data-testid*='price']")
SKU_SELECTORS = ("[class*='sku']", "[data-testid*='sku']", "[class*='model']")
DESCRIPTION_SELECTORS = (".description", "[class*='description']", "[class*='detail']")

# Rating widget and review container.
COUNT_SELECTOR = ".bv_numReviews_text"
RATING_SELECTOR = ".bv_avgRating_component_container"
ALT_RATING_SELECTORS = (".bv-rating-value", "[data-rating]", ".rating-value", ".average-rating")
PAGINATION_SELECTOR = ".bv-rnr__sc-11r39gb-2"
DATE_SELECTOR = ".bv-rnr__g3jej5-1"
BODY_SELECTOR = ".bv-rnr__sc-16dr7i1-3"
REVIEW_PHRASES = (
    "verified purchaser",
    "days ago",
    "weeks ago",
    "months ago",
    "helpful",
    "filter reviews",
)
MIN_REVIEW_PHRASES = 2
MIN_REVIEW_ELEMENTS = 4

# Sentiment fusion.
LABEL_THRESHOLD = 0.1
AGREEMENT_WEIGHT = 0.6
INTENSITY_WEIGHT = 0.4
SCORED_METHOD = "vader_textblob_combined"
BLANK_METHOD = "no_text"

# Valence rule constants (Hutto & Gilbert, ICWSM 2014).
CAPS_BOOST = 0.733
NEGATION_SCALE = -0.74
DISTANCE_DECAY = (1.0, 0.95, 0.9)
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
BANG_STEP, BANG_CAP = 0.292, 4
QUERY_STEP, QUERY_CAP, QUERY_MAX = 0.18, 3, 0.96
NORMALISER = 15
# Mean-polarity rule constants.
POLARITY_NEGATION = -0.5

CLEAR_CONFIRMATION = "DELETE"
# --- end of fixed values ----------------------------------------------------

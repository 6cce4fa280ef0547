"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma separated, or "all") choose what runs.
Every query is executed in full and its result thrown away (``noop`` sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

from shelfsense.session import build_session
from shelfsense.workload import runners

HEADLINE = (
    "price_discount_by_category", "cleaning_summary", "products_with_ratings",
    "reviews_with_products", "upsert_ratings", "latest_price", "first_review_per_key",
    "keyed_update", "review_rollup_by_product", "sentences", "words", "top_keywords",
    "valence_scores", "sentiment_struct", "sentiment_incremental", "sentiment_breakdown",
    "sentiment_by_category", "card_listing", "product_details", "rating_widget_pages",
    "review_fields", "clean_products", "harvest_reviews", "stream_enrich",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = runners()
    wanted = os.environ.get("BENCH_QUERIES")
    names = HEADLINE
    if wanted:
        names = tuple(known) if wanted == "all" else tuple(wanted.split(","))
    # Start the JVM's scan, expression and shuffle machinery before anything is timed.
    for name in ("category", "review_rollup_by_product"):
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        if name not in known:
            continue
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries on the given tables; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from promoforge.plans.driver import all_queries  # noqa: E402
from promoforge.plans.driver.search_queries import manifests  # noqa: E402
from promoforge.plans.driver.views import NOW, catalog  # noqa: E402
from promoforge.plans.search import SearchRequest, facets, result_page  # noqa: E402
from promoforge.schemas import SOURCE  # noqa: E402
from promoforge.session import configure, work_path  # noqa: E402
from promoforge.sources.catalog import CatalogStore  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# Queries measured from the raw tables; the search is also measured on a stored catalog.
FROM_TABLES = ("search_facets", "search_price", "search_relevance", "availability", "conflict_dedup", "reconcile_revision",
               "classify_titles", "unit_price", "keyword_documents", "absence_counter", "retention", "spread_sample",
               "page_continuity", "page_links", "range_cells", "array_products")


def timed(make, runs):
    """Median seconds to plan and run, after one warm-up."""
    seconds = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds[1:]), 3)


def main():
    spark = configure(
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, results = all_queries(), {}

    store = CatalogStore(spark, work_path(spark, "bench-catalog"), shards=8, buckets=8)
    start = time.perf_counter()
    store.commit(spark.createDataFrame([], SOURCE), catalog(spark, SF_DIR))
    results["store_catalog"] = round(time.perf_counter() - start, 3)
    rows = store.read().count()
    stored = store.read()
    searches = {
        "stored_search_facets": lambda: facets(stored, SearchRequest(NOW)),
        "stored_search_recent": lambda: result_page(stored, SearchRequest(NOW)),
        "stored_search_price": lambda: result_page(stored, SearchRequest(NOW, sort="price", price_basis="kg")),
        "stored_search_keyword": lambda: result_page(stored, SearchRequest(NOW, sort="relevance", query="red widget")),
        "stored_search_targets": lambda: facets(
            store.read(["src-1", "src-2", "src-3"]), SearchRequest(NOW, targets=("src-1", "src-2", "src-3"))),
    }
    for name, make in searches.items():
        results[name] = timed(make, 5)
    for name in FROM_TABLES:
        results[name] = timed(lambda name=name: queries[name](spark, SF_DIR), 1)
    whole = results["stored_search_facets"] + results["stored_search_recent"]
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(results.values()), 3), "unit": "sec",
        "queries": results, "sf": Path(SF_DIR).name.removeprefix("sf"),
        "catalog_rows": rows, "search_rows_per_sec": round(rows / whole),
        "sources": manifests(spark, SF_DIR).agg(F.count(F.lit(1)).alias("n")).first().n,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

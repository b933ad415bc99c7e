"""Headline queries, each from the raw tables to its last row.

Nothing is shared between queries: stored stages are forgotten before each one, so a
number covers everything a query needs. Prints one line of JSON.
"""

from __future__ import annotations

import json
import os
import time

from parity.queries import registered
from parity.tables import forget
from tillroll.session import local_session, use_shared_folder

HEADLINES = [
    "column_profile", "duplicate_count", "orders_per_country", "returns_without_counterpart", "netted_lines",
    "baskets", "scored_customers", "document_keyword_inventory", "product_keyword_hits", "basket_statistics",
    "row_silhouettes", "nearest_center", "customer_clusters", "product_clusters", "balanced_classes", "model_comparison",
    "later_period",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    use_shared_folder(spark, os.environ.get("BENCH_STAGES", "/tmp/tillroll-bench"))
    queries = registered()
    queries["table_size"](spark, folder).collect()  # starts the JVM, reads footers
    seconds = {}
    for name in HEADLINES:
        forget()
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries from raw tables, total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()

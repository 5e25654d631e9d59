"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "index_postings", "bm25_topk", "phrase", "and", "prefix", "bool_must_should", "agg_terms_sub", "agg_terms_nested", "agg_histogram", "agg_date_day", "agg_percentiles", "agg_range",
    "knn_cosine", "hybrid_rrf", "hybrid_weighted_max_norm", "merge_normalized", "decay_gauss", "score_function", "top_terms", "suggest_fuzzy", "more_like_this",
    "upsert", "export_import", "graph_bfs", "html_strip",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quern.registry import QUERIES

    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first warms up
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(sorted(runs[1:])[0], 4)
    print(json.dumps({"metric": "headline queries, best of two warm runs, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()

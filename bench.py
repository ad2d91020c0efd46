"""Benchmark: run headline queries on $BENCH_SF_DIR and print one JSON line.

Each query is executed in full with the no-op sink (nothing is collected to
the driver); the time includes planning and any eager checkpoint the query
performs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["v2_knn_exact", "b3_bm25_search", "r2_ndcg_bm25", "e1_encode", "e3_untied_search",
            "a2_softmax_weights", "a3_contrastive_loss", "k10_training_views", "m1_seeded_shuffle",
            "v6_knn_sparse", "s7_write_ranking"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from nearline.session import get_spark
    import nearline.plans as plans

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    # The bench tables are single row groups, which no scan can split.
    spark.conf.set("spark.nearline.scanPartitions", cpus)
    # Warm up the JVM and Python workers once so the first query is not penalised.
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for n in names:
        t0 = time.time()
        df = plans.REGISTRY[n].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

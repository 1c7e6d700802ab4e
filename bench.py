"""Prints one JSON line with the seconds of the headline queries.

$BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]; each query's
whole result goes to the noop sink. One small query warms the session up, and each
query is run twice, of which the second is counted, so that code is generated before.
"""

from __future__ import annotations

import json
import os
import time

from fieldspark.plans import registry
from fieldspark.session import local_session

HEADLINE = (
    "q_scatter_capped_counts q_dim_join q_halfspace_filter q_pack_unpack q_bands_overlap q_lookup_bilinear q_min_pyramid "
    "q_neighbor_min q_triangle_blur q_nearest_segment q_keyframe_asof q_asof_join q_floor_p95 q_rolling_p95 q_ema q_argmax_first "
    "q_transmittance q_conditional_mean q_bucket_sums q_newest_partition_sum q_topk_passes q_lattice_dedup q_pixel_diff "
    "q_cull_classify q_quadtree q_fill q_erosion q_stream_ema q_stream_tumbling"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["q_distinct_layers"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` how
often each query runs (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spotgrid.catalog import QUERIES  # noqa: E402
from spotgrid.plans.session import local_session  # noqa: E402

HEADLINE = [
    "expression_maps",
    "rasterize",
    "rasterize_points",
    "dense_images",
    "paired_samples",
    "read_wide_counts",
    "read_count_matrix",
    "gene_vectors",
    "embed_counts",
    "project_counts",
    "exact_split",
    "shuffle_batches",
    "cycle_batches",
    "patch_vectors",
    "resize_nearest_up",
    "assign_codes",
    "ema_update",
    "tokenize",
    "detokenize",
    "mask_tokens",
    "fit_token_scorer",
    "topk_filter",
    "confidence_scores",
    "generate",
    "generate_inverse",
    "refine_codebook",
    "soft_lookup",
    "recon_loss_l1",
    "masked_cross_entropy",
    "accumulate_metrics",
    "ema_by_key",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in ("expression_maps", "assign_codes"):
        once(name)  # start the JVM's code paths and the Python workers
    timings = {name: round(statistics.median(once(name) for _ in range(runs)), 3) for name in HEADLINE}
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    result = {
        "metric": "headline queries, wall seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": scale,
        "cpus": cpus,
        "runs": runs,
    }
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pixelspark.checks import QUERIES
from pixelspark.session import local_session

HEADLINE = (
    "usable_assets_by_group",
    "p13_perceptual_hash",
    "p19_text_embedding",
    "p23_quality_score",
    "j1_exact_duplicates",
    "j2_near_duplicates",
    "j3_greedy_near_duplicates",
    "j7_nearest_palette_color",
    "j12_scene_composition",
    "a3_index_map",
    "a4_box_palette",
    "a5_manifest_report",
    "a12_connected_regions",
    "a14_sheet_boxes",
    "a23_corpus_metrics",
    "w2_balanced_sample",
    "w5_train_val_test_split",
    "w6_bucket_batches",
    "w8_padded_batches",
    "w9_masked_tokens",
    "s4_decode_png",
    "s10_archive_members",
    "r3_dedup_against_history",
    "q2_candidate_classes",
    "q3_manifest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

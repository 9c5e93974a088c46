"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pyspark.sql import SparkSession

from pagetone.plans.queries import QUERIES

HEADLINE = (
    "A3_intake_census", "B4_tokenize", "B5_with_operands", "C1_nongray_rgb", "C9_summarize_ops", "D2_colorspace_label",
    "D12_first_visit", "E4_report_topk", "E6_conversion_counts", "F7_apply_lut", "F10_tint_to_gray",
    "G1_current_colorspace", "G4_tint_lookup", "G6_rewrite_streams", "G9_rewrite_audit", "H4_pixels_to_gray",
    "H6_delta_encode", "H8_gray_histogram", "I1_page_class", "I4_fold_page_edits",
)


#: Tables that arrive as a single row group, which no reader can split. They are laid out in files once, before
#: the clock starts, as a large table would be.
ONE_SPLIT = ("documents", "part")


def laid_out(spark: SparkSession, sf_dir: str, folder: str, files: int) -> str:
    for table in sorted(os.listdir(sf_dir)):
        if table.removesuffix(".parquet") in ONE_SPLIT:
            spark.read.parquet(f"{sf_dir}/{table}").repartition(files).write.parquet(f"{folder}/{table}")
        else:
            os.symlink(os.path.abspath(f"{sf_dir}/{table}"), f"{folder}/{table}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="pagetone-bench-")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("pagetone-bench")
             .config("spark.sql.shuffle.partitions", str(4 * int(cpus) if cpus.isdigit() else 32))
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.checkpoint.dir", folder)
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    found = re.search(r"sf([\d.]+)", sf_dir)
    sf_dir = laid_out(spark, sf_dir, tempfile.mkdtemp(prefix="pagetone-tables-"), 32)
    QUERIES["E6_conversion_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the engine
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()

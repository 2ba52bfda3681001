"""Run one registered query as a batch job and write its result.

    spark-submit --py-files clinops.zip clinops/plans/submit.py \\
        --key patient_360 --input <shared input folder> --output <shared output folder>

The session comes from the cluster (``getOrCreate`` — nothing is overridden);
the result is written as parquet (or JSON for the one-row snapshots) with the
commit protocol of the file sink, so a failed job leaves no partial output.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from clinops.plans.registry import REGISTRY

JSON_KEYS = {"snapshot_json", "wearable_snapshot"}


def run(spark: SparkSession, key: str, input_dir: str, output: str, mode: str = "overwrite",
        partition_by: list[str] | None = None) -> str:
    if key not in REGISTRY:
        raise ValueError(f"unknown query key: {key}")
    df = REGISTRY[key](spark, input_dir)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if key in JSON_KEYS:
        w.json(output)
    else:
        w.parquet(output)
    return output


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description="run one clinops query and write its result")
    ap.add_argument("--key", required=True, choices=sorted(REGISTRY))
    ap.add_argument("--input", required=True, help="folder holding the input parquet tables")
    ap.add_argument("--output", required=True)
    ap.add_argument("--mode", default="overwrite", choices=["overwrite", "append", "errorifexists"])
    ap.add_argument("--partition-by", default="", help="comma-separated output partition columns")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"clinops-{a.key}").getOrCreate()
    parts = [c for c in a.partition_by.split(",") if c]
    print(run(spark, a.key, a.input, a.output, a.mode, parts or None))


if __name__ == "__main__":
    main()

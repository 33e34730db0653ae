"""python -m kinweave --input DIR --output-dir DIR: run the benchmark over a profiles table and write its report."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> list[str]:
    p = argparse.ArgumentParser(prog="kinweave")
    p.add_argument("--input", required=True, help="folder with profiles.parquet")
    p.add_argument("--output-dir", default="reports")
    p.add_argument("--dataset", default="real_curated_core")
    p.add_argument("--max-df", type=int, default=None, help="leave out blocking keys that more profiles share")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from kinweave.plans.benchmark import run_benchmark
    from kinweave.session import local_session, ship
    from kinweave.sources.datasets import load_dataset, profiles_once
    from kinweave.sources.sinks import write_report

    spark = SparkSession.getActiveSession() or local_session()
    ship(spark)
    how = {"max_df": a.max_df} if a.max_df else {}
    return write_report(run_benchmark(load_dataset(profiles_once(spark, a.input), a.dataset), **how), a.output_dir)


if __name__ == "__main__":
    for path in main():
        print(path)

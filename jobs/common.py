"""What the jobs share: their settings, their log, and counts that are taken while a table is written."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def settings(name: str, path: str | None = None) -> dict:
    """The settings of a job: those beside it, with what the file at path puts in their place. A setting it doesn't have is an error."""
    own = json.loads(Path(__file__).with_name(f"{name}.json").read_text())
    given = json.loads(Path(path).read_text()) if path else {}
    if unknown := sorted(set(given) - set(own)):
        raise ValueError(f"{name} has no settings {unknown}")
    return own | given


def read(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    log.info("read %s: %s", path, ", ".join(df.columns))
    return df


def write(df: DataFrame, path: str, *partition_by: str) -> int:
    """df in place of what path had, in folders by partition_by. Returns the rows written."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    n = df.sparkSession.read.parquet(path).count()  # from the footers of the files
    log.info("wrote %s rows to %s, by %s", n, path, ", ".join(partition_by))
    return n


def main(name: str, run: Callable, paths: dict[str, str], argv: list[str] | None = None) -> None:
    """The command line of a job: one argument for each of paths (name: help), and --config. Creates and stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=sys.modules[run.__module__].__doc__)
    for k, text in paths.items():
        parser.add_argument(f"--{k}", required=True, help=text)
    parser.add_argument("--config", help="a JSON file with settings in place of the job's own")
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = settings(name, given.pop("config"))
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        done = run(spark, **given, config=config)
        log.info("done: %s", json.dumps(done))
    finally:
        spark.stop()

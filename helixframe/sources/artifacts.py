"""Tables with a manifest: written with it, and read only if it is there, complete and of the same content."""

from __future__ import annotations

import json
import platform
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .readers import digest

REQUIRED = ("name", "version", "created_utc", "scope", "inputs", "parameters", "seed", "command", "outputs", "n_rows", "schema", "software", "status", "notes")
SCOPES = ("synthetic", "real")


class ArtifactError(RuntimeError):
    pass


def manifest(name: str, df: DataFrame, scope: str, **more) -> dict:
    """What a table is and comes from; more overrides or adds fields."""
    if scope not in SCOPES:
        raise ArtifactError(f"scope is one of {SCOPES}")
    base = {
        "name": name, "version": "1", "created_utc": datetime.now(UTC).isoformat(timespec="seconds"), "scope": scope, "inputs": [], "parameters": {}, "seed": None, "command": "", "notes": "",
        "outputs": {"rows_sha256": digest(df)}, "n_rows": df.count(), "schema": df.schema.simpleString(), "software": {"python": platform.python_version(), "spark": df.sparkSession.version}, "status": "complete",
    }
    return base | more


def missing_fields(record: dict) -> list[str]:
    return [k for k in REQUIRED if k not in record]


def write_json(path: str | Path, record: dict) -> None:
    part = Path(path).with_suffix(".part")
    part.parent.mkdir(parents=True, exist_ok=True)
    part.write_text(json.dumps(record, indent=1, sort_keys=True, default=str))
    part.replace(path)


def write_table(df: DataFrame, path: str, name: str, scope: str, partition_by: tuple[str, ...] = (), **more) -> dict:
    """df as Parquet at path, and its manifest beside it."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    record = manifest(name, df.sparkSession.read.parquet(path), scope, **more)
    write_json(f"{path}.manifest.json", record)
    return record


def read_table(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame | None, dict | None, str]:
    """The table, its manifest and "ok"; or why not. strict raises instead. A digest is held against the rows where one is recorded."""
    side = Path(f"{path}.manifest.json")

    def refuse(why: str):
        if strict:
            raise ArtifactError(f"{path}: {why}")
        return None, None, why

    if not Path(path).exists():
        return refuse("missing")
    if not side.exists():
        return refuse("no manifest")
    record = json.loads(side.read_text())
    if missing := missing_fields(record):
        return refuse(f"manifest lacks {missing}")
    df = spark.read.parquet(path)
    if (want := record["outputs"].get("rows_sha256")) and digest(df) != want:
        return refuse("content differs from the manifest")
    return df, record, "ok"


class StatusRegistry:
    """Outcomes of validation tests in a JSON file. A test without entry was not run."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def all(self) -> dict:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def set(self, test: str, status: str, **details) -> None:
        write_json(self.path, self.all() | {test: {"status": status, "recorded_utc": datetime.now(UTC).isoformat(timespec="seconds"), **details}})

    def status(self, test: str) -> str:
        return self.all().get(test, {}).get("status", "NOT RUN")

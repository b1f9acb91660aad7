"""Settings whose every number says where it comes from, and breakpoints that must be verified before use."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# What a number of each provenance must say.
NEEDS = {"source_derived": ("citation",), "pre_registered": ("date", "rationale")}
BREAKPOINT = ("susceptible_max_mg_l", "resistant_min_mg_l", "verified_by", "source_excerpt")


class ConfigError(ValueError):
    pass


def leaves(tree: dict, at: str = ""):
    """Paths and entries of a tree of settings: an entry has a value."""
    for k, v in (tree or {}).items():
        path = f"{at}.{k}" if at else k
        if isinstance(v, dict) and "value" in v:
            yield path, v
        elif isinstance(v, dict):
            yield from leaves(v, path)
        else:
            yield path, {}


def faults(tree: dict) -> list[str]:
    out = []
    for path, entry in leaves(tree):
        kind = entry.get("provenance")
        if kind not in NEEDS:
            out.append(f"{path}: provenance is one of {sorted(NEEDS)}")
        else:
            out += [f"{path}: {kind} needs {k}" for k in NEEDS[kind] if not entry.get(k)]
    return out


def load(path: str) -> dict:
    import yaml

    config = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if wrong := faults(config.get("thresholds", {})):
        raise ConfigError("; ".join(wrong))
    return config


def threshold(config: dict, path: str):
    entry = dict(leaves(config.get("thresholds", {}))).get(path)
    if not entry:
        raise ConfigError(f"no setting {path}")
    return entry["value"]


def provenance(spark: SparkSession, config: dict) -> DataFrame:
    rows = [(p, str(e["value"]), e["provenance"], e.get("citation"), str(e.get("date") or ""), e.get("rationale")) for p, e in leaves(config.get("thresholds", {}))]
    return spark.createDataFrame(rows, "setting string, value string, provenance string, citation string, date string, rationale string")


def verified(breakpoint: dict) -> dict:
    """The breakpoint, if it is verified and complete; else an error."""
    missing = [k for k in BREAKPOINT if not breakpoint.get(k)]
    if breakpoint.get("status") != "VERIFIED" or missing:
        raise ConfigError(f"breakpoint isn't verified: {breakpoint.get('status')}, without {missing}")
    return breakpoint


def answer_key(path: str) -> tuple[dict, str]:
    """A registered key and the sha256 of its file, which an association must be given."""
    import yaml

    data = Path(path).read_bytes()
    key = yaml.safe_load(data) or {}
    if key.get("status") != "pre_registered":
        raise ConfigError("the key isn't registered")
    return key, hashlib.sha256(data).hexdigest()

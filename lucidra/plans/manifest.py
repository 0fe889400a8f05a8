"""Run manifests and settings on the driver: placeholders, completeness, condition table hashes, TOML."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidra.functions.text import canonical_hash
from lucidra.plans.pipeline import RunConfig
from lucidra.sources.io import content_hash

# Texts that stand for a value still to be filled in.
PLACEHOLDERS = ("tbd", "todo", "placeholder", "to_be_filled", "replace_me", "unknown")
# Dimensions whose settings a finished manifest must name.
DIMENSIONS = ("R1", "R2", "R3", "R4", "R5", "R6", "R7")


def placeholder_paths(value: object, path: str = "") -> list[str]:
    """Paths of all values that are null, blank or placeholders, at any depth."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in placeholder_paths(v, f"{path}.{k}" if path else str(k))]
    if isinstance(value, (list, tuple)):
        return [p for i, v in enumerate(value) for p in placeholder_paths(v, f"{path}[{i}]")]
    if value is None or (isinstance(value, str) and (not value.strip() or value.strip().lower() in PLACEHOLDERS)):
        return [path]
    return []


def finalize(manifest: dict) -> dict:
    """The manifest with its content hash; placeholders, missing dimension settings or a grid that does not rise are errors."""
    if open_ := placeholder_paths(manifest):
        raise ValueError(f"still to be filled in: {open_}")
    if missing := [d for d in DIMENSIONS if d not in manifest.get("dimension_settings", {})]:
        raise ValueError(f"no settings for {missing}")
    grid = manifest.get("policy_grid", [])
    if not grid or grid != sorted(set(grid)) or not all(0 <= t <= 1 for t in grid):
        raise ValueError("the policy grid must rise within [0, 1]")
    return manifest | {"finalized": True, "content_hash": content_hash(manifest)}


def condition_table_hash(conditions: DataFrame, key: list[str]) -> str:
    """One digest of a condition table, independent of the order of its rows; repeated keys are an error.

    Rows are hashed where they are and combined in sorted order through one digest per 4096 leading parts, so the
    driver sees at most that many.
    """
    if not conditions.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError("condition keys must be unique")
    cols = [F.col(c) for c in sorted(conditions.columns)]
    h = conditions.select(canonical_hash(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})).alias("h"))
    parts = h.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    return content_hash([[r.p, r.d] for r in parts.orderBy("p").collect()])


def load_run_config(path: str | Path) -> RunConfig:
    """A run configuration from TOML with tables run, model, prompt, budget; unknown keys are errors."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    take = {"run": {"run_id", "split", "levels", "limit_per_level", "seed"}, "model": {"model_snapshot_id", "score_source", "decoding"}, "prompt": {"prompt"}, "budget": {"max_requests", "usd_per_million"}}
    flat: dict = {}
    for table, values in raw.items():
        if table not in take or set(values) - take[table]:
            raise ValueError(f"unknown settings in [{table}]: {sorted(set(values) - take.get(table, set()))}")
        flat |= values
    if "levels" in flat:
        flat["levels"] = tuple(flat["levels"])
    return RunConfig(**flat)

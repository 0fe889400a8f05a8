"""Files: strict JSON lines and CSV, write-once artifacts, fingerprints, the run lock and TOML settings.

Tables go through Spark readers and writers; single small artifacts (manifests, models, settings) are
written by the driver with a temporary file and a rename.
"""

from __future__ import annotations

import csv
import fcntl
import hashlib
import io
import json
import os
import tempfile
import tomllib
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidra.functions.text import canonical_json


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, value`` (variant) of every line of JSON-lines files, gzip included. Blank lines and lines that are no object are errors."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    parsed = lines.select("file", "line", F.try_parse_json("line").alias("value"))
    sound = F.col("value").isNotNull() & F.schema_of_variant("value").startswith("OBJECT")
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), F.substring("line", 1, 80))))
    return parsed.select("file", checked.alias("value"))


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; a malformed line is an error, unknown keys are ignored, missing ones are null."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def tolerant_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, reason``: lines with ``malformed_json`` or ``non_object_row`` where they cannot be used, else null."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    v = F.try_parse_json("line")
    return t.withColumn("reason", F.when(v.isNull(), "malformed_json").when(~F.schema_of_variant(v).startswith("OBJECT"), "non_object_row"))


def write_json_lines(rows: Iterable[Mapping], path: str | Path) -> None:
    """A small table as JSON lines with sorted keys, all or nothing; a row that is no mapping leaves the old file alone."""

    def lines() -> Iterator[str]:
        for r in rows:
            if not isinstance(r, Mapping):
                raise TypeError("rows must be mappings")
            yield json.dumps(dict(r), sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n"

    _replace(Path(path), lines())


def write_single_json_lines(df: DataFrame, path: str | Path) -> None:
    """A DataFrame as one JSON-lines file, streamed through the driver partition by partition."""
    write_json_lines((r.asDict(recursive=True) for r in df.toLocalIterator()), path)


def _replace(path: Path, parts: Iterable[str]) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as out:
            out.writelines(parts)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def freeze_text(path: str | Path, text: str) -> None:
    """Write once: an identical rewrite is accepted, a different one raises."""
    path = Path(path)
    if path.exists():
        if path.read_text(encoding="utf-8") != text:
            raise FileExistsError(f"{path} is frozen with other content")
        return
    _replace(path, [text])


def freeze_json(path: str | Path, value: object) -> None:
    """:func:`freeze_text` of indented JSON with sorted keys."""
    freeze_text(path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n")


def freeze_csv(path: str | Path, rows: Iterable[Mapping], fields: list[str]) -> None:
    """:func:`freeze_text` of a small CSV with a fixed column order."""
    out = io.StringIO()
    w = csv.DictWriter(out, fields, lineterminator="\n", extrasaction="raise")
    w.writeheader()
    w.writerows(rows)
    freeze_text(path, out.getvalue())


def read_csv_strings(spark: SparkSession, path: str, sep: str = ",", required: list[str] | None = None) -> DataFrame:
    """CSV with a header, every cell a string and empty cells empty rather than null; long cells and quoted line ends allowed."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, multiLine=True, maxCharsPerColumn=-1, escape='"', nullValue=None)
    df = df.toDF(*[c.removeprefix("\ufeff") for c in df.columns]).na.fill("")
    missing = [c for c in required or [] if c not in df.columns]
    if missing:
        raise KeyError(f"{path} lacks the columns {missing}")
    return df


def append_rows(df: DataFrame, path: str) -> None:
    """Append to the JSON-lines log folder; every call adds files and touches none."""
    df.write.mode("append").json(path)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256, md5`` of files."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def sha256_file(path: str | Path) -> str:
    """Digest of one local file, read in blocks."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def verify_file(path: str | Path, spec: Mapping) -> None:
    """Check a local file against ``max_bytes``, ``bytes`` and ``sha256`` of its registry entry, as far as they are given."""
    size = Path(path).stat().st_size
    if "max_bytes" in spec and size > spec["max_bytes"]:
        raise ValueError(f"{path} has {size} bytes, more than the cap of {spec['max_bytes']}")
    if "bytes" in spec and size != spec["bytes"]:
        raise ValueError(f"{path} has {size} bytes instead of {spec['bytes']}")
    if spec.get("sha256") and sha256_file(path) != spec["sha256"].lower():
        raise ValueError(f"{path} does not have the registered digest")


def load_registry(path: str | Path) -> dict[str, dict]:
    """Source entries by id from a TOML file with ``[[sources]]``; each needs id, kind and license, ids are unique."""
    entries = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("sources", [])
    out: dict[str, dict] = {}
    for e in entries:
        for k in ("id", "kind", "license"):
            if not str(e.get(k, "")).strip():
                raise ValueError(f"a source lacks {k}")
        if e["id"] in out:
            raise ValueError(f"source {e['id']} is registered twice")
        out[e["id"]] = dict(e)
    return out


def accept_source(spec: Mapping, path: str | Path, accepted_licenses: set[str]) -> Path:
    """The license gate and verification for a file that is already here; nothing is ever downloaded."""
    if spec["license"] not in accepted_licenses:
        raise PermissionError(f"license {spec['license']} of {spec['id']} has not been accepted")
    verify_file(path, spec)
    return Path(path)


def content_hash(value: object) -> str:
    """SHA-256 of the canonical JSON of a value."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@contextmanager
def run_lock(folder: str | Path) -> Iterator[None]:
    """Exclusive use of a run folder by one process; raises at once if another holds it."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    with open(Path(folder) / ".lock", "a+") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise BlockingIOError(f"{folder} is in use by another run") from e
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)

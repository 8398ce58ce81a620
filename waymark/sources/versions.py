"""Publication in order: new tables go to folders of their own, and one small manifest, written last, makes them the current version.

A reader sees the tables that the newest manifest names, and so always a whole version; a writer that fails leaves the earlier one in place. The
baseline is written only after the dataset, so that it can never describe data that were not published.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

from ..operators import snapshot
from .sinks import UnsafePublication

_DIGITS = 12


class Conflict(Exception):
    """Another writer has published in the meantime."""


@dataclass(frozen=True)
class Version:
    number: int
    tables: dict[str, str]  # name to folder
    notes: dict = field(default_factory=dict)  # what the writer wants to find again


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, root: str) -> list[str]:
    at, files = _path(spark, f"{root}/manifests")
    return sorted(s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().endswith(".json")) if files.exists(at) else []


def current(spark: SparkSession, root: str) -> Version | None:
    """The newest version, or None before the first."""
    names = _manifests(spark, root)
    return _version(spark, root, names[-1]) if names else None


def _version(spark: SparkSession, root: str, name: str) -> Version:
    text = spark.read.text(f"{root}/manifests/{name}", wholetext=True).first()[0]
    said = json.loads(text)
    return Version(int(name.removesuffix(".json")), said["tables"], said["notes"])


def read(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """A table of the newest version, or None if that has none of this name."""
    version = current(spark, root)
    return spark.read.parquet(f"{root}/{version.tables[table]}") if version and table in version.tables else None


def commit(spark: SparkSession, root: str, tables: list[tuple[str, DataFrame]], notes: dict | None = None) -> Version:
    """Write the tables one after another, then a manifest that names them and keeps the other tables and notes of the version before.

    The manifest appears under its number by a rename that fails if there already is one: of two writers one gets a Conflict.
    Tables may be computed from those of the version before, which stay where they are.
    """
    before = current(spark, root)
    number, held = (before.number + 1, dict(before.tables)) if before else (1, {})
    told = {**(before.notes if before else {}), **(notes or {})}
    for name, rows in tables:
        folder = f"tables/{number:0{_DIGITS}d}-{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{root}/{folder}")
        held[name] = folder
    at, files = _path(spark, f"{root}/manifests/{number:0{_DIGITS}d}.json")
    draft, _ = _path(spark, f"{root}/manifests/.{uuid.uuid4().hex}.tmp")
    out = files.create(draft, False)
    try:
        out.write(bytearray(json.dumps({"tables": held, "notes": told}, sort_keys=True).encode()))
    finally:
        out.close()
    if files.exists(at) or not files.rename(draft, at):
        files.delete(draft, False)
        raise Conflict(f"version {number} of {root} is taken")
    return Version(number, held, told)


def publish(after: DataFrame, diff: DataFrame, root: str, baseline: DataFrame | None = None, baseline_changed: bool = False, allow: bool = False) -> Row:
    """Publish a dataset whose difference from the one before is safe and means something, and behind it its baseline; the summary either way.

    A difference without meaning leaves the dataset as it is, so that its version tells when the data last moved; a baseline that changed is then
    published alone. Only the one-row summary comes to the driver.
    """
    summary = snapshot.summary(diff).first()
    if not allow and (summary.too_many_removed or summary.too_many_added):
        raise UnsafePublication(f"{summary.removed} removed and {summary.added} added of {summary.previous}")
    first = current(after.sparkSession, root) is None
    tables = [("dataset", after)] if summary.meaningful or first else []
    if baseline is not None and (baseline_changed or tables):
        tables.append(("baseline", baseline))
    if tables:
        commit(after.sparkSession, root, tables)
    return summary


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete manifests but the newest `keep`, and every table folder that none of those names; the folders deleted.

    Not to be run beside a writer, whose tables no manifest names yet.
    """
    names = _manifests(spark, root)
    kept = {folder for n in names[-keep:] for folder in _version(spark, root, n).tables.values()}
    for name in names[:-keep]:
        at, files = _path(spark, f"{root}/manifests/{name}")
        files.delete(at, False)
    at, files = _path(spark, f"{root}/tables")
    gone = [f"tables/{s.getPath().getName()}" for s in files.listStatus(at)] if files.exists(at) else []
    gone = sorted(set(gone) - kept)
    for folder in gone:
        files.delete(_path(spark, f"{root}/{folder}")[0], True)
    return gone

"""A gate on what a query would read: the size of its file scans after pruning, from its plan, before anything runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


class TooExpensive(Exception):
    """A query would read more than it may."""


@dataclass(frozen=True)
class Scan:
    columns: tuple[str, ...]
    files: int
    bytes: int


def scans(df: DataFrame) -> list[Scan]:
    """The file scans of the planned query, those of its subqueries included.

    Only files of partitions that pass the filters on partition columns count, and of their bytes the share of the columns that are read, by the
    planner's width of each type; Parquet keeps columns apart. Filters within files are not foreseen, so that a scan reads at most as much.
    """
    found, open_, seen = [], [df._jdf.queryExecution().executedPlan()], set()
    while open_:
        node = open_.pop()
        if node.id() in seen:  # a subquery stands in the filter and in the scan below it
            continue
        seen.add(node.id())
        kind = node.getClass().getSimpleName()
        for part in (node.children(), node.subqueries()):
            open_ += [part.apply(i) for i in range(part.size())]
        if kind == "AdaptiveSparkPlanExec":
            open_.append(node.initialPlan())
        elif kind == "FileSourceScanExec":
            files, wanted = node.selectedPartitions(), node.requiredSchema()
            width = max(1, node.relation().dataSchema().defaultSize())
            found.append(Scan(tuple(wanted.fieldNames()), files.totalNumberOfFiles(), int(files.totalFileSize() * min(1.0, wanted.defaultSize() / width))))
    return found


def estimated_bytes(df: DataFrame) -> int:
    return sum(s.bytes for s in scans(df))


def within(df: DataFrame, most: int) -> DataFrame:
    """The same query, unless it would read more than `most` bytes; then it fails, with nothing read."""
    found = scans(df)
    total = sum(s.bytes for s in found)
    if total > most:
        raise TooExpensive(f"{total} bytes of {sum(s.files for s in found)} files, {most} are allowed")
    return df

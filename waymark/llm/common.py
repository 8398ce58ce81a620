"""What the training-data operators share: tables, intermediate storage and Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.storage import materialise, shared_dir

__all__ = ["WORD", "materialise", "pieces", "shared_dir", "small_batches", "table", "utf8", "with_columns"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch; with whole texts in the rows, Spark's default of 10,000 rows can be gigabytes.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers, for the session: at most BATCH_ROWS rows and about BATCH_BYTES, or one row.

    Smaller bounds that the session already has stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(re.sub("[^0-9-]", "", spark.conf.get(key))) <= most:
            spark.conf.set(key, str(most))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece have about `most` bytes, or are one text."""
    for batch in batches:
        at, n, total = 0, 0, 0
        for size in pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist():
            if n and total + size > most:
                yield batch.slice(at, n)
                at, n, total = at + n, 0, 0
            n, total = n + 1, total + size
        if n:
            yield batch.slice(at, n)


def with_columns(docs: DataFrame, text_col: str, added: str, compute: Callable[[list[bytes]], list[pa.Array]]) -> DataFrame:
    """docs with the columns of the DDL `added`, which compute(texts) gives; columns of these names are replaced.

    compute sees a null text as an empty one; a new text column is null where the old one was.
    """
    small_batches(docs.sparkSession)
    new = T.StructType.fromDDL(added).fields
    given = docs.drop(*[f.name for f in new if f.name != text_col])
    names = [f.name for f in given.schema.fields]
    schema = T.StructType([f for f in given.schema.fields if f.name not in {n.name for n in new}] + new)
    at, kept = names.index(text_col), [i for i, n in enumerate(names) if n not in {f.name for f in new}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces([batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])], f"c{at}"):
                made = compute(utf8(piece.column(at)))
                made = [pc.if_else(piece.column(at).is_null(), None, m) if f.name == text_col else m for f, m in zip(new, made)]
                columns = [piece.column(i) for i in kept] + made
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return given.mapInArrow(run, schema)

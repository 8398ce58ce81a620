"""Concatenate and cut: documents become sequences of a fixed number of tokens.

The first pass tokenises each document once, writes its ids and its start within its partition, and adds up the
partition's tokens. Prefix sums over these totals give each partition's global offset. The second pass
cuts the documents at every multiple of the sequence length; a document that crosses one gets a boundary record, one
piece for each sequence that it touches. Only the last sequence of all is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pieces, small_batches, utf8
from .tokens import encoder

LENGTH, END = 4096, 2
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenised(docs: DataFrame, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, local, n, ids): ids with the end token, packed, and the tokens before it in its partition."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        tail = np.array([end], encode.dtype).tobytes()
        for batch in pieces(batches, "text"):
            ids = [encode.encode(t) + tail for t in utf8(batch.column(1))]
            sizes = np.array([len(x) for x in ids], np.int64) // encode.dtype.itemsize
            local = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            columns = [batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(local), pa.array(sizes), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "part", "local", "n", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, part int, local long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless with_ids is false, its ids (uint32).

    A null or empty text is the end token alone. Rows with equal ids are packed one by one. An empty table gives no
    piece. Other columns are ignored. The order of the sequences follows the table's partitions.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    width = encoder(tokenizer).dtype
    tokens = materialise(tokenised(docs, tokenizer, end, id_col, text_col), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row of two numbers for each partition of the input, so that this window and the broadcast stay small
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").select("id", (F.col("base") + F.col("local")).alias("first"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, first, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids, at = np.frombuffer(packed, width).astype("<u4"), 0
                while at < len(ids):
                    sequence, offset = divmod(first + at, length)
                    own = ids[at : at + length - offset].tobytes()
                    rows.append((key, at, len(own) // 4, zlib.crc32(own), len(ids), sequence, offset, own if with_ids else None))
                    at += length - offset
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field(0).type), *[pa.array(c, pa.int64()) for c in columns[1:7]], pa.array(columns[7], pa.binary())],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    found = placed.mapInArrow(run, f"id {kind}, {PIECES}")
    return found if with_ids else found.drop("ids")

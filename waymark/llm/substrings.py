"""Substring dedup by relative Lempel-Ziv parsing: the reference of a document is every document that comes before, and its own beginning.

Reference blocks are cut by content: of each window of `length` words, the least hash among its runs of ANCHOR words is
the anchor, and the windows that share an anchor make a block. Equal windows have equal anchors, so whatever a document
repeats lies in blocks whose anchor other documents have too. The index holds (anchor, whole block) with the earliest document
and place where it stands.

The parse goes through a document from left to right. A block that the index knows starts a factor (source, start, words) or, if it goes on
where the last factor's source goes on, extends it, so that a factor is as long as it agrees with its source. Where the parse of whole blocks
ends, a factor may still begin or end within the block: the windows of such a boundary block are looked up one by one and extend the
factors beside them. Factors have at least `length` words; those from different sources may overlap by up to length - 1. All words that factors
cover are duplicate spans.

Only anchors that two documents share, and only the first document of each distinct block, take part in the later steps,
so that a passage with any number of copies costs one block. Occurrences within one document need no index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Words, grams, hashes, mixed, split
from .common import materialise, pieces, small_batches, utf8

LENGTH, ANCHOR = 20, 8
_BASE = np.uint64(0xD6E8FEB86659FD93)


class Parsed:
    """The windows and blocks of a few texts; window i starts at word at[i] of all the texts' words."""

    def __init__(self, texts: list[bytes], length: int):
        self.words: Words = split(texts)
        self.length = length
        word_hash = hashes(self.words)
        n = max(0, len(word_hash) - length + 1)
        owner = np.repeat(np.arange(len(texts)), self.words.count)
        self.at = np.flatnonzero(owner[:n] == owner[length - 1 :][:n]) if n else np.zeros(0, np.int64)
        self.owner = owner[self.at]
        self.place = self.at - self.words.first[self.owner]
        self.first, self.second = grams(word_hash, length, 1)[self.at], grams(word_hash, length, 2)[self.at]
        runs = min(ANCHOR, length)
        run_hash = grams(word_hash, runs)
        least = sliding_window_view(run_hash, length - runs + 1).argmin(1) if n else np.zeros(0, np.int64)
        anchor_at = self.at + least[self.at]
        # a block ends where the anchor or the text changes
        new = np.ones(len(self.at), bool)
        new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (self.owner[1:] != self.owner[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(self.at)))
        self.block = np.cumsum(new) - 1
        self.block_place = self.place[begin]
        self.block_owner = self.owner[begin]
        self.anchor = run_hash[anchor_at[begin]].view(np.int64) if n else np.zeros(0, np.int64)
        power = np.cumprod(np.full(len(word_hash) + 1, _BASE))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hash * power[: len(word_hash)])])
        inverse = np.cumprod(np.full(len(word_hash) + 1, np.uint64(pow(int(_BASE), -1, 2**64))))
        a, b = self.at[begin], self.at[begin] + size + length - 1
        self.whole = mixed((total[b] - total[a]) * inverse[a] + size.astype(np.uint64) * _BASE).view(np.int64)

    def keys(self, owner: np.ndarray, *values: np.ndarray) -> np.ndarray:
        """One number for a text and hashes of it."""
        key = mixed(owner.astype(np.uint64) + np.uint64(1))
        for v in values:
            key = mixed(key ^ v.view(np.uint64)) + v.view(np.uint64)
        return key

    def block_keys(self) -> np.ndarray:
        return self.keys(self.block_owner, self.anchor, self.whole)

    def window_keys(self) -> np.ndarray:
        return self.keys(self.owner, self.first, self.second)

    def again(self) -> np.ndarray:
        """Where in its own text the first window with the same words stands, or -1 for that window itself."""
        order = np.lexsort((self.at, self.second, self.first, self.owner))
        same = np.ones(len(order), bool)
        same[:1] = False
        for x in (self.owner, self.first, self.second):
            same[1:] &= x[order][1:] == x[order][:-1]
        leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        out = np.full(len(order), -1)
        out[order] = np.where(same, self.place[order][leader], -1)
        return out


def _listed(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray], pa.Array]:
    """A column of arrays of structs: each struct's row, fields of longs as numpy, and the field `source` as it is."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(sizes)), sizes), [np.asarray(flat.field(f)).astype(np.int64) for f in fields], flat.field("source")


def _places(wanted: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key among `wanted`, or -1."""
    if not len(wanted):
        return np.full(len(keys), -1)
    order = np.argsort(wanted)
    at = order[np.minimum(np.searchsorted(wanted, keys, sorter=order), len(wanted) - 1)]
    return np.where(wanted[at] == keys, at, -1)


def _factors(p: Parsed, blocks: tuple, windows: tuple) -> tuple[list[np.ndarray], pa.Array]:
    """Factors of a few texts as text, place, number of the source, start and words; and the sources. Numbers beyond them are the text itself."""
    (block_row, (anchor, whole, block_start), block_source), (window_row, (first, second, window_start), window_source) = blocks, windows
    named = pa.concat_arrays([block_source, window_source]).dictionary_encode()
    code = np.asarray(named.indices).astype(np.int64)
    # each window's source and where it starts there: an earlier block or window, or else an earlier place of the same text
    start = p.again()
    source = np.where(start < 0, -1, len(named.dictionary) + p.owner)
    at = _places(p.keys(window_row, first, second), p.window_keys())
    hit = at >= 0
    source[hit], start[hit] = code[len(block_source) :][at[hit]], window_start[at[hit]]
    at = _places(p.keys(block_row, anchor, whole), p.block_keys())[p.block]
    hit = np.flatnonzero(at >= 0)
    source[hit], start[hit] = code[: len(block_source)][at[hit]], block_start[at[hit]] + p.place[hit] - p.block_place[p.block[hit]]
    repeated = np.flatnonzero(source >= 0)
    goes_on = np.zeros(len(repeated), bool)
    goes_on[1:] = True
    for x, step in ((p.at, 1), (p.owner, 0), (source, 0), (start, 1)):
        goes_on[1:] &= x[repeated][1:] == x[repeated][:-1] + step
    begin = np.flatnonzero(~goes_on)
    size = np.diff(np.append(begin, len(repeated))) + p.length - 1
    begin = repeated[begin]
    return [p.owner[begin], p.place[begin], source[begin], start[begin], size], named.dictionary


def deduplicated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept, spans, factors): each text without the words that an earlier window of `length` words covers.

    A window repeats if its words also start earlier: in a document of smaller id, or earlier in the same one. kept is the
    other words joined by single spaces; spans are the removed runs as (first word, words); factors are (first word, source id, first word
    there, words), each verbatim in its source. Null and blank texts have no words. Rows with equal ids are not earlier than each other; a row
    without an id is neither changed nor a source, but for what it repeats itself. Other columns are ignored, and an empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            p = Parsed(utf8(batch.column(1)), length)
            _, own = np.unique(p.block_keys(), return_index=True)
            ids = batch.column(0).take(pa.array(p.block_owner[own]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(p.anchor[own]), pa.array(p.whole[own]), pa.array(p.block_place[own])], ["id", "anchor", "whole", "start"])

    def boundary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            p = Parsed(utf8(batch.column(1)), length)
            row, (anchor, whole), _ = _listed(batch.column(2), "anchor", "whole")
            wanted = (_places(p.keys(row, anchor, whole), p.block_keys()) >= 0)[p.block] & (p.again() < 0)
            ids = batch.column(0).take(pa.array(p.owner[wanted]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(p.first[wanted].view(np.int64)), pa.array(p.second[wanted].view(np.int64)), pa.array(p.place[wanted])], ["id", "first", "second", "start"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ids, p = batch.column(0), Parsed(utf8(batch.column(1)), length)
            (owner, place, source, start, size), sources = _factors(p, _listed(batch.column(2), "anchor", "whole", "start"), _listed(batch.column(3), "first", "second", "start"))
            named = pa.concat_arrays([sources, ids]).take(pa.array(source))
            made = pa.StructArray.from_arrays([pa.array(place), named, pa.array(start), pa.array(size)], ["at", "source", "start", "words"])
            factors = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)), made)
            n = len(p.words.start)
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, p.words.first[owner] + place, 1)
            np.add.at(cover, p.words.first[owner] + place + size, -1)
            gone = np.cumsum(cover)[:n] > 0
            data, columns, at = p.words.data.tobytes(), ([], [], [], []), 0
            for count in p.words.count.tolist():
                own = gone[at : at + count]
                stay = np.flatnonzero(~own) + at
                kept = b" ".join([data[a:b] for a, b in zip(p.words.start[stay].tolist(), p.words.end[stay].tolist())])
                edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                spans = [{"start": a, "words": b - a} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]
                for out, value in zip(columns, (count, int(own.sum()), kept, spans)):
                    out.append(value)
                at += count
            types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, types)], factors], ["id", "n_words", "n_removed", "kept", "spans", "factors"])

    # blocks of each document, of which only those with an anchor that two documents share are indexed
    blocks = materialise(texts.where("id IS NOT NULL").mapInArrow(index, f"id {kind}, anchor long, whole long, start long"), "blocks")
    shared = blocks.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    indexed = materialise(blocks.join(shared, "anchor"), "index")
    sources = indexed.groupBy("anchor", "whole").agg(F.min(F.struct(F.col("id").alias("source"), "start")).alias("earliest"))
    kinds = sources.groupBy("anchor").agg(F.count("*").alias("kinds"))
    looked_up = indexed.drop("start").join(sources, ["anchor", "whole"]).join(kinds, "anchor")
    copied, unsure = F.col("earliest.source") < F.col("id"), F.col("kinds") > 1
    state = looked_up.select("id", F.struct("anchor", "whole", "earliest.source", "earliest.start").alias("key"), copied.alias("copied"), unsure.alias("unsure"))
    state = materialise(state.where("copied OR unsure"), "parse")

    # whole blocks are copied; at the boundaries, windows of a block's first document are looked up one by one
    open_blocks = state.where("unsure AND NOT copied").groupBy("id").agg(F.collect_list("key").alias("keys"))
    windows = materialise(texts.join(open_blocks, "id").mapInArrow(boundary, f"id {kind}, first long, second long, start long"), "windows")
    earliest = windows.groupBy("first", "second").agg(F.min(F.struct(F.col("id").alias("source"), "start")).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = windows.drop("start").join(earliest, ["first", "second"]).where(F.col("earliest.source") < F.col("id"))
    by_window = found.groupBy("id").agg(F.collect_list(F.struct("first", "second", "earliest.source", "earliest.start")).alias("windows"))
    by_block = state.where("copied").groupBy("id").agg(F.collect_list("key").alias("blocks"))
    marked = by_block.join(by_window, "id", "full")
    joined = texts.join(marked, "id", "left").select("id", "text", "blocks", "windows")
    factors = f"array<struct<at:long,source:{kind},start:long,words:long>>"
    return joined.mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept binary, spans array<struct<start:long,words:long>>, factors {factors}")

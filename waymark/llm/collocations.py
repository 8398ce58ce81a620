"""Phrase collocation mining: exact counts of frequent phrases through a minimal perfect hash, and the cut that explains each least.

Candidates are Apriori-safe: a phrase of k words is looked at only where its first and its last k - 1 words are candidates themselves. Level by
level, mappers sum hashes of such phrases, and those whose hash occurs often enough go on; equal hashes of different phrases can
only add candidates. Each candidate is spelled out from the texts whose 16-bit hash is its least, so that not every mapper sends it; if the
counts of what was spelled do not add up to a hash's own, all texts are asked for it. The phrases of all levels then get a minimal perfect hash, built shard by shard in tasks: of each level of bits, keys that
have a bit to themselves keep it and the rest go to the next, and a key's slot is the number of bits before its own. A slot stores its
128-bit key, which every lookup is checked against. Mappers count phrases by slot with bincount, a tree sums their arrays,
and the parts of each cut are read by slot as well.

A table that is sent to the mappers has about ROUND keys (ROUND_SHARDS shards of SHARD keys on average); with more candidates, the corpus is
read once more for every further table, so that memory stays bounded and no candidate is left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import mixed
from .common import materialise, pieces, small_batches, utf8

LONGEST = 5
#: Keys of a shard on average, and shards of a table that is sent to the mappers.
SHARD, ROUND_SHARDS = 1 << 15, 128
#: Slots of one array of counts on its way, and how many arrays are summed at a step of the tree.
BLOCK, FAN = 1 << 14, 16
#: Hashes that a mapper sums before it hands them on.
BUFFER = 1 << 21

_STEP, _BASE, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: 0 within a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


# -- words and keys --------------------------------------------------------------------------------------------------------


@cache
def seed_of(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Tokens:
    """The words of some texts, A-Z in lower case, with the piece that each stands in and keys of the phrases that start at each."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.text = b"\n".join([*texts, b""]).lower()
        data = np.frombuffer(self.text, np.uint8)
        kind = _KIND[data]
        edge = np.flatnonzero(np.diff(kind > 0, prepend=True, append=True))
        self.start, self.end = edge[0::2], edge[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[self.start]
        bounds = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.count = np.diff(np.searchsorted(self.start, bounds), prepend=0)
        self.seed = np.repeat(np.array([seed_of(x) for x in langs], np.uint64), self.count)
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.owner = np.repeat(np.arange(len(texts)), self.count)
        self.mark = np.repeat(np.array([zlib.crc32(t) & 0xFFFF for t in texts], np.int64), self.count)
        self.lanes: dict[int, list[np.ndarray]] = {}

    def words(self, lane: int) -> np.ndarray:
        """A 64-bit hash of each word, from 8 bytes at a time."""
        eight = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        at, left = self.start.copy(), self.end - self.start
        out = mixed(left.astype(np.uint64) * _STEP + np.uint64(lane))
        live = np.arange(len(at))
        while len(live):
            cut = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
            part = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - cut))
            out[live] = mixed((out[live] ^ part) * _STEP)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return out

    def fits(self, k: int) -> np.ndarray:
        """Where k words of one piece start."""
        n = max(0, len(self.start) - k + 1)
        return self.piece[:n] == self.piece[k - 1 :][:n]

    def keys(self, k: int, lane: int) -> np.ndarray:
        """A hash of language and phrase of each k words in a row; lanes 1 and 2 are independent."""
        rows = self.lanes.setdefault(lane, [self.words(lane)])
        while len(rows) < k:
            last, n = rows[-1], max(0, len(self.start) - len(rows))
            rows.append(last[:n] * (_BASE if lane == 1 else _OTHER) + rows[0][len(rows) :][:n])
        return mixed((rows[k - 1] ^ mixed(self.seed[: len(rows[k - 1])] + np.uint64(k))) * _STEP)

    def phrase(self, i: int, k: int) -> str:
        return b" ".join([self.text[self.start[j] : self.end[j]] for j in range(i, i + k)]).decode("utf-8", "replace")


def scan(docs: DataFrame, schema: str, made: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """A pass over (lang, text): made() gives a task's functions of Tokens and languages, and of nothing at the end; both yield lists of arrays."""
    small_batches(docs.sparkSession)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, rest = made()
        for piece in pieces(batches, "text"):
            langs = piece.column(0).to_pylist()
            for arrays in each(Tokens(utf8(piece.column(1)), langs), langs):
                yield pa.RecordBatch.from_arrays(arrays, names)
        for arrays in rest():
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, schema)


# -- minimal perfect hash ------------------------------------------------------------------------------------------------------


def _places(a: np.ndarray, b: np.ndarray | None, level: int, size: np.ndarray) -> np.ndarray:
    h = mixed(a + np.uint64(level + 1) * _STEP)
    if b is not None:
        h = h + mixed((b ^ np.uint64(level + 1)) * _OTHER)
    return (mixed(h) % size.astype(np.uint64)).astype(np.int64)


def build(a: np.ndarray, b: np.ndarray | None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, all bits as 64-bit words, the keys' order by slot) for distinct keys."""
    sizes, bits, order, live = [], [], [], np.arange(len(a))
    while len(live):
        if len(sizes) > 60:
            raise ValueError("keys are not distinct")
        size = -(-2 * len(live) // 64) * 64
        place = _places(a[live], None if b is None else b[live], len(sizes), np.full(len(live), size))
        times = np.bincount(place, minlength=size)
        alone = times[place] == 1
        bits.append(np.packbits(times == 1, bitorder="little").view("<u8"))
        order.append(live[alone][np.argsort(place[alone])])
        sizes.append(size)
        live = live[~alone]
    none = np.zeros(0, np.int64)
    return sizes, np.concatenate([np.zeros(0, "<u8"), *bits]), np.concatenate([none, *order])


class Table:
    """The shards first, first + 1 ... of `shards`, as one minimal perfect hash: find() gives slots 0 to len - 1, or -1 for other keys."""

    def __init__(self, first: int, shards: int, built: list[tuple[list[int], bytes, bytes, bytes, bytes]]):
        self.first, self.shards, self.held = first, shards, len(built)
        levels = max((len(s) for s, *_ in built), default=0)
        self.sizes = np.zeros((len(built), levels + 1), np.int64)
        for i, (s, *_) in enumerate(built):
            self.sizes[i, : len(s)] = s
        upto = np.cumsum(self.sizes.ravel() // 64)
        self.offsets = (upto - self.sizes.ravel() // 64).reshape(self.sizes.shape)
        join = lambda i: np.frombuffer(b"".join(x[i] for x in built), "<u8")
        self.words, self.a, self.b, self.mark = join(1), join(2), join(3), join(4).view("<i8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones
        self.hint = np.zeros(1 << 22, bool)
        self.hint[(self.a & np.uint64(len(self.hint) - 1)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.a)

    def covers(self, a: np.ndarray) -> np.ndarray:
        return (shard_of(a, self.shards) - self.first).view(np.uint64) < self.held

    def find(self, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        live = np.flatnonzero(self.hint[(a & np.uint64(len(self.hint) - 1)).astype(np.int64)])
        if self.held < self.shards:
            live = live[self.covers(a[live])]
        shard = shard_of(a[live], self.shards) - self.first
        for level in range(self.sizes.shape[1]):
            size = self.sizes[shard, level]
            live, shard, size = live[size > 0], shard[size > 0], size[size > 0]
            if not len(live):
                break
            place = _places(a[live], None if b is None else b[live], level, size)
            word, bit = self.offsets[shard, level] + (place >> 6), (place & 63).astype(np.uint64)
            held = self.words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            out[live[hit]] = self.ranks[word[hit]] + np.bitwise_count(held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            live, shard = live[~hit], shard[~hit]
        own = np.flatnonzero(out >= 0)
        same = self.a[out[own]] == a[own]
        if b is not None and len(own):
            same &= self.b[out[own]] == b[own]
        out[own[~same]] = -1
        return out


def shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return ((a >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def tables(keys: DataFrame) -> Iterator[tuple[int, object]]:
    """(slots before, broadcast Table) of distinct keys (a) or (a, b), with marks if there are any, built in tasks and sent a bounded number of shards at a time."""
    spark, two, marked = keys.sparkSession, "b" in keys.columns, "mark" in keys.columns
    shards = max(1, -(-keys.count() // SHARD))
    if shards > 1 << 24:
        raise ValueError("more than 2^39 candidates")
    shard = F.shiftright(F.shiftrightunsigned("a", 40) * shards, 24)
    own = F.collect_list(F.struct("a", *["b"] * two, *["mark"] * marked))
    grouped = keys.groupBy(shard.cast("int").alias("shard")).agg(own.alias("own"))
    names = ["shard", "sizes", "words", "a", "b", "mark"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column("own")[i].values
                a, b = (np.asarray(keys.field(c)).view(np.uint64) if c == "a" or two else None for c in "ab")
                sizes, words, order = build(a, b)
                mark = np.asarray(keys.field("mark"))[order].tobytes() if marked else b""
                made = [batch.column("shard")[i].as_py(), sizes, words.tobytes(), a[order].tobytes(), b[order].tobytes() if two else b"", mark]
                yield pa.RecordBatch.from_arrays([pa.array([m], t) for m, t in zip(made, (pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4))], names)

    small_batches(spark)
    built = materialise(grouped.mapInArrow(run, "shard int, sizes array<long>, words binary, a binary, b binary, mark binary"), "shards")
    slots = 0
    for first in range(0, shards, ROUND_SHARDS):
        held = min(ROUND_SHARDS, shards - first)
        rows = {r.shard: (r.sizes, bytes(r.words), bytes(r.a), bytes(r.b), bytes(r.mark)) for r in built.where(F.col("shard").between(first, first + held - 1)).collect()}
        table = Table(first, shards, [rows.get(first + i, ([], b"", b"", b"", b"")) for i in range(held)])
        yield slots, spark.sparkContext.broadcast(table)
        slots += len(table)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


# -- passes over the corpus ------------------------------------------------------------------------------------------------------


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def hashed(docs: DataFrame, k: int, found: object = None) -> DataFrame:
    """(a, lang, c, mark): sums of equal keys of k words in a row whose first and last k - 1 are in the table, and the least mark of their texts; for k = 1 also each language's words, where a is null.

    With several tables a phrase belongs to that of its first words; its last words are not looked at if they belong to another.
    """

    def made():
        held: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        totals: dict[str, int] = {}

        def summed():
            if not held:
                return
            every, mark = np.concatenate(held), np.concatenate(marks)
            held.clear()
            marks.clear()
            order = np.argsort(every)
            every, mark = every[order], mark[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
            a, c, least = every[first], np.diff(np.append(first, len(every))), np.minimum.reduceat(mark, first) if len(first) else mark
            for at in range(0, len(a), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield [_longs(a[part]), pa.nulls(len(a[part]), pa.string()), _longs(c[part]), _longs(least[part])]

        def each(tokens: Tokens, langs: list[str]):
            here = tokens.fits(k)
            if found is None:
                for lang, n in zip(langs, tokens.count.tolist()):
                    totals[lang] = totals.get(lang, 0) + n
            else:
                table, shorter = found.value, tokens.keys(k - 1, 1)
                slots = np.full(len(shorter), -1)
                use = np.flatnonzero(tokens.fits(k - 1))
                slots[use] = table.find(shorter[use])
                at = np.flatnonzero(here & (slots[: len(here)] >= 0))
                at = at[(slots[at + 1] >= 0) | ~table.covers(shorter[at + 1])]
                here = at
            held.append(tokens.keys(k, 1)[here])
            marks.append(tokens.mark[: len(tokens.fits(k))][here])
            if sum(map(len, held)) > BUFFER:
                yield from summed()
            if len(totals) > 10_000:
                yield from counted()

        def counted():
            yield [pa.nulls(len(totals), pa.int64()), pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64()), pa.nulls(len(totals), pa.int64())]
            totals.clear()

        def rest():
            yield from summed()
            yield from counted()

        return each, rest

    return scan(docs, "a long, lang string, c long, mark long", made)


def spelled(docs: DataFrame, found: object, longest: int) -> DataFrame:
    """(a, b, lang, phrase, n): the phrases whose keys are in the table, from texts that bear the key's mark, or from all if it is below 0."""

    def made():
        table = found.value
        seen, other = np.zeros(len(table), bool), np.zeros(len(table), np.uint64)

        def each(tokens: Tokens, langs: list[str]):
            for k in range(1, longest + 1):
                at = np.flatnonzero(tokens.fits(k))
                a = tokens.keys(k, 1)[at]
                slot = table.find(a)
                own = (slot >= 0) & ((table.mark[slot] == tokens.mark[at]) | (table.mark[slot] < 0)) if len(table) else slot >= 0
                at, a, slot = at[own], a[own], slot[own]
                b = tokens.keys(k, 2)[at]
                new = np.flatnonzero(~seen[slot] | (other[slot] != b))
                new = new[np.unique(np.stack([a[new], b[new]]), axis=1, return_index=True)[1]] if len(new) else new
                seen[slot[new]], other[slot[new]] = True, b[new]
                at = at[new].tolist()
                yield [_longs(a[new]), _longs(b[new]), pa.array([langs[tokens.owner[i]] for i in at], pa.string()), pa.array([tokens.phrase(i, k) for i in at], pa.string()), pa.array([k] * len(at), pa.int32())]

        return each, lambda: ()

    return scan(docs, "a long, b long, lang string, phrase string, n int", made)


def counts(docs: DataFrame, found: object, longest: int) -> DataFrame:
    """(slot, f): how often the phrase of each slot of the table occurs; mappers count by bincount and a tree sums their arrays."""

    def made():
        table = found.value
        total, held = np.zeros(len(table), np.int64), []

        def each(tokens: Tokens, langs: list[str]):
            for k in range(1, longest + 1):
                at = np.flatnonzero(tokens.fits(k))
                a = tokens.keys(k, 1)[at]
                near = np.flatnonzero(table.hint[(a & np.uint64(len(table.hint) - 1)).astype(np.int64)])
                slot = table.find(a[near], tokens.keys(k, 2)[at[near]])
                held.append(slot[slot >= 0])
            if sum(map(len, held)) > max(BUFFER // 8, len(table)):
                add()
            return ()

        def add():
            if held:
                total.__iadd__(np.bincount(np.concatenate(held), minlength=len(total)))
                held.clear()

        def rest():
            add()
            part = TaskContext.get().partitionId()
            for block in range(0, len(total), BLOCK):
                own = total[block : block + BLOCK]
                if own.any():
                    yield [pa.array([block // BLOCK], pa.int32()), pa.array([part], pa.int32()), pa.array([own.astype("<i8").tobytes()], pa.binary())]

        return each, rest

    schema = "block int, part int, total binary"
    arrays, parts = scan(docs, schema, made), docs.rdd.getNumPartitions()

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in group.column("total").to_pylist())
        return pa.table({"block": group.column("block")[:1], "part": group.column("part")[:1], "total": [total.tobytes()]})

    while parts > 0:
        parts //= FAN
        above = F.floor(F.col("part") / FAN).cast("int") if parts else F.lit(0)
        arrays = arrays.withColumn("part", above).groupBy("block", "part").applyInArrow(added, schema)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, total in zip(batch.column("block").to_pylist(), batch.column("total").to_pylist()):
                f = np.frombuffer(total, "<i8")
                own = np.flatnonzero(f)
                yield pa.RecordBatch.from_arrays([_longs(own + block * BLOCK), _longs(f[own])], ["slot", "f"])

    return arrays.mapInArrow(slots, "slot long, f long")


# -- the operator ------------------------------------------------------------------------------------------------------------------


@dataclass
class Mined:
    """phrases: (slot, lang, phrase, n_words, f) of all candidates of one word and more; totals: (lang, n) words of each language."""

    phrases: DataFrame
    totals: DataFrame


def mine(docs: DataFrame, least: int = 100, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> Mined:
    """Exact counts of all phrases of at most `longest` words that occur at least `least` times in a language.

    A null language is `und` and a null text is empty. Repeated rows count as often as they stand; an empty table gives
    empty results; other columns are ignored, whatever their names.
    """
    named = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    enough = lambda df: materialise(df.groupBy("a", "lang").agg(F.sum("c").alias("c"), F.min("mark").alias("mark")).where((F.col("c") >= least) | F.col("a").isNull()), "candidates")
    first = enough(hashed(named, 1))
    levels = [first.where("a IS NOT NULL")]
    for k in range(2, longest + 1):
        last = enough(union([hashed(named, k, table) for _, table in tables(levels[-1].select("a"))]))
        if last.isEmpty():
            break
        levels.append(last)
    longest = len(levels)
    keys = union(levels).groupBy("a").agg(F.sum("c").alias("c"), F.min("mark").alias("mark"))
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.lit("two phrases have one key"))).alias(c)

    def spelled_and_counted(wanted: DataFrame, known: list[DataFrame]) -> DataFrame:
        texts = union([*known, *[spelled(named, table, longest) for _, table in tables(wanted.select("a", "mark"))]])
        phrases, found = materialise(texts.groupBy("a", "b").agg(one("lang"), one("phrase"), F.min("n").alias("n")), "phrases"), []
        for before, table in tables(phrases.select("a", "b")):
            found.append(placed(phrases, table).join(counts(named, table, longest), "slot").withColumn("slot", F.col("slot") + before))
        return materialise(union(found).select("slot", "lang", "phrase", F.col("n").alias("n_words"), "f", "a", "b"), "counted")

    counted = spelled_and_counted(keys, [])
    total = counted.groupBy("a").agg(F.sum("f").alias("f"))
    short = materialise(keys.join(total, "a", "left").where(F.col("c") > F.coalesce("f", F.lit(0))).select("a", F.lit(-1).cast("long").alias("mark")), "short")
    if not short.isEmpty():  # other phrases have the same hash
        counted = spelled_and_counted(short, [counted.select("a", "b", "lang", "phrase", F.col("n_words").alias("n"))])
    return Mined(counted.where(F.col("f") >= least), first.where("a IS NULL").select("lang", F.col("c").alias("n")))


def placed(keys: DataFrame, table: object, name: str = "slot") -> DataFrame:
    """The rows of keys (a, b and others) that are in the table, with their slot there in the column `name`."""
    names = [*keys.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(c)).view(np.uint64) for c in "ab")
            slot = table.value.find(a, b)
            own = np.flatnonzero(slot >= 0)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(own)) for c in batch.columns] + [pa.array(slot[own])], names)

    return keys.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema) + f", {name} long")


def cuts(phrases: DataFrame) -> DataFrame:
    """(slot, k, left, a, b): the keys of both parts of every cut of every phrase of two and more words."""
    names = ["slot", "k", "left", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = Tokens(utf8(batch.column("phrase")), batch.column("lang").to_pylist())
            slot, first = np.asarray(batch.column("slot")), np.cumsum(tokens.count) - tokens.count
            for k in range(1, LONGEST):
                for left in (True, False):
                    own = np.flatnonzero(tokens.count > k)
                    n = np.full(len(own), k) if left else tokens.count[own] - k
                    at = first[own] + (0 if left else k)
                    for size in np.unique(n).tolist():
                        here = n == size
                        a, b = (tokens.keys(size, lane)[at[here]] for lane in (1, 2))
                        yield pa.RecordBatch.from_arrays([_longs(slot[own[here]]), pa.array(np.full(len(a), k, np.int32)), pa.array(np.full(len(a), left)), _longs(a), _longs(b)], names)

    return phrases.where("n_words > 1").mapInArrow(run, "slot long, k int, left boolean, a long, b long")


def collocations(mined: Mined, top: int = 2000, share: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by the score of their weakest cut.

    The score of a cut is floor(1000 * a * n / (l * r)), exactly. A phrase that stands inside a longer one which has at least `share` percent of its
    count is left out, whether that one is itself or not.
    """
    parts = materialise(cuts(mined.phrases), "cuts")
    counted = mined.phrases.select("a", "b", "f")
    slots = []
    for before, table in tables(counted.select("a", "b")):
        own = placed(counted, table, "part").select("part", "f")
        slots.append(placed(parts, table, "part").join(own, "part").select("slot", "k", "left", "f"))
    side = lambda left: F.max(F.when(F.col("left") == left, F.col("f")))
    cut = union(slots).groupBy("slot", "k").agg(side(True).alias("l"), side(False).alias("r"))

    long = mined.phrases.where("n_words > 1").select("slot", "lang", "phrase", "n_words", "f")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("CAST((CAST(1000 AS DECIMAL(4,0)) * f_ * n_) div (l_ * r_) AS BIGINT)")
    scored = cut.join(long.select("slot", "lang", "f"), "slot").join(mined.totals, "lang").withColumns({"f_": exact("f"), "n_": exact("n"), "l_": exact("l"), "r_": exact("r")}).withColumn("score", score)
    weakest = scored.groupBy("slot").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("cut"))

    words = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, n_words - 1), m -> transform(sequence(1, n_words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inside = long.where("n_words > 2").withColumn("w", words).select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = long.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
    out = kept.join(weakest, "slot").select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.n", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

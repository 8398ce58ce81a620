"""SimHash near-duplicates by pivot distance tables.

A fingerprint's row in the pivot table holds its Hamming distances to reference fingerprints ("pivots"),
block by block: d[b][i] is the number of bits in block b that differ from pivot i. Sums over the blocks are
the distances to the whole pivots. By the triangle inequality two fingerprints within `distance` bits have

* equal coordinates in all but `distance` of the blocks, since each differing bit lies in one block, and
* whole distances to each pivot that differ by at most `distance`.

The first fact makes candidates an equi-join on the coordinates of the blocks that must agree, the second
discards candidates by their maximum coordinate difference. Survivors are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import materialise, pieces, small_batches, utf8

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: Blocks of the pivot table, and pivots: random 64-bit numbers from a fixed seed.
BLOCKS, PIVOTS = 6, 16
#: Rows of a bucket beyond which it is cut finer, and how often blocks are halved for that.
LARGE, HALVINGS = 256, 2


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [h(joined, seed)]
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    return [h(joined[a : b - 1], seed) for a, b in zip(starts, starts[shingle:])]


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash; 0 without words."""
    hashes = shingle_hashes(text)
    if not hashes:
        return 0
    counts, step = np.zeros(BITS, np.int64), 1 << 15
    for at in range(0, len(hashes), step):
        rows = np.array(hashes[at : at + step], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the SimHash of each whole text. Null or blank texts have fingerprint 0."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            fps = np.array([fingerprint(t) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    return [int(x) for x in np.random.default_rng(64).integers(-(2**63), 2**63 - 1, n)]


def masks(blocks: int = BLOCKS) -> list[int]:
    """Signed masks of `blocks` runs of bits that cover all 64."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [int(np.uint64(sum(1 << j for j in range(a, b))).view(np.int64)) for a, b in zip(cuts, cuts[1:])]


def coordinates(mask: int) -> Column:
    """The distances to all pivots over the bits of a mask of at most 15 bits, packed, 4 bits each."""
    distance = lambda p: F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(mask))).cast("long")
    refs = pivots()
    return sum((F.shiftleft(distance(p), 4 * i) for i, p in enumerate(refs[1:], 1)), distance(refs[0]))


def pivot_table(fps: DataFrame) -> DataFrame:
    """Add `near`, the distances to the whole pivots."""
    return fps.withColumn("near", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint") for p in pivots()]))


def _close(rows: DataFrame, distance: int) -> DataFrame:
    """Pairs of rows with equal k that no pivot keeps apart and that differ by at most `distance` bits."""
    table = pivot_table(rows.select("k", "fp"))
    x, y = table.select("k", F.col("fp").alias("a"), "near"), table.select("k", F.col("fp").alias("b"), F.col("near").alias("near_b"))
    apart: Column = F.array_max(F.zip_with("near", "near_b", lambda p, q: F.abs(p - q)))
    return x.join(y, "k").where((F.col("a") < F.col("b")) & (apart <= distance)).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")


def links(fps: DataFrame, distance: int = DISTANCE, large: int = LARGE, halvings: int = HALVINGS) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints `fps` (fp) with at most `distance` differing bits.

    Fingerprints that agree on the coordinates of half of the blocks share a bucket, whose rows are joined with each other. A bucket of more than
    `large` rows is cut: its other blocks are halved, and the same argument gives buckets within it, which agree on 48 bits or so,
    and after another halving on 56. What is crowded still has no more than a few hundred fingerprints, as they are distinct.
    Rows that agree have equal k, a hash of their bucket and coordinates; others that share a hash by chance are only compared in vain.
    """
    combos = list(combinations(range(BLOCKS), BLOCKS - distance))
    # each fingerprint becomes many rows, so it must not stay in partitions that were joined together by their present size; dealt out by
    # the plain column it would, as it comes from an aggregate by that
    rows = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    # `free` has the blocks on which the bucket's rows do not agree yet
    rows = rows.select("fp", F.lit(0).cast("long").alias("k"), F.array(*[F.lit(b) for b in range(BLOCKS)]).alias("free"))
    found = None
    for level in range(halvings + 1):
        table = rows.withColumn("blocks", F.array(*map(coordinates, masks(BLOCKS << level))))
        own = lambda c: [F.get("blocks", F.get("free", F.lit(i))) for i in c]
        keys = [F.struct(F.lit(n).alias("n"), F.xxhash64("k", F.lit(n), *own(c)).alias("k")) for n, c in enumerate(combos)]
        keyed = materialise(table.withColumn("key", F.explode(F.array(*keys))).select("fp", "free", "key.n", "key.k"), "keyed")
        if level == halvings:
            return _close(keyed, distance) if found is None else found.unionByName(_close(keyed, distance)).distinct()
        crowded = materialise(keyed.groupBy("k").agg(F.count("*").alias("size")).where(F.col("size") > large).select("k"), "crowded")
        if crowded.isEmpty():
            fine = _close(keyed, distance)
            return (fine if found is None else found.unionByName(fine)).distinct()
        fine = _close(keyed.join(crowded, "k", "left_anti"), distance)
        found = fine if found is None else found.unionByName(fine)
        rest = F.get(F.array(*[F.array(*[F.lit(i) for i in range(BLOCKS) if i not in c]) for c in combos]), F.col("n"))
        halves = F.flatten(F.transform(rest, lambda i: F.array(2 * F.get("free", i), 2 * F.get("free", i) + 1)))
        rows = keyed.join(crowded, "k", "left_semi").select("fp", "k", halves.alias("free"))
    raise AssertionError("the last level returns")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): per row its fingerprint and the least id reachable over links of at most 3 bits.

    Equal fingerprints are one node, so a group of exact copies costs one row in the candidate search. Other
    columns of docs are ignored. Rows with equal ids each get a row. Empty tables give empty results.
    """
    fps = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    joined = nodes.join(components(links(nodes.select("fp"))), F.col("fp") == F.col("node"), "left")
    rooted = joined.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # a component is one row per distinct fingerprint; its least id is found by a partial aggregate and joined back
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select(F.col("fp").alias("key"), "component")
    return fps.join(named, F.col("fp") == F.col("key")).select("id", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with the least id of their group; of rows with equal ids and texts, one.

    A row without an id stays only if no row of its group has one. Of rows with one id, each is judged by its own text; if several of a group have
    its least id, one stays. Null and blank texts are one group. An empty table gives an empty result.
    """
    own = docs.select(F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h")).alias("id"), docs[text_col].alias("text"))
    found = near_duplicates(own, "id", "text").where("id = component").select("id.id", "id.h").distinct()
    # the join and the removal of repeated rows share one shuffle by id
    kept = docs.join(found, docs[id_col].eqNullSafe(found["id"]) & (F.xxhash64(docs[text_col]) == found["h"]), "left_semi")
    return kept.dropDuplicates([id_col, text_col])


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

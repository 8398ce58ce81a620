"""Document fingerprints by a randomised edit embedding.

A walk goes through a text from its first character. At step j it notes the characters where it stands and
moves on by one or stays, as a random table shared by all walks says for (j, character). Walks over texts that differ by
a few edits soon meet again, so the Hamming distance of the notes is small where the edit distance is. A fingerprint samples
SLOTS notes. A slot draws its step by shared random priorities: it is the step of highest priority below the
walk's length, so texts of about equal length sample the same steps. The share of slots in which two
fingerprints agree estimates how much of the longer walk is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import materialise, pieces, small_batches, utf8

SLOTS, GRAM = 128, 4
#: Steps after which the shared table of moves repeats, and characters that share a walk group.
PERIOD, GROUP = 4096, 1 << 21
#: Texts of a group up to which walks are taken one by one.
FEW = 48
BEAT = 64
#: Longest walk, in steps, whose sampled steps are prepared.
LONGEST = 1 << 40


@cache
def moves() -> np.ndarray:
    """(PERIOD, 256) of 0 and 1: whether the walk moves on from a character at a step."""
    return np.random.default_rng(3).integers(0, 2, PERIOD * 256).astype(np.int64).reshape(PERIOD, 256)


@cache
def drawn() -> np.ndarray:
    """(SLOTS, n): the steps at which each slot's draw changes as walks grow, padded with LONGEST.

    Of equally likely priorities for steps 0, 1, 2, ..., the highest so far at step s is beaten next at a step beyond t with
    probability (s + 1) / (t + 1), so the next record follows from one random number.
    """
    rng, rows = np.random.default_rng(33), []
    for _ in range(SLOTS):
        row = [0]
        while row[-1] < LONGEST:
            row.append(min(LONGEST, int((row[-1] + 1) / (1 - rng.random()))) or 1)
            row[-1] = max(row[-1], row[-2] + 1)
        rows.append(row)
    size = max(map(len, rows))
    return np.array([r + [LONGEST] * (size - len(r)) for r in rows], np.int64)


def steps_of(lengths: np.ndarray) -> np.ndarray:
    """(SLOTS, walks): the step that each slot samples of walks of these many steps."""
    return np.stack([row[np.maximum(np.searchsorted(row, lengths) - 1, 0)] for row in drawn()])


def _walk(data: np.ndarray, first: np.ndarray, size: np.ndarray, notes: np.ndarray) -> np.ndarray:
    """(walks, SLOTS): fingerprints of the texts data[first : first + size], each step of all walks at once.

    Longer texts come first, so that walks at their end drop out at the back. Ends are looked for every BEAT steps; data goes on
    for as many characters. Only the steps that some slot may sample are kept.
    """
    order = np.argsort(-size, kind="stable")
    at, end = first[order].copy(), (first + size)[order]
    live, step, table = int((size > 0).sum()), 0, moves()
    length = np.zeros(len(order), np.int64)
    sampled, kept = np.unique(drawn()), []
    recent = np.empty((BEAT, len(order)), np.int64)
    while live:
        own = at[:live]
        beat = step % BEAT
        recent[beat, :live] = own
        if step == sampled[len(kept)]:
            kept.append(own.copy())
        own += table[step % PERIOD].take(data.take(own))
        step += 1
        if beat == BEAT - 1:
            ended = np.flatnonzero((own >= end[:live]) & (length[:live] == 0))
            length[ended] = step - BEAT + (recent[:, ended] < end[ended]).sum(0)
            over = own >= end[:live]
            own[over] = end[:live][over]
            while live and length[live - 1]:
                live -= 1
    out = np.zeros((len(order), SLOTS), np.uint8)
    if kept:
        places = np.zeros((len(kept), len(order)), np.int64)
        for i, row in enumerate(kept):
            places[i, : len(row)] = row
        walked = np.flatnonzero(length)
        chosen = np.searchsorted(sampled, steps_of(length[walked]))
        out[order[walked]] = notes[places[chosen, walked]].T
    return out


def _alone(points: np.ndarray) -> np.ndarray:
    """The fingerprint of one text: a plain loop over its steps, which notes only where the sampled steps stand."""
    codes, table, n = (points & 255).astype(np.uint8).tobytes(), _rows(), len(points)
    sampled = np.unique(drawn()).tolist()
    at, step, kept = 0, 0, []
    wanted = iter(sampled)
    following = next(wanted)
    while at < n:
        if step == following:
            kept.append(at)
            following = next(wanted)
        at += table[step % PERIOD][codes[at]]
        step += 1
    places = np.array(kept, np.int64)[np.searchsorted(sampled, steps_of(np.array([step]))[:, 0])]
    padded, note = np.concatenate([points, np.zeros(GRAM, np.uint32)]).astype(np.uint64), np.zeros(SLOTS, np.uint64)
    for k in range(GRAM):
        inside = np.where(places + k < n, padded[places + k] + np.uint64(1), np.uint64(0))
        note = (note + inside) * np.uint64(0x9E3779B97F4A7C15)
    return (note >> np.uint64(56)).astype(np.uint8)


@cache
def _rows() -> list[bytes]:
    return [row.astype(np.uint8).tobytes() for row in moves()]


def fingerprints(texts: list[np.ndarray]) -> list[np.ndarray]:
    """SLOTS bytes for each text, given as code points; all zero for an empty one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[np.ndarray] = [np.zeros(SLOTS, np.uint8)] * len(texts)
    order, at = np.argsort(sizes, kind="stable"), int((sizes == 0).sum())
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto + 1 - at) * sizes[order[upto]] <= GROUP:
            upto += 1
        own = order[at:upto]
        at = upto
        if len(own) <= FEW:
            for i in own.tolist():
                out[i] = _alone(texts[i])
            continue
        points = np.concatenate([*[texts[i] for i in own], np.zeros(BEAT + GRAM, np.uint32)]).astype(np.uint64)
        first = np.cumsum(sizes[own]) - sizes[own]
        note = np.zeros(len(points), np.uint64)
        reach = np.repeat(first + sizes[own], sizes[own])  # a note ends with its text
        index = np.arange(len(reach))
        for k in range(GRAM):
            inside = np.where(index + k < reach, points[k : k + len(reach)] + np.uint64(1), np.uint64(0))
            note[: len(reach)] = (note[: len(reach)] + inside) * np.uint64(0x9E3779B97F4A7C15)
        # walks that have ended may read on past their texts; what they read is not used
        for i, fp in zip(own.tolist(), _walk((points & np.uint64(255)).astype(np.int64), first, sizes[own], (note >> np.uint64(56)).astype(np.uint8))):
            out[i] = fp
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Between 0 and 1: the share of equal slots, less what chance gives."""
    same = float((a == b).mean())
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def in_descending_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, turn, id, text), in runs by descending id; each run ends with the row that follows it, at turn 1.

    Runs are ranges of (id, hash of the text, number of the row), so that rows of equal or no id are dealt out like any others. Spark's
    range partitions of these keys alone give where runs begin, one row for each run. Each row finds its run by binary search, and the first
    row of a run goes to the run before it as well. The last run is followed by the first row of all.
    """
    runs = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(docs[id_col].isNotNull().alias("known"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = docs.select(key.alias("key"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    begins = rows.select("key").repartitionByRange(runs, F.desc("key")).groupBy(F.spark_partition_id().alias("run")).agg(F.max("key").alias("key"))
    # one row for each run; they are written, as the same bounds are to be used wherever rows are read
    begins = materialise(begins, "runs").agg(F.sort_array(F.collect_list("key"), asc=False).alias("begins"))
    found = rows.withColumn("begins", begins.scalar())
    powers = F.array(*[F.lit(1 << k) for k in range(max(1, runs.bit_length()), -1, -1)])
    reaches = lambda i: (i < F.size("begins")) & (F.get("begins", i) >= F.col("key"))
    run = F.aggregate(powers, F.lit(0), lambda at, step: F.when(reaches(at + step), at + step).otherwise(at))
    found = found.withColumn("run", run).withColumn("first", F.get("begins", "run") == F.col("key"))
    before = F.pmod(F.col("run") - 1, F.size("begins"))
    own, ahead = F.struct(F.col("run").alias("bucket"), F.lit(0).alias("turn")), F.struct(before.alias("bucket"), F.lit(1).alias("turn"))
    placed = found.withColumn("at", F.explode(F.when(F.col("first"), F.array(own, ahead)).otherwise(F.array(own)))).select("at.bucket", "at.turn", "key", "id", "text")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "turn", F.desc("key")).drop("key")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of each whole text.

    The edited text has the last half of the code points (rounded down) replaced by the first as many of the next
    document's text, in descending order of ids; the first follows the last. Rows with equal ids go by a hash of their text; null ids come
    last; null texts are empty; ids are of any type that has an order. Fingerprints are hexadecimal. An empty table gives an empty
    result. docs is read twice and has to give its rows in the same order, as a table does; if not, the run fails.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def block(rows: list[tuple], following: bytes, id_type: pa.DataType) -> pa.RecordBatch:
        """rows of (id, text), each followed by the next, the last one by `following`."""
        points = [code_points(t) for _, t in rows] + [code_points(following)]
        edited = []
        for own, after in zip(points, points[1:]):
            half = len(own) // 2
            edited.append(np.concatenate([own[: len(own) - half], after[:half]]))
        prints = fingerprints(points + edited)
        plain, changed = prints[: len(points)], prints[len(points) :]
        columns = [
            [r[0] for r in rows], [len(p) for p in points[:-1]], [e.tobytes().decode("utf-32-le", "surrogatepass") for e in edited], [p.tobytes().hex() for p in plain[:-1]],
            [p.tobytes().hex() for p in changed], [likeness(a, b) for a, b in zip(plain, changed)], [likeness(a, b) for a, b in zip(plain, plain[1:])],
        ]
        names = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, open_run = 0, None
        for batch in pieces(batches, "text"):
            id_type = batch.schema.field("id").type
            for bucket, turn, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), utf8(batch.column(3))):
                if turn == 0:
                    if open_run not in (None, bucket) and held:
                        raise RuntimeError("the documents came in another order when they were read again")
                    open_run = bucket
                    if held and size > GROUP:
                        yield block(held, text, id_type)
                        held, size = [], 0
                    held.append((key, text))
                    size += len(text)
                elif held:
                    yield block(held, text, id_type)
                    held, size = [], 0
        if held:
            raise RuntimeError("the documents came in another order when they were read again")

    schema = f"id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_descending_order(docs, id_col, text_col).select("bucket", "turn", "id", "text").mapInArrow(run, schema)


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of each whole text, row by row, with no shuffle; null texts are empty, equal texts have equal fingerprints."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            points = [code_points(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) for p in points], pa.int64()), pa.array([f.tobytes().hex() for f in fingerprints(points)], pa.string())], ["id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_chars long, fingerprint string")


def near_pairs(prints: DataFrame, bands: int = 32, least: float = 0.8, id_col: str = "id", rows: int = 512) -> DataFrame:
    """(a, b, likeness) of representatives with likeness >= least, from (id, fingerprint); equal fingerprints have one, their least id.

    Bands are runs of sampled slots; fingerprints that agree in a whole band are candidates, and all slots of a
    candidate pair are compared. With 32 bands of 4 slots a pair of likeness 0.8 shares a band with certainty: it differs in 25 slots at
    most. Bands go by their hashes, without the fingerprints; only rows of bands that two fingerprints share get theirs. A bucket of more
    than about `rows` fingerprints is cut into parts; each pair of parts is a join key of its own, so that tasks
    share its work. A pair that agrees in several bands is compared in the first one only. Null fingerprints and ids are dropped.
    """
    small_batches(prints.sparkSession)
    own = prints.where(F.col("fingerprint").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.unhex("fingerprint").alias("fp")).agg(F.min(id_col).alias("id"))
    own = materialise(own, "own")
    width = SLOTS // bands
    hashes = F.array(*[F.xxhash64(F.lit(i), F.substring("fp", i * width + 1, width)) for i in range(bands)])
    keyed = materialise(own.select("id", F.posexplode(hashes).alias("band", "k")), "bands")
    cuts = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", F.ceil(F.col("n") / F.lit(rows)).cast("int").alias("cuts"))
    dealt = keyed.join(cuts.hint("merge"), "k").join(own.hint("merge"), "id").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), "cuts").cast("int"))
    # parts low <= high; a pair of two parts comes up with either row first
    left = dealt.select("k", "band", F.col("id").alias("a"), F.col("fp").alias("x"), F.col("own").alias("low"), F.explode(F.sequence("own", F.col("cuts") - 1)).alias("high"))
    right = dealt.select("k", F.col("id").alias("b"), F.col("fp").alias("y"), F.explode(F.sequence(F.lit(0), "own")).alias("low"), F.col("own").alias("high"))
    pairs = left.join(right.hint("merge"), ["k", "low", "high"]).where((F.col("a") < F.col("b")) | (F.col("low") < F.col("high")))
    kind = prints.schema[id_col].dataType.simpleString()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)
        for batch in batches:
            same = slots(batch.column(2)) == slots(batch.column(3))
            first = same[:, : width * bands].reshape(-1, bands, width).all(2).argmax(1) == batch.column(4).to_numpy()
            near = np.maximum(0.0, (same.mean(1) - 1 / 256) / (1 - 1 / 256))
            kept = pa.array(first & (near >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(near).filter(kept)], ["a", "b", "likeness"])

    found = pairs.select("a", "b", "x", "y", "band").mapInArrow(compared, f"a {kind}, b {kind}, likeness double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def near_classes(prints: DataFrame, least: float = 0.8, id_col: str = "id") -> DataFrame:
    """(id, class, n_links) per row of prints: the least id of its class over pairs of likeness >= least, and its representative's links.

    Equal fingerprints are one class. Rows without an id or a fingerprint have a class of their own, which is null.
    """
    own = prints.select(F.col(id_col).alias("id"), "fingerprint")
    pairs = materialise(near_pairs(own.where("id IS NOT NULL"), least=least), "pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("leader")).groupBy("leader").agg(F.count("*").alias("n"))
    leaders = own.where("id IS NOT NULL").groupBy("fingerprint").agg(F.min("id").alias("leader"))
    rooted = leaders.join(components(pairs.select("a", "b")), F.col("leader") == F.col("node"), "left").join(degree, "leader", "left")
    named = rooted.select(F.col("fingerprint").alias("own"), F.coalesce("root", "leader").alias("class"), F.coalesce("n", F.lit(0)).alias("n_links"))
    found = own.join(named, (F.col("fingerprint") == F.col("own")) & F.col("id").isNotNull(), "left")
    return found.select("id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))

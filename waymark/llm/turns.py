"""Structure repair of conversations: the cheapest edits that make the roles follow a grammar, by dynamic programming.

Role initials have to read `(s?(ua)+)?`. Keep costs nothing, Rerole to user or assistant 1, Delete 2 (required for blank and duplicate
turns), Insert of an empty user or assistant turn 5; a truncated turn that is not deleted costs 5 more. A backward pass computes the cost to
go from every (turn, state of the grammar); a forward walk then takes the ASCII-least edit among those that keep to that cost.

One conversation can hold any share of all turns, so both passes work on segments of at most SEGMENT consecutive turns:

1. turns are dealt by ranges of (conversation, turn, role, text), which numbers them without a window over a conversation;
2. each segment gives a matrix of least costs from each state at its start to each at its end (min-plus product);
3. the matrices of a conversation, a 4096th of its turns, give the cost to go at the end of each of its segments;
4. each segment is walked from every state that it may be entered in, and the walks of a conversation are put one after another.

A turn is a duplicate if another with its role and text stands earlier, which is a minimum by (conversation, role, digest), joined back by
the turn's number; no key of that join is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

SEGMENT_BITS = 12
SEGMENT = 1 << SEGMENT_BITS
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 60

#: States: nothing yet, after system, after user, after assistant; the first and last may end a conversation.
STATES, ENDS = range(4), (0, 3)
#: Where each state goes with an initial (s, u, a, any other), and with the only turn of user or assistant that it allows.
AFTER = [{0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2}]
NEXT, ROLE = [2, 2, 3, 2], ["user", "user", "assistant", "user"]
LEGAL = {(0, 1), (1, 2), (2, 1)}


def closed(cost: list[int]) -> list[int]:
    """Costs to go if turns may be inserted first; two insertions lead to every state that can be reached."""
    for _ in range(3):
        cost = [min(c, INSERT + cost[NEXT[q]]) for q, c in enumerate(cost)]
    return cost


#: Cost to go after the last turn.
LAST = closed([0 if q in ENDS else NEVER for q in STATES])


def before(after: list[int], code: int) -> list[int]:
    """Cost to go before a turn, from that after it; code is 3 * initial + (0 sound, 1 truncated, 2 to be deleted)."""
    initial, fault = divmod(code, 3)
    cost = [DELETE + c for c in after]
    if fault < 2:
        more = TRUNCATED * fault
        for q in STATES:
            cost[q] = min(cost[q], more + REROLE + after[NEXT[q]])
            if initial in AFTER[q]:
                cost[q] = min(cost[q], more + after[AFTER[q][initial]])
    return closed(cost)


def matrix(codes: list[int]) -> list[int]:
    """Least costs from each state before the turns to each after them, row by row."""
    columns = []
    for end in STATES:
        cost = [0 if q == end else NEVER for q in STATES]
        for code in reversed(codes):
            cost = before(cost, code)
        columns.append(cost)
    return [min(columns[b][a], NEVER) for a in STATES for b in STATES]


def walk(codes: list[int], after: list[int], last: bool) -> list[tuple[str, int]]:
    """From each state before the turns: the edits' initials, ASCII-least among the cheapest, and the state after them."""
    togo = [after]
    for code in reversed(codes):
        togo.append(before(togo[-1], code))
    togo.reverse()
    found = []
    for state in STATES:
        q, i, edits = state, 0, []
        while i < len(codes):
            (initial, fault), left, then = divmod(codes[i], 3), togo[i][q], togo[i + 1]
            more = TRUNCATED * fault
            if DELETE + then[q] == left:
                edits.append("D")
                i += 1
            elif INSERT + togo[i][NEXT[q]] == left:
                edits.append("I")
                q = NEXT[q]
            elif fault < 2 and initial in AFTER[q] and more + then[AFTER[q][initial]] == left:
                edits.append("K")
                q, i = AFTER[q][initial], i + 1
            else:
                edits.append("R")
                q, i = NEXT[q], i + 1
        while last and q not in ENDS:
            edits.append("I")
            q = NEXT[q]
        found.append(("".join(edits), q))
    return found


def applied(edits: str, state: int, codes: list[int]) -> list[tuple[int, int, str, str | None]]:
    """(turn, rank at it, edit, new role) of the turns that stay or are inserted; codes are needed to follow kept turns."""
    found, i, rank, q = [], 0, 0, state
    for edit in edits:
        if edit == "D":
            i, rank = i + 1, 0
        elif edit == "I":
            found.append((i, rank, edit, ROLE[q]))
            q, rank = NEXT[q], rank + 1
        else:
            found.append((i, rank, edit, ROLE[q] if edit == "R" else None))
            q, i, rank = NEXT[q] if edit == "R" else AFTER[q][codes[i] // 3], i + 1, 0
    return found


# -- Spark ---------------------------------------------------------------------------------------------------------------------


def ordered(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, digest, pos): pos orders the turns of a conversation and counts them without gaps within a segment."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    keyed = named.withColumn("digest", F.sha2("text", 256)).withColumn("copy", F.monotonically_increasing_id())  # equal turns may be split, too
    keys = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "digest", "copy")]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("copy")
    return materialise(dealt.withColumn("pos", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """(conv, turn, pos, initial, fault) of ordered() turns; fault is the first of blank, duplicate, truncated, or null."""
    firsts = turns.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    here = turns.select("conv", "turn", "pos", initial.alias("initial"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    return here.join(firsts, "pos", "left").select("conv", "turn", "pos", "initial", fault.alias("fault"))


@dataclass
class Repair:
    """Per conversation (conv, gaps, blank, duplicate, truncated, illegal, cost, audit), and its repaired turns (conv, pos, rank, edit, role, text)."""

    conversations: DataFrame
    turns: DataFrame


def _each(df: DataFrame, schema: str, compute, *columns: str) -> DataFrame:
    """A row function on Arrow batches: compute(*values of the columns) gives the rows for each row."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for values in zip(*[batch.column(c).to_pylist() for c in columns]) for r in compute(*values)]
            types = [batch.schema.field(n).type if n == "conv" else None for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t or _ARROW[schema.split(", ")[i].split(" ", 1)[1]]) for i, t in enumerate(types)], names)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """The cheapest repair of every conversation.

    Turns stand by turn (null first), then by role and the SHA-256 of the text. A null role or text counts as one space, so
    that such a turn has to be reroled or is blank; a null id is a conversation of its own. Repeated rows are duplicates of the first; a conversation
    of which all turns are deleted has no repaired turns; an empty table gives empty results. Other columns are ignored, whatever their names.
    """
    turns = ordered(rows, id_col, turn_col, role_col, text_col)
    judged = materialise(faults(turns), "faults")
    kind = rows.schema[id_col].dataType.simpleString()
    found = lambda f: F.count_if(F.col("fault") == f).alias(f)
    totals = judged.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"), *[found(f) for f in ("blank", "duplicate", "truncated")]
    )

    bad = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    one = F.struct("pos", (3 * F.col("initial") + bad).alias("code"))
    parts = judged.groupBy("conv", F.shiftright("pos", SEGMENT_BITS).alias("part")).agg(F.sort_array(F.collect_list(one)).alias("own"))
    segments = materialise(parts.select("conv", F.col("own")[0]["pos"].alias("at"), F.col("own.code").cast("array<int>").alias("codes")), "segments")

    def measured(conv, at, codes):
        initials = [c // 3 for c in codes]
        return [(conv, at, matrix(codes), sum(p not in LEGAL for p in zip(initials, initials[1:])), initials[0], initials[-1])]

    costs = _each(segments, f"conv {kind}, at long, costs array<long>, illegal long, first long, last long", measured, "conv", "at", "codes")
    in_turn = costs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "costs", "illegal", "first", "last"))).alias("own"))

    def backward(conv, own):
        left, out = LAST, []
        for i, s in reversed(list(enumerate(own))):
            crossing = i > 0 and (own[i - 1]["last"], s["first"]) not in LEGAL
            out.append((conv, s["at"], left, i == len(own) - 1, s["illegal"] + crossing))
            left = [min(s["costs"][4 * q + e] + left[e] for e in STATES) for q in STATES]
        return out

    left = _each(in_turn, f"conv {kind}, at long, left array<long>, final boolean, illegal long", backward, "conv", "own")

    def walked(conv, at, codes, left, final, illegal):
        cost = left
        for code in reversed(codes):
            cost = before(cost, code)
        ways = walk(codes, left, final)
        return [(conv, at, codes, [e for e, _ in ways], [q for _, q in ways], cost[0], illegal)]

    joined = segments.join(left.drop("conv"), "at")
    ways = materialise(_each(joined, f"conv {kind}, at long, codes array<int>, edits array<string>, ends array<int>, cost long, illegal long", walked, "conv", "at", "codes", "left", "final", "illegal"), "walks")
    chains = ways.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "edits", "ends", "cost", "illegal"))).alias("own"))

    def forward(conv, own):
        q, audit, entered = 0, [], []
        for s in own:
            entered.append(q)
            audit.append(s["edits"][q])
            q = s["ends"][q]
        return [(conv, sum(s["illegal"] for s in own), own[0]["cost"], "".join(audit), [s["at"] for s in own], entered)]

    chained = materialise(_each(chains, f"conv {kind}, illegal long, cost long, audit string, ats array<long>, entered array<int>", forward, "conv", "own"), "audits")
    entered = chained.select(F.inline(F.arrays_zip("ats", "entered"))).toDF("at", "state")

    def stays(conv, at, codes, edits, state):
        return [(conv, at + i if edit != "I" else -1 - at - i, at + i, rank, edit, role) for i, rank, edit, role in applied(edits[state], state, codes)]  # an own below 0 has no match

    edits = _each(ways.join(entered, "at"), f"conv {kind}, own long, pos long, rank int, edit string, new_role string", stays, "conv", "at", "codes", "edits", "state")
    kept = turns.select(F.col("pos").alias("own"), "role", "text")
    inserted = F.col("edit") == "I"
    rebuilt = edits.join(kept, "own", "left").select("conv", "pos", "rank", "edit", F.coalesce("new_role", "role").alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"))
    conversations = totals.join(chained.select(F.col("conv").alias("conv_"), "illegal", "cost", "audit"), F.col("conv").eqNullSafe(F.col("conv_"))).drop("conv_")
    return Repair(conversations, rebuilt)


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of `role:text` of Repair.turns, joined by newlines, in lowercase hexadecimal.

    The hash of a text has to go through it from front to end, so that a task streams each conversation in order; it holds one batch.
    """
    small_batches(turns.sparkSession)
    kind = turns.schema["conv"].dataType.simpleString()
    line = F.concat_ws(":", "role", "text").alias("line")
    dealt = turns.select("conv", "pos", "rank", line).repartition("conv").sortWithinPartitions("conv", "pos", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, convs, found = None, None, [], []
        for batch in batches:
            for conv, text in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist()):
                if running is None or conv != now:
                    if running is not None:
                        convs.append(now)
                        found.append(running.hexdigest())
                    now, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, batch.schema.field("conv").type), pa.array(found, pa.string())], ["conv", "sha256"])
            kept_type, convs, found = batch.schema.field("conv").type, [], []
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kept_type), pa.array([running.hexdigest()], pa.string())], ["conv", "sha256"])

    return dealt.mapInArrow(run, f"conv {kind}, sha256 string")

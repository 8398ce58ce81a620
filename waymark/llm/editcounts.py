"""Edit-aware token counts: a segment tree of pre-tokens for each document, kept as a table.

`plant` encodes the texts of a table once and gives the leaves of their trees: blocks with their text, the lengths and token counts of their
pre-tokens, and their sums. `edited` takes such a table and edits, rewrites the blocks that the edits touch and gives the table after
them; other blocks are handed on as they are, and documents without edits do not go through Python. `totals` reads the counts off the sums.

The leaves of a tree are blocks of pre-tokens with their characters and tokens; inner nodes hold sums. An edit goes down the tree
to the place it touches, splits again from the last pre-token that the edit can affect, and stops as soon as a boundary after
the edit falls on an old one: from there on nothing changes. Only pre-tokens in between are encoded, and the sums above the
blocks in question are updated.

The split looks ahead but never back. A pre-token that ends at e depends on the characters up to e + 1 at most (a run of
white space leaves its last character to the word that follows), so an edit at `start` cannot affect one that ends before
start - 1.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces, small_batches, utf8

BLOCK = 64
#: Pre-tokens kept in a worker's cache of counts; it starts anew beyond that.
CACHE_TOKENS = 500_000
EDIT = "struct<start:long,stop:long,text:string>"
TREE = "encoded long, blocks array<struct<chars:long,tokens:long,text:string,lengths:binary,counts:binary>>"
_BLOCKS = pa.list_(pa.struct([("chars", pa.int64()), ("tokens", pa.int64()), ("text", pa.string()), ("lengths", pa.binary()), ("counts", pa.binary())]))
#: Characters of which the plain pattern below is sure to know the class.
_OTHER = re.compile("[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ÿ]")
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")


class Counter:
    """Pre-tokens of texts and their numbers of tokens, by a byte-level BPE given as ranks."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.general = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return (self.general if _OTHER.search(text) else _PLAIN).findall(text)

    def count(self, token: str) -> int:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= CACHE_TOKENS:
                self.known.clear()
            found = self.known[token] = len(self.encoding.encode_ordinary(token))
        return found


    def counts(self, tokens: list[str]) -> list[int]:
        """The counts of many pre-tokens, each distinct one looked up once."""
        known = self.known
        if len(known) >= CACHE_TOKENS:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = len(self.encoding.encode_ordinary(t))
        return list(map(known.__getitem__, tokens))


@cache
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class Tree:
    """The pre-tokens of one text in blocks, under sums of characters and tokens. Blocks are read from a kept tree when they are asked for."""

    def __init__(self, tokens: list[str], counter: Counter, counts: list[int] | None = None):
        self.counter, self.encoded = counter, 0
        counts = [counter.count(t) for t in tokens] if counts is None else counts
        self._build(tokens, counts)

    @classmethod
    def kept(cls, blocks: list[dict], counter: Counter) -> Tree:
        """The tree whose leaves kept() has given."""
        tree = cls.__new__(cls)
        tree.counter, tree.encoded = counter, 0
        tree.stored = list(blocks) or [None]
        tree.blocks = [None if b else ([], []) for b in tree.stored]
        tree._sum([(b["chars"], b["tokens"]) if b else (0, 0) for b in tree.stored])
        return tree

    def _build(self, tokens: list[str], counts: list[int]) -> None:
        self.blocks = [(tokens[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(tokens), BLOCK)] or [([], [])]
        self.stored = [None] * len(self.blocks)
        self._sum([(sum(map(len, own)), sum(n)) for own, n in self.blocks])

    def _sum(self, leaves: list[tuple[int, int]]) -> None:
        self.leaves = 1 << (len(leaves) - 1).bit_length()
        self.sums = [(0, 0)] * self.leaves + leaves + [(0, 0)] * (self.leaves - len(leaves))
        for i in range(self.leaves - 1, 0, -1):
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a + c, b + d)

    def block(self, i: int) -> tuple[list[str], list[int]]:
        """Pre-tokens and counts of a block."""
        found = self.blocks[i]
        if found is None:
            kept, own, at = self.stored[i], [], 0
            for n in np.frombuffer(kept["lengths"], "<u4").tolist():
                own.append(kept["text"][at : at + n])
                at += n
            found = self.blocks[i] = (own, np.frombuffer(kept["counts"], "<u4").tolist())
        return found

    def keep(self) -> list[dict]:
        """The blocks that are not empty, as plain values; those that nothing has touched are as they were stored."""
        out = []
        for i, stored in enumerate(self.stored):
            if stored is None and self.blocks[i][0]:
                own, n = self.blocks[i]
                chars, tokens = self.sums[self.leaves + i]
                stored = {"chars": chars, "tokens": tokens, "text": "".join(own), "lengths": np.array([len(t) for t in own], "<u4").tobytes(), "counts": np.array(n, "<u4").tobytes()}
            if stored is not None:
                out.append(stored)
        return out

    @property
    def characters(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def text(self) -> str:
        return "".join(b["text"] for b in self.keep())

    def pretokens(self) -> int:
        return sum(len(b["lengths"]) // 4 for b in self.keep())

    def _locate(self, offset: int) -> tuple[int, int, int]:
        """(block, pre-token in it, its first character) of the pre-token that holds this character; the end is after all."""
        if offset >= self.characters:
            last = len(self.blocks) - 1
            return last, len(self.block(last)[0]), self.characters
        node, left = 1, offset
        while node < self.leaves:
            node *= 2
            if left >= self.sums[node][0]:
                left -= self.sums[node][0]
                node += 1
        block, first = node - self.leaves, offset - left
        for i, token in enumerate(self.block(block)[0]):
            if left < len(token):
                return block, i, first
            left, first = left - len(token), first + len(token)
        raise AssertionError("sums do not match the leaves")

    def _after(self, block: int, i: int) -> Iterator[tuple[int, int, str]]:
        while block < len(self.blocks):
            own = self.block(block)[0]
            for j in range(i, len(own)):
                yield block, j, own[j]
            block, i = block + 1, 0

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replace characters start to stop; both are brought within the text."""
        start = min(max(start, 0), self.characters)
        stop = min(max(stop, start), self.characters)
        block, i, first = self._locate(max(start - 2, 0)) if self.characters else (0, 0, 0)
        head = ""
        for _, _, token in self._after(block, i):
            if first + len(head) >= start:
                break
            head += token
        head = head[: start - first] + text
        b, j, at = self._locate(stop)
        rest = self._after(b, j)
        # where old pre-tokens start in the new text, from the edit's end on
        offset, old = len(head), {}
        buffer, whole, skip, more = [head], False, stop - at, 8
        while True:
            for _ in range(more):
                step = next(rest, None)
                if step is None:
                    whole = True
                    old[offset] = (len(self.blocks), 0)
                    break
                if not skip:
                    old[offset] = step[:2]
                buffer.append(step[2][skip:])
                offset += len(step[2]) - skip
                skip = 0
            joined, found, upto = "".join(buffer), [], 0
            for token in self.counter.split(joined):
                if upto in old and (whole or upto + 2 <= len(joined)):
                    break
                found.append(token)
                upto += len(token)
            if upto in old and (whole or upto + 2 <= len(joined)):
                self._replace(block, i, *old[upto], found)
                return
            buffer, more = [joined], 2 * more

    def _replace(self, block: int, i: int, upto_block: int, upto: int, tokens: list[str]) -> None:
        counts = [self.counter.count(t) for t in tokens]
        self.encoded += len(tokens)
        own, n = self.block(block)
        if upto_block == block:
            self._set(block, own[:i] + tokens + own[upto:], n[:i] + counts + n[upto:])
        else:
            self._set(block, own[:i] + tokens, n[:i] + counts)
            for b in range(block + 1, min(upto_block, len(self.blocks))):
                self._set(b, [], [])
            if upto_block < len(self.blocks):
                own, n = self.block(upto_block)
                self._set(upto_block, own[upto:], n[upto:])
        if len(self.blocks[block][0]) > 8 * BLOCK:  # deal out the leaves anew; nothing is encoded
            every = [self.block(b) for b in range(len(self.blocks))]
            self._build([t for own, _ in every for t in own], [c for _, n in every for c in n])

    def _set(self, b: int, own: list[str], counts: list[int]) -> None:
        self.blocks[b], self.stored[b] = (own, counts), None
        node = self.leaves + b
        self.sums[node] = (sum(map(len, own)), sum(counts))
        while node > 1:
            node //= 2
            (a, t), (c, u) = self.sums[2 * node], self.sums[2 * node + 1]
            self.sums[node] = (a + c, t + u)


def attach(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", edit_id_col: str | None = None) -> DataFrame:
    """docs with a column `edits` from rows (id, seq, start, stop, text), in the order of seq; none if a document has none.

    Edits without an id or with one that docs lacks are dropped; each row of equal ids has all edits of its id.
    """
    listed = edits.groupBy(F.col(edit_id_col or id_col).alias("_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "text"))).alias("_all"))
    own = F.transform(listed["_all"], lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["text"].alias("text")))
    return docs.join(listed, docs[id_col] == listed["_id"], "left").select(*[docs[c] for c in docs.columns if c != "edits"], own.alias("edits"))


def plant(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, encoded, blocks): the kept tree of each whole text and the number of pre-tokens that were encoded for it.

    A null or empty text has no blocks. Rows with equal ids have a tree each; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(ranks, pattern)
        for batch in pieces(batches, "text"):
            planted = [_planted(text.decode("utf-8", "replace"), tool) for text in utf8(batch.column(1))]
            yield _rows(batch.column(0), [n for n, _ in planted], [blocks for _, blocks in planted])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {TREE}")


def _planted(text: str, tool: Counter) -> tuple[int, list[dict]]:
    """Pre-tokens of a text, and the blocks that Tree(...).keep() gives."""
    tokens = tool.split(text)
    lengths, counts = np.fromiter(map(len, tokens), "<u4", len(tokens)), np.array(tool.counts(tokens), "<u4")
    starts = np.arange(0, len(tokens), BLOCK)
    if not len(starts):
        return 0, []
    sums, at, blocks = np.add.reduceat(counts, starts, dtype=np.int64).tolist(), 0, []
    for a, chars, n in zip(starts.tolist(), np.add.reduceat(lengths, starts, dtype=np.int64).tolist(), sums):
        blocks.append({"chars": chars, "tokens": n, "text": text[at : at + chars], "lengths": lengths[a : a + BLOCK].tobytes(), "counts": counts[a : a + BLOCK].tobytes()})
        at += chars
    return len(tokens), blocks


def _rows(ids: pa.Array, encoded: list[int], blocks: list[list[dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(encoded, pa.int64()), pa.array(blocks, _BLOCKS)], ["id", "encoded", "blocks"])


def edited(trees: DataFrame, ranks: str, pattern: str, edits: Column | str = "edits") -> DataFrame:
    """(id, encoded, blocks) after each row's edits; encoded is the number of pre-tokens that they made the operator encode.

    edits is an array of structs (start, stop, text), each relative to the text that those before it have left; positions beyond a
    text's ends are brought within it, and null edits, positions or texts count as empty. Rows without edits are handed on.
    """
    small_batches(trees.sparkSession)
    kind = trees.schema["id"].dataType.simpleString()
    given = (F.col(edits) if isinstance(edits, str) else edits).cast(f"array<{EDIT}>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(ranks, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part, after = batch.slice(a, 64), []
                for blocks, changes in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    tree = Tree.kept(blocks, tool)
                    for e in changes or ():
                        if e:
                            tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                    after.append(tree)
                yield _rows(part.column(0), [t.encoded for t in after], [t.keep() for t in after])

    rows = trees.select("id", "blocks", given.alias("edits"))
    touched = F.coalesce(F.size("edits"), F.lit(0)) > 0
    return rows.where(touched).mapInArrow(run, f"id {kind}, {TREE}").unionByName(rows.where(~touched).select("id", F.lit(0).cast("long").alias("encoded"), "blocks"))


def totals(trees: DataFrame) -> DataFrame:
    """(id, n_pretokens, n_tokens, encoded, text) of kept trees, from the sums of their blocks."""
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "")
    return trees.select("id", _sums("pretokens").alias("n_pretokens"), _sums("tokens").alias("n_tokens"), "encoded", text.alias("text"))


def _sums(field: str) -> Column:
    """The sum of a field over the blocks, or their number of pre-tokens."""
    own = lambda b: F.shiftright(F.octet_length(b["lengths"]), 2) if field == "pretokens" else b[field]
    return F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + own(b))


def count(docs: DataFrame, ranks: str, pattern: str, edits: Column | str = "edits", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens, n_tokens_edited, n_encoded, edited): token counts before and after each row's edits.

    The trees are written before they are edited. edits are those of edited(), from the columns of docs; n_encoded is the number of
    pre-tokens that they made the operator encode. A null text is empty. Rows with equal ids are edited one by one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    given = (F.col(edits) if isinstance(edits, str) else edits).cast(f"array<{EDIT}>")
    named = docs.select(F.struct(docs[id_col].alias("id"), given.alias("edits")).alias("id"), docs[text_col].alias("text"))
    trees = materialise(plant(named, ranks, pattern, "id", "text"), "trees", compression="zstd")
    # what came before goes along with the row, so that no join is needed
    carried = trees.select(F.struct("id.id", _sums("pretokens").alias("pretokens"), _sums("tokens").alias("tokens")).alias("id"), "encoded", "blocks", F.col("id.edits").alias("edits"))
    after = totals(edited(carried, ranks, pattern))
    return after.select(F.col("id.id").cast(kind).alias("id"), F.col("id.pretokens").alias("n_pretokens"), F.col("id.tokens").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.col("encoded").alias("n_encoded"), F.col("text").alias("edited"))

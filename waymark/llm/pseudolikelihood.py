"""Language-model scores by masked pseudo-likelihood.

Each word in turn is masked and predicted from the words on both sides; a document's score is the sum of the conditional
log-probabilities of all its words. A window network reads the SIDE neighbours on either side, each by an embedding of its own, through a
tanh layer, and predicts a token in two steps, P(class | window) P(token | class, window), both of them softmax layers over the same
hidden units.

Tokens are the most frequent words of the corpus and, for all other words, their spelled ending: the last two bytes, or the
last one where that ending is rare. The network sees its neighbours by the same tokens. Given an ending, a word has its exact share of that ending's
occurrences in the whole corpus: log P(word | window) = log P(ending | window) + log(n / (m + 1)), where n and m are counts of the word and
of all words of that ending. What is left of the ending goes to words that the corpus does not have, spelled byte by byte with equal
chances. So the probabilities of all words add up to one at most.

Spark counts every word of every document by its text; these tables grow with the corpus. The counts of the most frequent words
go along with the tasks, all others are joined. The network is fitted to the windows of all words of every document. Where there are more
than WINDOWS of them, their tokens are dealt over tasks by hashes; each task goes on from the same network with its own windows, and the networks'
mean, by windows, is what the next round goes on from. Each window is read in one of the rounds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import _STEP, Words, hashes, mixed, split
from .common import materialise, pieces, small_batches, utf8

#: Words that are tokens of the network, endings of two bytes, and words whose counts go along with the tasks.
NETWORK_WORDS, ENDINGS, ALONG = 4096, 512, 1 << 18
SIDE, CLASSES, HIDDEN = 2, 64, 32
#: Windows up to which the driver fits the network, and its passes over them.
WINDOWS, PASSES = 1 << 19, 2
#: With more windows: those of a shard in all rounds, the rounds (each reads twice as many as the one before), and how many words are dealt together.
SHARD, ROUNDS, STRETCH = 1 << 23, 4, 1 << 10
#: Learning rates from round to round, and windows of a batch at most.
RATES, BATCH = (0.04, 0.03, 0.03, 0.03, 0.002), 1 << 15
#: Rows of which the networks of a round are made, each of which is averaged in a task.
BLOCKS = 16
#: Words that a task counts before it hands the counts on, and rows of one matrix product.
COUNTED, ROWS = 1 << 19, 1 << 12
#: Log-probability of a byte, or of the end, of a word that the corpus does not have.
BYTE = -float(np.log(257))


@dataclass
class Vocabulary:
    """Tokens are numbered by falling counts; len(counts) stands for what lies beyond a text's end."""

    seed: int
    keys: np.ndarray  # sorted hashes of the words that go along
    token: np.ndarray  # their tokens
    own: np.ndarray  # log counts of those that are no token, else 0
    ending: np.ndarray  # (65536,) token by the last two bytes, the very last one high
    single: np.ndarray  # (256,) token by the last byte, of words of one byte
    counts: np.ndarray  # occurrences of each token, one more for endings
    share: np.ndarray  # log counts of the endings, 0 for words

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token of each word, log of its share of the token but for the count of words that do not go along, and whether it is such a word."""
        if not len(words.start):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        last = words.data[words.end - 1].astype(np.int64)
        long = words.end - words.start > 1
        token = np.where(long, self.ending[last << 8 | words.data[np.maximum(words.end - 2, 0)]], self.single[last])
        share, missed = -self.share[token], np.ones(len(token), bool)
        if len(self.keys):
            key = hashes(words, self.seed)
            order = np.argsort(key)  # sorted keys are found faster
            at = np.empty(len(key), np.int64)
            at[order] = np.minimum(np.searchsorted(self.keys, key[order]), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == key)
            missed[hit] = False
            token[hit] = self.token[at[hit]]
            share[hit] = self.own[at[hit]] - self.share[token[hit]]
        return token, share, missed


@dataclass
class Network:
    """cuts: where classes start and end among the tokens. Weights: embeddings (2 SIDE, tokens + 1, HIDDEN) and layers over HIDDEN units."""

    cuts: np.ndarray
    embed: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray

    def hidden(self, windows: np.ndarray) -> np.ndarray:
        total = self.embed[0].take(windows[:, 0], 0)
        for i in range(1, len(self.embed)):
            total += self.embed[i].take(windows[:, i], 0)
        total += self.bias
        return np.tanh(total, out=total)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.bias, self.out, self.out_bias, self.inner, self.inner_bias]

    def by_class(self, targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """The class of each of some sorted targets, and for each class that occurs where its targets and its tokens start and end."""
        kind = np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))[targets]
        edge = np.flatnonzero(np.diff(kind, prepend=-1, append=-1)).tolist()
        return kind, [(i, j, int(self.cuts[kind[i]]), int(self.cuts[kind[i] + 1])) for i, j in zip(edge[:-1], edge[1:])]

    def logs(self, windows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """The log-probability of each target within its window."""
        found = np.zeros(len(targets), np.float32)
        order = np.argsort(targets, kind="stable")
        for a in range(0, len(targets), ROWS):
            at = order[a : a + ROWS]
            own, hidden = targets[at], self.hidden(windows[at])
            kind, spans = self.by_class(own)
            z = hidden @ self.out + self.out_bias
            got = z[np.arange(len(own)), kind]
            norm = np.exp(z, out=z) @ np.ones(z.shape[1], np.float32)
            for i, j, b, e in spans:
                y = hidden[i:j] @ self.inner[:, b:e] + self.inner_bias[b:e]
                got[i:j] += y[np.arange(j - i), own[i:j] - b] - np.log(np.exp(y, out=y) @ np.ones(e - b, np.float32))
            found[at] = got - np.log(norm)
        return found


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network
    rare: DataFrame | None  # (word, n) of the words that do not go along; none if there are none


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n): how often each word occurs in all texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in pieces(batches, "text"):
            for text in utf8(batch.column(0)):
                total.update(text.split())
            if len(total) > COUNTED:
                yield pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.binary()), "n": pa.array(total.values(), pa.int64())})
                total.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.binary()), "n": pa.array(total.values(), pa.int64())})

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counted: DataFrame, words: int = NETWORK_WORDS, endings: int = ENDINGS, along: int = ALONG) -> tuple[Vocabulary, DataFrame | None]:
    """The vocabulary of (word, n), with at most about `along` words that go along besides the tokens, and the words that do not."""
    first = counted.orderBy(F.desc("n"), "word").limit(words).toArrow()
    known = dict(zip(first.column("word").to_pylist(), first.column("n").to_pylist()))
    # at most 65,792 endings, and one row for each count that occurs
    by_end = counted.groupBy(F.substring("word", -2, 2).alias("end")).agg(F.sum("n").alias("n")).toArrow()
    rest = dict(zip(by_end.column("end").to_pylist(), by_end.column("n").to_pylist()))
    for w, n in known.items():
        rest[w[-2:]] -= n
    pairs = sorted((e for e in rest if len(e) == 2 and rest[e] > 0), key=lambda e: (-rest[e], e))[:endings]
    units = {e: rest[e] + 1 for e in pairs} | {bytes([b]): 1 for b in range(256)}
    for e, n in rest.items():
        if e not in units or len(e) == 1:
            units[e[-1:]] += n
    tokens = sorted([*((n, w, True) for w, n in known.items()), *((n, e, False) for e, n in units.items())], key=lambda t: (-t[0], t[2], t[1]))
    place = {(w, whole): i for i, (_, w, whole) in enumerate(tokens)}
    counts = np.array([t[0] for t in tokens], np.int64)
    single = np.array([place[bytes([b]), False] for b in range(256)], np.int64)
    ending = np.repeat(single, 256)
    for e in pairs:
        ending[e[1] << 8 | e[0]] = place[e, False]
    share = np.array([0.0 if whole else np.log(n) for n, _, whole in tokens])

    levels = counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toArrow()
    upto = np.cumsum(levels.column("words").to_numpy())
    least = int(levels.column("n")[int((upto <= along).sum())].as_py()) if len(upto) and upto[-1] > along else 0
    listed = counted.where(F.col("n") > least).toArrow()
    numbers = dict(zip(listed.column("word").to_pylist(), listed.column("n").to_pylist())) | known
    names, joined = list(numbers), split([b" ".join(numbers)])
    seed, keys = 6, hashes(joined, 6)
    while len(np.unique(keys)) < len(names):  # two words with one hash: take another
        seed += 1
        keys = hashes(joined, seed)
    order = np.argsort(keys)
    of = np.array([place[w, True] if w in known else ending[w[-1] << 8 | w[-2]] if len(w) > 1 else single[w[0]] for w in names], np.int64)
    own = np.array([0.0 if w in known else np.log(numbers[w]) for w in names])
    made = Vocabulary(seed, keys[order], of[order], own[order], ending, single, counts, share)
    return made, counted.where(F.col("n") <= least) if least else None


def windows(tokens: np.ndarray, count: np.ndarray, beyond: int) -> np.ndarray:
    """(words, 2 SIDE): the tokens around each word, from all tokens and the words of each text; `beyond` is outside its text."""
    owner, n = np.repeat(np.arange(len(count)), count), len(tokens)
    out = np.full((n, 2 * SIDE), beyond, np.int64)
    for column, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        index = np.arange(max(0, -shift), max(0, n - max(0, shift)))
        same = index[owner[index] == owner[index + shift]]
        out[same, column] = tokens[same + shift]
    return out


def start(counts: np.ndarray, seed: int = 9) -> Network:
    """A network that gives each token its share of the counts, with classes of about equal sums of root counts."""
    rng, tokens = np.random.default_rng(seed), len(counts)
    upto = np.cumsum(np.sqrt(counts))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(upto, upto[-1] * np.arange(1, CLASSES) / CLASSES) + 1, [tokens]]).clip(0, tokens))
    total = np.add.reduceat(counts.astype(np.float64), cuts[:-1])
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    within = np.log(counts / np.repeat(total, np.diff(cuts)))
    return Network(
        cuts, small(2 * SIDE, tokens + 1, HIDDEN), np.zeros(HIDDEN, np.float32), small(HIDDEN, len(cuts) - 1), np.log(total / total.sum()).astype(np.float32), small(HIDDEN, tokens), within.astype(np.float32)
    )


def descend(net: Network, look: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, batch: int, rates: tuple[float, float], passes: int = 1, seed: int = 9) -> None:
    """Fit a network, in place, to n windows by Adam on the cross-entropy; look(numbers) gives windows, one a column, and the tokens within them.

    The rate falls from the first to the last of `rates`.
    """
    rng, params = np.random.default_rng(seed), net.weights()
    grads, moments = [np.zeros_like(p) for p in params], [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    embed, bias, out, out_bias, inner, inner_bias = grads
    steps, step = passes * -(-n // batch), 0
    for _ in range(passes):
        shuffled = rng.permutation(n)
        for a in range(0, n, batch):
            x, y = look(shuffled[a : a + batch])
            order = np.argsort(y, kind="stable")
            x, y, backs = x.astype(np.intp).take(order, 1), y[order].astype(np.intp), np.empty((len(bias), len(y)))
            for g in grads:
                g[...] = 0
            for b in range(0, len(y), ROWS):
                own, hidden = y[b : b + ROWS], net.hidden(x[:, b : b + ROWS].T)
                kind, spans = net.by_class(own)
                wrong = hidden @ net.out
                wrong += net.out_bias
                np.exp(wrong, out=wrong)
                wrong /= (wrong @ np.ones(wrong.shape[1], np.float32))[:, None]
                wrong[np.arange(len(own)), kind] -= 1
                back = wrong @ net.out.T
                out += hidden.T @ wrong
                out_bias += np.ones(len(own), np.float32) @ wrong
                for i, j, first, last in spans:
                    part, weights = hidden[i:j], net.inner[:, first:last]
                    q = part @ weights
                    q += net.inner_bias[first:last]
                    np.exp(q, out=q)
                    q /= (q @ np.ones(last - first, np.float32))[:, None]
                    q[np.arange(j - i), own[i:j] - first] -= 1
                    inner[:, first:last] += part.T @ q
                    inner_bias[first:last] += np.ones(j - i, np.float32) @ q
                    back[i:j] += q @ weights.T
                hidden *= hidden
                back *= np.subtract(1, hidden, out=hidden)
                backs[:, b : b + ROWS] = back.T
            bias += backs.sum(1)
            for i in range(2 * SIDE):
                for unit, back in enumerate(backs):
                    embed[i, :, unit] = np.bincount(x[i], back, embed.shape[1])
            step += 1
            now = (rates[0] + (rates[1] - rates[0]) * step / steps) / (1 - 0.9**step) * (1 - 0.99**step) ** 0.5
            for p, g, (m, v) in zip(params, grads, moments):
                g *= np.float32(1 / len(y))
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                g *= g
                g *= 0.01
                v += g
                np.sqrt(v, out=g)
                g += 1e-7
                np.divide(m, g, out=g)
                g *= np.float32(now)
                p -= g


def train(around: np.ndarray, targets: np.ndarray, counts: np.ndarray, passes: int = PASSES, batch: int = 2048, least_steps: int = 60, rate: float = 0.01, seed: int = 9) -> Network:
    """A network for windows and the tokens within them; few windows are gone through more often."""
    net = start(counts, seed)
    if len(targets):
        passes = max(passes, -(-least_steps // -(-len(targets) // batch)))
        descend(net, lambda own: (around[own].T, targets[own]), len(targets), batch, (rate, 0.1 * rate), passes, seed)
    return net


def dealt(docs: DataFrame, known: Vocabulary, shards: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(round, shard, h, at, tokens): the tokens of all texts, cut into stretches of STRETCH words that have SIDE more on either side, by hashes.

    `at` is a stretch's number in its text, of which h is a hash, with its id. So the same rows are dealt alike, whatever files and partitions they come in.
    """
    beyond = len(known.counts)
    kind, ends = np.min_scalar_type(beyond), np.full(SIDE, beyond)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = split(utf8(batch.column(0)))
            tokens = known.read(words)[0]
            count = -(-words.count // STRETCH)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            h = np.repeat(batch.column(1).to_numpy(), count)
            place = mixed(mixed(h.view(np.uint64)) + at.astype(np.uint64) * np.uint64(_STEP))
            turn = np.searchsorted(2 ** np.arange(1, ROUNDS) - 1, (place >> np.uint64(32)) % np.uint64(2**ROUNDS - 1), "right")
            made = []
            for first, n in zip(words.first.tolist(), words.count.tolist()):
                text = np.concatenate([ends, tokens[first : first + n], ends]).astype(kind)
                made += [text[a : a + STRETCH + 2 * SIDE].tobytes() for a in range(0, n, STRETCH)]
            shard = (place & np.uint64(0xFFFFFFFF)) % np.uint64(shards)
            yield pa.RecordBatch.from_arrays([pa.array(turn.astype(np.int32)), pa.array(shard.astype(np.int32)), pa.array(h), pa.array(at), pa.array(made, pa.binary())], ["round", "shard", "h", "at", "tokens"])

    return docs.select(F.col(text_col).alias("text"), _key(docs, text_col, id_col)).mapInArrow(run, "round int, shard int, h long, at long, tokens binary")


def go_on(net: Network, stretches: list[np.ndarray], rates: tuple[float, float], seed: int) -> int:
    """Fit a network, in place, to all windows of stretches of tokens, each of which it reads once; their number."""
    if not stretches:
        return 0
    upto = np.cumsum([0, *map(len, stretches)]).tolist()
    tokens, where = np.concatenate(stretches), np.concatenate([np.arange(a + SIDE, b - SIDE, dtype=np.int32) for a, b in zip(upto, upto[1:])])

    def look(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.sort(where[rows])
        return np.stack([tokens.take(at + i) for i in [*range(-SIDE, 0), *range(1, SIDE + 1)]]), tokens[at]

    descend(net, look, len(where), min(BATCH, max(256, len(where) // 64)), rates, seed=seed)
    return len(where)


def fit(stretches: DataFrame, known: Vocabulary, shards: int) -> Network:
    """A network for all windows of what dealt() gives: in each round every shard's task goes on from one network, and the mean of theirs is the next.

    Only the network, of fixed size, passes through the driver.
    """
    net, kind = start(known.counts), np.min_scalar_type(len(known.counts))
    shapes = [p.shape for p in net.weights()]

    def unpacked(flat: np.ndarray) -> Network:
        return Network(net.cuts, *[w.reshape(shape) for w, shape in zip(np.split(flat, np.cumsum([np.prod(s) for s in shapes])[:-1]), shapes)])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block, n = 0.0, 0, 0
        for b in batches:
            for block, own, flat in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                total, n = total + own * np.frombuffer(flat, np.float32).astype(np.float64), n + own
        if n:
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "flat": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})

    flat = np.concatenate([p.ravel() for p in net.weights()])
    for turn in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], flat: np.ndarray = flat, turn: int = turn) -> Iterator[pa.RecordBatch]:
            own, shard, n, parts, held = unpacked(flat.copy()), 0, 0, [], 0
            for b in batches:
                shard = b.column(0)[0].as_py() if b.num_rows else shard
                parts += [np.frombuffer(t, kind) for t in b.column(1).to_pylist()]
                held += sum(map(len, parts[len(parts) - b.num_rows :]))
                if held >= SHARD:  # so many only where rows are equal in id and text, as these meet in one shard
                    n, parts, held = n + go_on(own, parts, RATES[turn : turn + 2], shard * ROUNDS + turn), [], 0
            n += go_on(own, parts, RATES[turn : turn + 2], shard * ROUNDS + turn)
            if not n:
                return
            for i, piece in enumerate(np.array_split(np.concatenate([p.ravel() for p in own.weights()]), BLOCKS)):
                yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "shard": pa.array([shard], pa.int32()), "n": pa.array([n], pa.int64()), "flat": pa.array([piece.tobytes()], pa.binary())})

        rows = stretches.where(F.col("round") == turn).repartitionById(shards, F.col("shard")).sortWithinPartitions("h", "at").select("shard", "tokens")
        made = rows.mapInArrow(run, "block int, shard int, n long, flat binary").repartitionById(BLOCKS, F.col("block")).sortWithinPartitions("shard")
        got = sorted(made.mapInArrow(mean, "block int, flat binary").collect(), key=lambda r: r.block)
        if got:  # else no stretch fell to this round
            flat = np.frombuffer(b"".join(bytes(r.flat) for r in got), np.float32)
    return unpacked(flat)


def _key(docs: DataFrame, text_col: str, id_col: str) -> Column:
    return F.xxhash64(*[c for c in (id_col, text_col) if c in docs.columns], F.lit(9)).alias("h")


def drawn(docs: DataFrame, known: Vocabulary, text_col: str, total: int, most: int = WINDOWS, id_col: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Windows and their words' tokens, all of them or about `most`: one of eight of the words of texts that are drawn by a hash of id and text.

    The same rows give the same windows in the same order, whatever files and partitions they come in.
    """
    chance = min(1.0, most / max(1, total))
    texts = min(1.0, 8 * chance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = split(utf8(batch.column(0)))
            tokens = known.read(words)[0]
            even = [np.random.default_rng(h & (2**64 - 1)).random(n) for h, n in zip(batch.column(1).to_pylist(), words.count.tolist())]
            chosen = np.flatnonzero(np.concatenate([np.zeros(0), *even]) < chance / texts)
            rows = np.column_stack([windows(tokens, words.count, len(known.counts)), tokens])[chosen].astype(np.int32)
            yield pa.RecordBatch.from_pydict({"window": pa.array([rows.tobytes()], pa.binary())})

    some = docs.select(F.col(text_col).alias("text"), _key(docs, text_col, id_col)).where(F.pmod("h", F.lit(1 << 30)) < texts * (1 << 30))
    found = np.frombuffer(b"".join(some.mapInArrow(run, "window binary").toArrow().column(0).to_pylist()), np.int32).reshape(-1, 2 * SIDE + 1).astype(np.int64)
    found = found[np.lexsort(found.T)]
    return found[:, :-1], found[:, -1]


def learn(
    docs: DataFrame, text_col: str = "text", words: int = NETWORK_WORDS, endings: int = ENDINGS, along: int = ALONG, most: int = WINDOWS, id_col: str = "doc_id", shard: int = SHARD
) -> Model:
    """Counts of all words of every document, then the network, fitted to all windows: on the driver if they are `most` at most, else in tasks that read about `shard` each."""
    small_batches(docs.sparkSession)
    counted = materialise(count_words(docs, text_col), "words")
    known, rare = vocabulary(counted, words, endings, along)
    total = counted.agg(F.sum("n")).first()[0] or 0
    if total <= most:
        return Model(known, train(*drawn(docs, known, text_col, total, total, id_col), known.counts), rare)
    shards = -(-total // shard)
    return Model(known, fit(materialise(dealt(docs, known, shards, text_col, id_col), "stretches"), known, shards), rare)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_likelihood): words and summed conditional log-probabilities of each whole text.

    Null and blank texts have no words and score 0. Rows with equal ids are scored one by one; other columns are ignored. What
    goes along with the tasks is the network and the most frequent words, about 10 MB; other words are joined to their counts, and words
    that the model's corpus does not have are spelled.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    known, net, joins = model.vocabulary, model.network, model.rare is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = split(utf8(batch.column("text")))
            tokens, share, missed = known.read(words)
            owner, n = np.repeat(np.arange(len(words.count)), words.count), len(words.count)
            logs = net.logs(windows(tokens, words.count, len(known.counts)), tokens) + share
            left = np.flatnonzero(missed)
            if not joins:
                logs[left] += BYTE * (words.end - words.start + 1)[left]
                left = left[:0]
            data = words.data.tobytes()
            spelled = pa.array([data[a:b] for a, b in zip(words.start[left].tolist(), words.end[left].tolist())], pa.binary())
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[left], np.arange(n + 1)).astype(np.int32)), spelled)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(words.count.astype(np.int64)), pa.array(np.bincount(owner, logs, n)), listed], ["id", "row", "n_tokens", "log_likelihood", "missed"]
            )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = texts.mapInArrow(run, f"id {kind}, row long, n_tokens long, log_likelihood double, missed array<binary>")
    if not joins:
        return rows.select("id", "n_tokens", "log_likelihood")
    rows = materialise(rows, "scored")
    places = rows.select("row", F.explode("missed").alias("word")).join(model.rare, "word", "left")
    more = places.groupBy("row").agg(F.sum(F.coalesce(F.ln("n"), BYTE * (F.length("word") + 1))).alias("more"))
    return rows.join(more, "row", "left").select("id", "n_tokens", (F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))

"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of a fixed window, each is max-pooled over the window, and a softmax layer
gives the languages. Training is plain numpy: Adam on the cross-entropy of windows from a bounded sample of
labelled texts. A text is cut into consecutive windows, all of which count; its probabilities are the mean over its
windows, weighted by their bytes and by how sure the network is of each: a window of repeated junk says little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, utf8, with_columns

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Labelled texts that training reads for each language, about so many at most, and windows that it takes of each.
PER_LANGUAGE, PER_TEXT = 600, 3
#: Bounds of the whole sample: languages, the most frequent first, and texts.
LANGUAGES, TEXTS = 1000, 24_000
UNDETERMINED = "und"


@dataclass
class Network:
    """filters[i][k]: (256, FILTERS) weights of the k-th byte under the filters of WIDTHS[i]; bias, then the softmax layer."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Max-pooled filters of (n, WINDOW) bytes, and the positions of the maxima if asked for."""
        n, best, at = len(windows), [], []
        for i, width in enumerate(WIDTHS):
            size = WINDOW - width + 1
            total = self.filters[i][0][windows[:, :size]]
            for k in range(1, width):
                total += self.filters[i][k][windows[:, k : k + size]]
            if where:
                top = total.argmax(1)
                at.append(top)
                best.append(np.take_along_axis(total, top[:, None, :], 1)[:, 0])
            else:
                best.append(total.max(1))
        x = np.concatenate(best, 1) if n else np.zeros((0, len(WIDTHS) * FILTERS), np.float32)
        return np.maximum(x + self.bias, 0), np.concatenate(at, 1) if where else None

    def probabilities(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes of each): consecutive windows, the last of a text padded with zeros."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    padded = b"".join([t.ljust(int(c) * WINDOW, b"\0") for t, c in zip(texts, counts)])
    owner = np.repeat(np.arange(len(texts)), counts)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = np.minimum(np.array([len(t) for t in texts], np.int64)[owner] - rank * WINDOW, WINDOW)
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW), owner, sizes


def train(rows: list[tuple[str, bytes]], epochs: int = 8, batch: int = 128, least_steps: int = 240, seed: int = 5) -> Network:
    """A network for (language, text) rows; languages count alike, however many rows each has.

    Few rows are gone through more often, until least_steps batches have been seen.
    """
    rng, languages = np.random.default_rng(seed), sorted({lang for lang, _ in rows})
    windows, labels = [], []
    for lang, text in rows:
        own = cut([text])[0]
        for i in rng.permutation(len(own))[:PER_TEXT]:
            windows.append(own[i])
            labels.append(languages.index(lang))
    net = Network(
        languages,
        [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, max(1, len(languages)))).astype(np.float32),
        np.zeros(max(1, len(languages)), np.float32),
    )
    if not windows:
        return net
    x, y = np.stack(windows), np.array(labels)
    share = np.bincount(y, minlength=len(languages))
    weight = (len(y) / (len(languages) * np.maximum(share, 1)))[y].astype(np.float32)
    params = [*net.filters, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(max(epochs, -(-least_steps // -(-len(x) // batch)))):
        order = rng.permutation(len(x))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            hidden, at = net.pooled(x[own], True)
            p = net.probabilities(hidden)
            p[np.arange(len(own)), y[own]] -= 1
            p *= weight[own][:, None] / len(own)
            back = (p @ net.out.T) * (hidden > 0)
            grads = []
            for i, width in enumerate(WIDTHS):
                g, cols = np.zeros_like(net.filters[i]), slice(i * FILTERS, (i + 1) * FILTERS)
                place = at[:, cols]
                for k in range(width):
                    seen = np.take_along_axis(x[own], place + k, 1)
                    np.add.at(g[k], (seen.ravel(), np.tile(np.arange(FILTERS), len(own))), back[:, cols].ravel())
                grads.append(g)
            grads += [back.sum(0), hidden.T @ p, p.sum(0)]
            step += 1
            for param, grad, (m, v) in zip(params, grads, moments):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                param -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """(language, window): PER_TEXT windows of about per_language texts of each language, by hashes of ids and texts, of rows that are not held out.

    The sample is bounded by about TEXTS texts in all, so that many languages have fewer each; only the LANGUAGES most frequent values are
    learnt, as a column of names that are all different tells nothing of languages.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col, F.lit(5)).alias("h"), held_out(id_col).alias("held"))
    seen = rows.where("NOT held AND lang IS NOT NULL AND text <> ''").select("lang", "text", "h")
    counts = seen.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    per_language = max(1, min(per_language, TEXTS // max(1, len(counts))))
    known = docs.sparkSession.createDataFrame([(r.lang, r.n) for r in counts], "lang string, n long")  # at most LANGUAGES rows
    near = F.pmod("h", F.lit(1 << 30)) * F.col("n") < per_language * (1 << 30)
    chosen = seen.join(F.broadcast(known), "lang").where(near).select("lang", "text", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found: list[tuple] = []
            for lang, text, h in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), batch.column("h").to_pylist()):
                own = cut([text])[0]
                found += [(lang, own[i].tobytes(), h) for i in sorted(np.random.default_rng(h & (2**64 - 1)).permutation(len(own))[:PER_TEXT])]
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()))], ["lang", "window", "h"])

    found = chosen.mapInArrow(run, "lang string, window binary, h long").sort("h", "window").toArrow()
    return list(zip(found.column("lang").to_pylist(), found.column("window").to_pylist()))


def judged(texts: list[bytes], net: Network) -> tuple[list[str], list[float]]:
    """The language and score of each whole text."""
    windows, owner, sizes = cut(texts)
    total, weights = np.zeros((len(texts), len(net.out_bias))), np.zeros(len(texts))
    for a in range(0, len(windows), 1024):
        p = net.probabilities(net.pooled(windows[a : a + 1024])[0]).astype(np.float64)
        # 1 for a sure window, 0 for one that fits all languages alike; some weight stays if no window is sure
        sure = 1 + (p * np.log(np.maximum(p, 1e-12))).sum(1) / np.log(max(2, p.shape[1]))
        weight = sizes[a : a + 1024] * (np.maximum(sure, 0) ** 2 + 1e-6)
        np.add.at(total, owner[a : a + 1024], p * weight[:, None])
        np.add.at(weights, owner[a : a + 1024], weight)
    total /= np.maximum(weights, 1e-300)[:, None]
    best = total.argmax(1)
    known = [bool(net.languages) and any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in texts]
    names = [net.languages[i] if ok else UNDETERMINED for i, ok in zip(best, known)]
    return names, [float(min(1.0, row[i])) if ok else 0.0 for row, i, ok in zip(total, best, known)]


def identify(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score: the most probable language of each whole text, and its probability.

    A text that is null or has no letter is `und` with score 0, as is every text if the network knows no language. Each
    row is judged by its text alone; columns named lang_pred or score are replaced.
    """

    def compute(texts: list[bytes]) -> list[pa.Array]:
        names, scores = judged(texts, net)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return with_columns(docs, text_col, "lang_pred string, score double", compute)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    return train(training_rows(docs, id_col, text_col, lang_col))

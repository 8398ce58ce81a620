"""Personal data by patterns and by a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field labels words as beginning or continuing an e-mail address, IP address, card number,
phone number or secret (key, password, token), or as other. It is trained in numpy from a small labelled table
(`labelled_table`) and decoded by Viterbi, many sequences at a time. A sequence is an island: words that hold a digit or
one of @ = +, with CONTEXT words on either side; the table has no label outside islands. Spans of the field are
added where they touch no base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import Words, split
from .common import pieces, small_batches, utf8, with_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Label 0 is other; 2k + 1 begins and 2k + 2 continues kind k.
LABELS = 1 + 2 * len(KINDS)
CONTEXT = 3
#: Words of a sequence that are decoded at once, and those on either side that are decoded with them.
STRETCH, OVERLAP = 1024, 64

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match from inside a run of digits would go on as one from the run's start, so only starts of runs are tried
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i & 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; from each @ back over the local part, which takes time in proportion to the text."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        m = DOMAIN.match(text, at) if a < at else None
        if m:
            last = m.end()
            found.append((a, last))
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    spans = [("email", a, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        small = lambda part: len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255
        spans += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d):
                spans.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                spans.append(("phone", *m.span()))
    return spans


# -- word shapes ---------------------------------------------------------------------------------------------------------

#: Characters whose presence in a word is a feature, and bucket bounds of counts.
MARKS = b"@.-=+(\"':/#_"
BOUNDS = {"length": (1, 2, 4, 7, 12, 18, 30), "digits": (0, 1, 2, 3, 4, 6, 9, 15, 19), "upper": (0, 1, 4, 12), "lower": (0, 1, 3, 8), "turns": (0, 1, 2, 4, 8)}
SIZES = [8, 8, *[len(b) + 1 for b in BOUNDS.values()], *[2] * len(MARKS)]
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])
#: Features of the word, of those before and after it, and of the edge of a sequence.
WIDTH = int(OFFSETS[-1])

_CLASS = np.full(256, 7, np.int64)
_CLASS[128:] = 3
for _c, _of in ((0, b"0123456789"), (1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"abcdefghijklmnopqrstuvwxyz"), (4, b".,;:!?"), (5, b"\"'([{"), (6, b"+-=@")):
    _CLASS[list(_of)] = _c


def shapes(words: Words, chosen: np.ndarray) -> np.ndarray:
    """The features of the chosen words, (words, features), as columns of a table of WIDTH weights each."""
    start, end = words.start[chosen], words.end[chosen]
    if not len(chosen):
        return np.zeros((0, len(SIZES)), np.int64)
    length = end - start
    at = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    data, first = words.data[at], np.cumsum(length) - length
    kind = _CLASS[data]
    total = lambda x: np.add.reduceat(x.astype(np.int64), first)
    turn = np.concatenate([[False], kind[1:] != kind[:-1]])
    turn[first] = False
    counts = {"length": length, "digits": total(kind == 0), "upper": total(kind == 1), "lower": total(kind == 2), "turns": total(turn)}
    columns = [kind[first], kind[first + length - 1], *[np.searchsorted(BOUNDS[k], counts[k]) for k in BOUNDS]]
    columns += [total(data == m) > 0 for m in MARKS]
    return np.stack([c.astype(np.int16) + np.int16(o) for c, o in zip(columns, OFFSETS)], 1)


def evidence(words: Words) -> np.ndarray:
    """Whether each word holds a digit or one of @ = +."""
    hot = np.zeros(256, bool)
    hot[list(b"0123456789@=+")] = True
    upto = np.concatenate([[0], np.cumsum(hot[words.data])])
    return upto[words.end] > upto[words.start]


def islands(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each island, within texts."""
    hits = np.flatnonzero(evidence(words))
    owner = np.repeat(np.arange(len(words.count)), words.count)
    edge = np.cumsum(words.count)
    a = np.maximum(hits - CONTEXT, (edge - words.count)[owner[hits]])
    b = np.minimum(hits + CONTEXT + 1, edge[owner[hits]])
    new = np.ones(len(hits), bool)
    new[1:] = (a[1:] > b[:-1]) | (owner[hits][1:] != owner[hits][:-1])
    begin = a[new]
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hits) - 1]]) if len(hits) else np.zeros(0, np.int64)
    return begin, b[last] - begin


class Field:
    """Weights of a linear-chain conditional random field: word, neighbours before and after, transitions, start."""

    def __init__(self, weights: np.ndarray):
        cut = 3 * (WIDTH + 1) * LABELS
        self.emit = weights[:cut].reshape(3, WIDTH + 1, LABELS)
        self.move = weights[cut : cut + LABELS * LABELS].reshape(LABELS, LABELS)
        self.open = weights[cut + LABELS * LABELS :]

    size = 3 * (WIDTH + 1) * LABELS + LABELS * LABELS + LABELS

    def scores(self, features: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """(words, labels); features of words in a row, first and last mark the ends of sequences."""
        own, before, after = (np.zeros((len(features), LABELS)) for _ in range(3))
        for i, total in enumerate((own, before, after)):
            for column in features.T:  # one feature at a time, so that memory keeps to a few times the result
                total += self.emit[i].take(column, 0)
        before, after = np.roll(before, 1, 0), np.roll(after, -1, 0)
        before[first], after[last] = self.emit[1][WIDTH], self.emit[2][WIDTH]
        return own + before + after

    def viterbi(self, scores: np.ndarray, begin: np.ndarray, size: np.ndarray, cells: int = 1 << 17) -> np.ndarray:
        """The best labels of all words; sequences of similar size are decoded together, as many as fit into rows x longest <= cells, or one.

        Those longer than STRETCH are decoded in stretches that reach OVERLAP words beyond either side, where nothing is kept.
        """
        labels = np.zeros(len(scores), np.int64)
        count = -(-size // STRETCH)
        of = np.repeat(np.arange(len(size)), count)
        low = begin[of] + STRETCH * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
        high = np.minimum(low + STRETCH, (begin + size)[of])
        begin, size = np.maximum(low - OVERLAP, begin[of]), np.minimum(high + OVERLAP, (begin + size)[of])
        size = size - begin
        order = np.argsort(size, kind="stable")
        upto = 0
        while upto < len(order):
            i, longest = upto, size[order]
            upto = i + 1 + int(np.searchsorted(longest[i + 1 :] * np.arange(2, len(order) - i + 1), cells, "right"))
            own = order[i:upto]
            a, n = begin[own], size[own]
            back = np.zeros((len(own), int(n.max(initial=0)), LABELS), np.int8)
            best = scores[a] + self.open
            for t in range(1, back.shape[1]):
                live = n > t
                step = best[live][:, :, None] + self.move
                back[live, t] = step.argmax(1)
                best[live] = step.max(1) + scores[a[live] + t]
            now = best.argmax(1)
            for t in range(back.shape[1] - 1, -1, -1):
                live = np.flatnonzero(n > t)
                place = a[live] + t
                kept = (place >= low[own[live]]) & (place < high[own[live]])
                labels[place[kept]] = now[live[kept]]
                now[live] = back[live, t, now[live]]
        return labels


# -- the labelled table ----------------------------------------------------------------------------------------------------


def labelled_rows(n: int = 400, seed: int = 2) -> list[tuple[int, str, str]]:
    """(id, text, spans as kind:start:end): invented sentences; n bounds the table."""
    rng = np.random.default_rng(seed)
    pick = lambda s, a, b: "".join(rng.choice(list(s), int(rng.integers(a, b + 1))))
    digits, small, large = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def word() -> str:
        w = pick(small + "aeiouéüñ", 1, 10)
        turn = rng.random()
        w = w.upper() if turn < 0.08 else w.capitalize() if turn < 0.25 else w
        return w + rng.choice(["", "", "", "", ".", ",", "!!", ":"])

    def number() -> str:  # not personal
        return str(
            rng.choice(
                [pick(digits, 1, 6), f"{pick(digits, 1, 2)}.{pick(digits, 1, 2)}", str(rng.integers(1900, 2040)) + ".", f"{pick(digits, 1, 3)}%", f"${pick(digits, 1, 4)}.{pick(digits, 2, 2)}",
                 f"{pick(small, 2, 6)}{pick(digits, 1, 2)}", f"{pick(digits, 1, 2)}:{pick(digits, 2, 2)}", f"{pick(digits, 4, 4)}-{pick(digits, 2, 2)}-{pick(digits, 2, 2)}", f"x={pick(digits, 1, 2)}", "=", "+", "@", f"@{pick(small, 3, 8)}",
                 f"{pick(small, 2, 5)}={pick(small, 1, 5)}"]
            )
        )

    def personal() -> tuple[str, str]:
        kind = KINDS[int(rng.integers(len(KINDS)))]
        if kind == "email":
            return kind, f"{pick(small, 2, 9)}{rng.choice(['', '.', '_'])}{pick(small + digits, 1, 5)}@{pick(small + digits, 3, 8)}.{rng.choice(['com', 'example.com', 'org', 'net'])}"
        if kind == "ip":
            return kind, ".".join(str(rng.integers(0, 256)) for _ in range(4))
        if kind == "card":
            d = pick(digits, 16, 16)
            return kind, d if rng.random() < 0.5 else rng.choice([" ", "-"]).join(d[i : i + 4] for i in range(0, 16, 4))
        if kind == "phone":
            a, b, c = pick(digits, 3, 3), pick(digits, 3, 3), pick(digits, 4, 4)
            return kind, str(rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{pick(digits, 1, 2)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}"]))
        code = pick("0123456789abcdef", 16, 40)
        return kind, str(rng.choice([f"password={code[:20]}", f"AKIA{pick(large + digits, 16, 16)}", f'token = "{code}"', f"api_key={code}", f"secret: {code}", f"passwd={pick(small + digits, 8, 14)}"]))

    rows = []
    for i in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(6, 16))):
            turn = rng.random()
            if turn < 0.12:
                kind, found = personal()
                spans.append(f"{kind}:{len(text)}:{len(text) + len(found)}")
                text += found + str(rng.choice(["", "", ".", ","]))
            else:
                text += number() if turn < 0.25 else word()
            text += str(rng.choice([" ", " ", " ", "\n"]))
        rows.append((i, text, ",".join(spans)))
    return rows


def labelled_table(spark: SparkSession, n: int = 400, seed: int = 2) -> DataFrame:
    return spark.createDataFrame(labelled_rows(n, seed), "id long, text string, spans string")


def points(words: Words) -> np.ndarray:
    """The code points before each byte of the buffer and its end."""
    return np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])


def _labels(words: Words, text_spans: list[str]) -> np.ndarray:
    labels, upto, at = np.zeros(len(words.start), np.int64), points(words), 0
    for spans, count in zip(text_spans, words.count.tolist()):
        for kind, a, b in (s.split(":") for s in spans.split(",") if s):
            start, end = upto[words.start[at : at + count]], upto[words.end[at : at + count]]
            inside = np.flatnonzero((start < int(b)) & (end > int(a))) + at
            labels[inside] = 2 * KINDS.index(kind) + 2
            labels[inside[:1]] -= 1
        at += count
    return labels


def train(rows: list[tuple[int, str, str]], rounds: int = 90, decay: float = 2e-3) -> Field:
    """Maximise the mean conditional log-likelihood of the rows' labels by Adam on exact gradients."""
    parts = []
    for _, text, spans in rows:
        w = split([text.encode()])
        begin, size = islands(w)
        y = _labels(w, [spans])
        for a, n in zip(begin.tolist(), size.tolist()):
            parts.append((shapes(w, np.arange(a, a + n)), y[a : a + n]))
    longest, count = max(len(y) for _, y in parts), len(parts)
    x = np.full((count, longest, len(SIZES)), WIDTH, np.int64)
    y, n = np.zeros((count, longest), np.int64), np.array([len(p[1]) for p in parts])
    for i, (f, label) in enumerate(parts):
        x[i, : len(f)], y[i, : len(f)] = f, label
    mask = np.arange(longest) < n[:, None]
    sides = [x, np.concatenate([np.full((count, 1, x.shape[2]), WIDTH), x[:, :-1]], 1), np.concatenate([x[:, 1:], np.full((count, 1, x.shape[2]), WIDTH)], 1)]
    theta, m, v = np.zeros(Field.size), np.zeros(Field.size), np.zeros(Field.size)
    rowed = np.arange(count)

    def expand(side: np.ndarray) -> np.ndarray:
        hot = np.zeros((count * longest, WIDTH + 1), np.float32)
        np.put_along_axis(hot, side.reshape(-1, side.shape[2]), 1.0, 1)
        return hot * mask.reshape(-1, 1)

    hot = [expand(s) for s in sides]
    for step in range(1, rounds + 1):
        f = Field(theta)
        e = sum(h @ w.astype(np.float32) for h, w in zip(hot, f.emit)).reshape(count, longest, LABELS).astype(np.float64)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + f.open
        for t in range(1, longest):
            z = alpha[:, t - 1, :, None] + f.move
            top = z.max(1, keepdims=True)
            alpha[:, t] = np.log(np.exp(z - top).sum(1)) + top[:, 0] + e[:, t]
        for t in range(longest - 2, -1, -1):
            z = f.move + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            top = z.max(2, keepdims=True)
            beta[:, t] = np.where(mask[:, t + 1, None], np.log(np.exp(z - top).sum(2)) + top[:, :, 0], 0.0)
        end = alpha[rowed, n - 1]
        log_z = np.log(np.exp(end - end.max(1, keepdims=True)).sum(1)) + end.max(1)
        p = np.exp(alpha + beta - log_z[:, None, None]) * mask[:, :, None]
        gold = np.zeros_like(p)
        np.put_along_axis(gold, y[:, :, None], 1.0, 2)
        gold *= mask[:, :, None]
        g_emit = [h.T @ (gold - p).reshape(-1, LABELS).astype(np.float32) for h in hot]
        g_move = np.zeros((LABELS, LABELS))
        for t in range(1, longest):
            both = np.exp(alpha[:, t - 1, :, None] + f.move + (e[:, t] + beta[:, t])[:, None, :] - log_z[:, None, None]) * mask[:, t, None, None]
            g_move -= both.sum(0)
        np.add.at(g_move, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1.0)
        g = np.concatenate([np.stack(g_emit).ravel(), g_move.ravel(), (gold - p)[:, 0].sum(0)]) / count - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta)


@cache
def default_field() -> Field:
    return train(labelled_rows())


# -- the operator ------------------------------------------------------------------------------------------------------------


def field_spans(words: Words, field: Field) -> list[list[tuple[str, int, int]]]:
    """Per text the spans of the field, in code points; quotes and sentence marks around a span are left out."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in words.count]
    begin, size = islands(words)
    if not len(begin):
        return out
    chosen = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    starts = np.cumsum(size) - size
    labels = field.viterbi(field.scores(shapes(words, chosen), starts, starts + size - 1), starts, size)
    upto, owner = points(words), np.repeat(np.arange(len(words.count)), words.count)
    hits = np.flatnonzero(labels)
    i = 0
    while i < len(hits):
        kind, j = (labels[hits[i]] - 1) // 2, i + 1
        while j < len(hits) and hits[j] == hits[j - 1] + 1 and labels[hits[j]] == 2 * kind + 2 and owner[chosen[hits[j]]] == owner[chosen[hits[i]]] and chosen[hits[j]] == chosen[hits[j - 1]] + 1:
            j += 1
        text = int(owner[chosen[hits[i]]])
        a, b = int(words.start[chosen[hits[i]]]), int(words.end[chosen[hits[j - 1]]])
        while a < b and words.data[a] in b"\"'([{":
            if words.data[a] == 0x28 and kind == 3:
                break
            a += 1
        while b > a and words.data[b - 1] in b".,;:!?\"')]}":
            b -= 1
        if b > a:
            out[text].append((KINDS[kind], a, b))
        i = j
    return [[(k, int(upto[a]), int(upto[b])) for k, a, b in spans] for spans in out]


def plausible(kind: str, found: str) -> bool:
    """What the field adds must meet the same arithmetic as the patterns' matches."""
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "ip":
        return all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in found.split(".")) and found.count(".") == 3
    return kind != "email" or "@" in found[1:-1]


def all_spans(texts: list[bytes], field: Field) -> list[tuple[list, list]]:
    """Per text its base spans and the field's spans that touch none of them."""
    words, found, at = split(texts), [], 0
    upto = points(words)
    for text, more in zip(texts, field_spans(words, field)):
        whole, before = text.decode("utf-8", "replace"), int(upto[at])
        base = base_spans(whole)
        own = [s for k, a, b in more if plausible(*(s := (k, a - before, b - before))[:1], whole[s[1] : s[2]])]
        found.append((base, [s for s in own if all(s[2] <= a or s[1] >= b for _, a, b in base)]))
        at += len(text) + 1
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def spans(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, base, spans): base and all spans as kind:start:end (code points), by kind and start, comma-joined.

    A null text is empty. Rows with equal ids are judged one by one; an empty table gives an empty result and other
    columns are ignored. The weights go along with the tasks, some tens of kilobytes.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = all_spans(utf8(batch.column(1)), field)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([joined(b) for b, _ in found]), pa.array([joined(b + m) for b, m in found])], ["id", "text", "base", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, text string, base string, spans string")


def redacted(text: str | None, spans_of: str) -> str | None:
    """text with each span replaced by its kind in brackets; of spans that overlap, the one that starts first."""
    if not text or not spans_of:
        return text
    out, at = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans_of.split(","))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """docs with every span of every text replaced by its kind in brackets; null texts stay null and other columns stay."""
    field = field or default_field()

    def compute(texts: list[bytes]) -> list[pa.Array]:
        found = all_spans(texts, field)
        return [pa.array([redacted(t.decode("utf-8", "replace"), joined(b + m)) for t, (b, m) in zip(texts, found)], pa.string())]

    return with_columns(docs, text_col, f"{text_col} string", compute).select(*docs.columns)

"""Small tables with the rows that operators have to cope with."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int, seed: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    syllables = ["an", "the", "ion", "er", "ou", "ti", "re", "st", "ble", "ing", "wh", "ea"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def hard_rows() -> list[tuple]:
    """Null, empty and blank texts, copies, near copies, one very long text, repeated rows, other scripts, a null id."""
    a, b = prose(120, 1), prose(90, 2)
    near = " ".join(w if i != 60 else "changed" for i, w in enumerate(a.split()))
    texts = [
        None, "", " \t\n", a, a, near, b, "one two", "word " * 300, prose(6000, 3), "Ünïcode 北京 😀 text x y\x1cz", "!!! 123 ...",
        b + "\n" + prose(50, 4) + " " + a, "mail a.b@c.example.org or +1 (555) 555-0199, ip 10.1.2.3, card 4111 1111 1111 1111.", "AAA\r\nbbb\x0bccc\x0cddd",
    ]
    rows = [(i * 3, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    rows[4] = (rows[4][0], a, None, None, None)
    return [*rows, rows[6], (None, a, "en", "s", 1)]


def hard(spark):
    """The rows with columns that clash with names that operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(hard_rows(), DOCS)
    extra = ["id", "fp", "a", "b", "ids", "score", "lang_pred", "bucket", "key", "anchor", "spans", "node", "h", "item", "edits_", "part", "start", "_null", "_lang", "_n", "held", "window", "row", "missed", "none", "free", "turn", "blocks"]
    return df.withColumns({c: F.lit(f"x{c}") for c in extra})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def numbered() -> dict[int, str]:
    return {r[0]: r[1] for r in hard_rows() if r[0] is not None}

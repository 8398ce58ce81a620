import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import same_rows
from waymark.llm import collocations, queries

from .helpers import DOCS, empty, hard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000, share=100):
    """rows: (lang, text). {(lang, rank): (phrase, a, l, r, n, score)}."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    candidates = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    longest = {}
    for (lang, w), c in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = (lang, w[i : i + m])
                longest[key] = max(longest.get(key, 0), c)
    found = {}
    for (lang, w), a in candidates.items():
        if 100 * longest.get((lang, w), 0) >= share * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1): (p.decode(), -a, l, r, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])}


def invented(n, seed):
    rng = random.Random(seed)
    words = ["The", "the", "of", "New", "york", "é", "ÉÀ", "a" * 9, "a" * 8, "a" * 17, "x-y", "北京", "İ", "1", "\x00z", "\xa0"]
    def text():
        out = []
        for _ in range(rng.randint(0, 60)):
            out.append("new york city of the" if rng.random() < 0.1 else rng.choice(words))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!?", ",", "\x0b"]))
        return "".join(out)
    return [(i, text() if rng.random() < 0.95 else None, rng.choice(["en", "en", "fr", None, "und"]), "s", 1) for i in range(n)]


def mined(df, least, **more):
    got = collocations.collocations(collocations.mine(df, least), **more).collect()
    return {(r.lang, r.rank): tuple(r[2:]) for r in got}


@pytest.mark.parametrize("least,top,share", [(4, 2000, 100), (10, 7, 50), (10**6, 5, 100)])
def test_against_brute_force(spark, least, top, share):
    rows = invented(300, least)
    df = spark.createDataFrame(rows, DOCS).repartition(7).withColumns({c: F.lit("x") for c in ("a", "b", "slot", "phrase", "n", "c", "k", "part")})
    want = brute([(r[2], r[1]) for r in rows], least, top, share)
    assert mined(df, least, top=top, share=share) == want and (len(want) > 10 or least == 10**6)


def test_many_tables(spark, monkeypatch):
    """With tables of a few keys each, all rounds together give the same."""
    for name, value in (("SHARD", 16), ("ROUND_SHARDS", 3), ("BLOCK", 8), ("FAN", 2), ("BUFFER", 500)):
        monkeypatch.setattr(collocations, name, value)
    rows = invented(120, 11)
    assert mined(spark.createDataFrame(rows, DOCS).repartition(5), 6) == brute([(r[2], r[1]) for r in rows], 6)


def test_equal_hashes_of_different_phrases(spark, monkeypatch):
    """With 12-bit hashes in one lane, phrases share keys and are told apart by the other lane."""
    whole = collocations.Tokens.keys
    monkeypatch.setattr(collocations, "SHARD", 64)
    rows = invented(120, 12)
    df = spark.createDataFrame(rows, DOCS).repartition(5)

    def weak(self, k, lane):
        return whole(self, k, lane) & np.uint64(0xFFF) if lane == 1 else whole(self, k, lane)

    monkeypatch.setattr(collocations.Tokens, "keys", weak)
    source = collocations.scan

    def scan(docs, schema, made):  # the workers have their own copy of the module
        def patched():
            collocations_there = __import__("waymark.llm.collocations", fromlist=["Tokens"])
            there = collocations_there.Tokens
            if not hasattr(there, "strong"):
                there.strong = there.keys
            there.keys = lambda self, k, lane: there.strong(self, k, lane) & np.uint64(0xFFF) if lane == 1 else there.strong(self, k, lane)
            each, rest = made()

            def restored():
                yield from rest()
                there.keys = there.strong

            return each, restored

        return source(docs, schema, patched)

    monkeypatch.setattr(collocations, "scan", scan)
    found = collocations.mine(df, 6).phrases.where("n_words > 1").select("lang", "phrase", "f").collect()
    counted = Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            counted.update(("und" if lang is None else lang, " ".join(w[i : i + k])) for k in range(2, 6) for i in range(len(w) - k + 1))
    assert {(r.lang, r.phrase): r.f for r in found} == {x: c for x, c in counted.items() if c >= 6}


def test_hard_rows(spark):
    assert mined(empty(spark), 2) == {}
    df = hard(spark)
    assert mined(df, 2) == brute([(r.lang, r.text) for r in df.collect()], 2)


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 5000):
        a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        a[: n // 3] = a[n // 2 : n // 2 + n // 3]  # keys may agree in one half
        shards = 4
        own = collocations.shard_of(a, shards)
        built = []
        for i in range(shards):
            sizes, words, order = collocations.build(a[own == i], b[own == i])
            built.append((sizes, words.tobytes(), a[own == i][order].tobytes(), b[own == i][order].tobytes(), b""))
        table = collocations.Table(0, shards, built)
        assert sorted(table.find(a, b)) == list(range(n)) and len(table) == n
        if n:
            assert (table.find(a, b + np.uint64(1)) == -1).all() and (table.find(a + np.uint64(1), b) == -1).all()
            part = collocations.Table(1, shards, built[1:3])
            assert ((part.find(a, b) >= 0) == ((own == 1) | (own == 2))).all() and sorted(x for x in part.find(a, b) if x >= 0) == list(range(len(part)))


def test_query_matches_sql(spark):
    same_rows(queries.op13_perfect_hash(spark, "/root/testdata/sf0.01"), "/root/testdata/sf0.01", queries.ORACLE_SQL["op13_perfect_hash"])


def test_sql_on_invented_rows(spark, tmp_path):
    spark.createDataFrame(invented(900, 5), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    same_rows(queries.op13_perfect_hash(spark, str(tmp_path)), str(tmp_path), queries.ORACLE_SQL["op13_perfect_hash"])

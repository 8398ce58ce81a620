import hashlib
import random
import re

from waymark.llm import queries, substrings

from .helpers import DOCS, empty, hard, hard_rows, prose

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length=20):
    seen, out = set(), {}
    for key, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        out[key] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def check_factors(rows, found, length=20):
    """Each factor is verbatim at an earlier place, cannot go on along its source as the next one, and factors give the spans."""
    text = {k: WORD.findall(t or "") for k, t in rows}
    assert any(r.factors for r in found)
    for r in found:
        words, gone = text[r.id], set()
        for f, after in zip(r.factors, [*r.factors[1:], None]):
            assert f.words >= length and (f.source, f.start) < (r.id, f.at)
            assert words[f.at : f.at + f.words] == text[f.source][f.start : f.start + f.words]
            assert after is None or f.at < after.at and not (after.source == f.source and after.at - after.start == f.at - f.start and after.at <= f.at + f.words - length + 1)
            gone |= set(range(f.at, f.at + f.words))
        assert gone == {i for s in r.spans for i in range(s.start, s.start + s.words)} and len(gone) == r.n_removed


def result(df, **kw):
    return {r.id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substrings.deduplicated(df, **kw).collect()}


def test_hard_rows(spark):
    rows = {r[0]: r[1] for r in hard_rows() if r[0] is not None}
    got = result(hard(spark))
    want = brute(rows.items())
    assert {k: got[k] for k in want} == want
    assert len(substrings.deduplicated(hard(spark)).collect()) == len(hard_rows())


def test_overlapping_passages(spark):
    rng = random.Random(5)
    base = prose(400, 9).split()
    texts = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(380)
            parts += base[a : a + rng.randint(5, 60)] + prose(rng.randint(0, 8), rng.random()).split()
        texts.append((i, " ".join(parts)))
    df = spark.createDataFrame([(k, t, None, None, 0) for k, t in texts], DOCS).repartition(5)
    assert result(df) == brute(texts)
    check_factors(texts, substrings.deduplicated(df).collect())


def test_a_long_copy_is_one_factor(spark):
    text = prose(3000, 21, 5000)
    rows = [(1, text), (2, "x y z " + text + " end"), (3, prose(50, 22) + " " + " ".join(text.split()[700:1900]))]
    got = {r.id: [tuple(f) for f in r.factors] for r in substrings.deduplicated(spark.createDataFrame([(k, t, None, None, 0) for k, t in rows], DOCS)).collect()}
    assert got == {1: [], 2: [(3, 1, 0, 3000)], 3: [(50, 1, 700, 1200)]}


def test_text_ids_and_the_query(spark, tmp_path):
    rows = [(f"k{i:02}", prose(200, i // 2)) for i in range(8)]
    got = {r.id: r.n_removed for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {k: n for k, (_, n, _) in brute(rows).items()}
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op1_relative_lempel_ziv(spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found == {k: (n, m, hashlib.sha256(kept.encode()).hexdigest()) for k, (n, m, kept) in brute(docs).items()}


def test_small_vocabulary_and_other_length(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    df = spark.createDataFrame([(k, t, None, None, 0) for k, t in texts], DOCS).repartition(3)
    assert result(df) == brute(texts)
    assert result(df, length=5) == brute(texts, 5)
    check_factors(texts, substrings.deduplicated(df, length=5).collect(), 5)


def test_empty(spark):
    assert substrings.deduplicated(empty(spark)).count() == 0

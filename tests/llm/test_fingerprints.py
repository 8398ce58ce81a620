import hashlib
import itertools

import numpy as np
from xxhash import xxh64_intdigest

from waymark.llm import editprints, queries, simhash

from .helpers import DOCS, empty, hard, hard_rows, prose


def brute_fingerprint(text):
    words = bytes(text or "", "utf-8").lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    parent = {k: k for k in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in fps}


def test_simhash_of_hard_rows(spark):
    fps = {r[0]: brute_fingerprint(r[1]) for r in hard_rows() if r[0] is not None}
    want = brute_components(fps)
    got = simhash.near_duplicates(hard(spark)).collect()
    assert len(got) == len(hard_rows())
    assert {r.id: r.component for r in got if r.id is not None} == want
    assert all(r.fp & (2**64 - 1) == fps[r.id] for r in got if r.id is not None)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_links_of_close_fingerprints(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = set(base)
    for x in base:
        for n in (1, 2, 3, 4, 5):
            y = x
            for b in rng.choice(64, n, replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(r.a, r.b) for r in simhash.links(table).collect()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and want
    assert {(r.a, r.b) for r in simhash.links(table, large=3).collect()} == want  # with crowded buckets


def test_crowded_buckets(spark):
    rng = np.random.default_rng(7)
    base = int(rng.integers(0, 2**62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(250)}
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert {(r.a, r.b) for r in simhash.links(table, large=20).collect()} == want
    assert {(r.a, r.b) for r in simhash.links(table, large=2).collect()} == want  # crowded at every level


def test_rows_with_equal_ids_are_judged_by_their_texts(spark):
    a, b = prose(300, 31), prose(300, 32)
    words = a.split()
    near = next(t for t in (" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in range(len(words))) if (brute_fingerprint(t) ^ brute_fingerprint(a)).bit_count() <= 3)
    rows = [(1, a), (2, near), (2, b), (3, b), (None, prose(300, 33)), (None, a), (4, None), (5, "")]
    kept = simhash.one_of_each(spark.createDataFrame([(k, t, None, None, 0) for k, t in rows], DOCS)).collect()
    fps = {t: brute_fingerprint(t) for _, t in rows}
    assert (fps[a] ^ fps[near]).bit_count() <= 3
    assert sorted((str(r.doc_id), r.text) for r in kept if r.doc_id != 4) == sorted([("1", a), ("2", b), ("None", rows[4][1])]) and len(kept) == 4


def test_query_of_components(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    fps = {k: brute_fingerprint(t) for k, t in docs.items()}
    want = brute_components(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash_pivots(spark, "/root/testdata/sf0.001").collect()} == {k: (f"{fps[k]:016x}", want[k]) for k in docs}


def test_one_of_each(spark):
    kept = [r.doc_id for r in simhash.one_of_each(hard(spark)).collect()]
    assert sorted(kept, key=str) == sorted(set(kept), key=str) and None not in kept and 9 in kept and 12 not in kept


def brute_walk(text):
    cp = [ord(c) for c in text]
    places, i, table = [], 0, editprints.moves()
    while i < len(cp):
        places.append(i)
        i += int(table[len(places) % editprints.PERIOD - 1 if len(places) % editprints.PERIOD else editprints.PERIOD - 1, cp[i] & 255])
    if not places:
        return bytes(editprints.SLOTS).hex()
    out = []
    for step in editprints.steps_of(np.array([len(places)]))[:, 0]:
        p, v = places[step], 0
        for k in range(editprints.GRAM):
            v = (v + (cp[p + k] + 1 if p + k < len(cp) else 0)) * 0x9E3779B97F4A7C15 % 2**64
        out.append(v >> 56)
    return bytes(out).hex()


def test_edit_embedding_of_hard_rows(spark):
    rows = [(r[0], r[1] or "") for r in hard_rows()]
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    got = sorted(editprints.with_edits(hard(spark)).collect(), key=lambda r: (-(r.id if r.id is not None else -(2**63)), r.edited))
    assert len(got) == len(rows)
    by_id = {r.id: r for r in got}
    for i, (key, text) in enumerate(order):
        if [k for k, _ in order].count(key) > 1:
            continue
        after, half = order[(i + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = by_id[key]
        assert (r.n_chars, r.edited) == (len(text), edited)
        assert r.fingerprint == brute_walk(text) and r.edited_fingerprint == brute_walk(edited)
    assert editprints.with_edits(empty(spark)).count() == 0


def test_likeness_follows_edits(spark):
    text = prose(800, 8)
    small = text[:1000] + "xyz" + text[1000:]
    prints = [np.frombuffer(bytes.fromhex(brute_walk(t)), np.uint8) for t in (text, small, text[: len(text) // 2] + prose(800, 12)[: len(text) // 2], prose(800, 13))]
    near = [editprints.likeness(prints[0], p) for p in prints[1:]]
    assert near[0] > near[1] > near[2] and near[0] > 0.4 and near[2] < 0.1


def test_near_pairs(spark):
    texts = [prose(300, i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (101, texts[1][: len(texts[1]) * 92 // 100])]
    prints = spark.createDataFrame([(k, brute_walk(t)) for k, t in rows], "id long, fingerprint string")
    got = {(r.a, r.b) for r in editprints.near_pairs(prints).collect()}
    assert got == {(r.a, r.b) for r in editprints.near_pairs(prints, rows=1).collect()}  # every bucket cut
    classes = {r.id: (r["class"], r.n_links) for r in editprints.near_classes(prints).collect()}
    assert classes == {k: (1, 1) if k in (1, 101) else (0, 0) if k == 100 else (k, 0) for k, _ in rows}
    value = {k: np.frombuffer(bytes.fromhex(brute_walk(t)), np.uint8) for k, t in rows if k != 100}
    want = {(a, b) for a, b in itertools.combinations(sorted(value), 2) if editprints.likeness(value[a], value[b]) >= 0.8}
    assert got == want and (1, 101) in want


def test_edited_digest_is_of_the_whole_text(spark):
    df = spark.createDataFrame([(1, "abcdé", None, None, 0), (2, "xyz", None, None, 0)], DOCS)
    got = {r.id: hashlib.sha256(r.edited.encode()).hexdigest() for r in editprints.with_edits(df).collect()}
    assert got == {1: hashlib.sha256("abcxy".encode()).hexdigest(), 2: hashlib.sha256("xya".encode()).hexdigest()}


def test_edits_of_other_ids_ties_and_a_very_long_text(spark):
    long = prose(30_000, 77) * 8  # beyond a piece and a group
    rows = [("b", "second"), ("a", None), (None, "x y"), (None, "x y"), ("b", "zweite"), ("c", long)] + [(None, "same text")] * 40
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = editprints.with_edits(df).collect()
    assert sorted((str(r.id), r.n_chars) for r in got) == sorted((str(k), len(t or "")) for k, t in rows)
    c = next(r for r in got if r.id == "c")
    assert c.fingerprint == brute_walk(long) and c.edited[: len(long) - len(long) // 2] == long[: len(long) - len(long) // 2]
    follows = {r.edited[-len(t or "") // 2 :] for r, t in ((r, "same text") for r in got if r.id is None and r.n_chars == 9)}
    assert len([r for r in got if r.edited == "same same"]) >= 38 and follows
    assert editprints.with_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first().edited == "abab"


def test_query_of_fingerprints(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    found = {r.doc_id: r for r in queries.op3_edit_embedding(spark, "/root/testdata/sf0.001").collect()}
    for key, after in zip(order, [*order[1:], order[0]]):
        text, half = docs[key], len(docs[key]) // 2
        edited = text[: len(text) - half] + docs[after][:half]
        r = found[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if key % 9 == 0:
            a, b, c = (np.frombuffer(bytes.fromhex(brute_walk(t)), np.uint8) for t in (text, edited, docs[after]))
            assert r.fingerprint == a.tobytes().hex() and r.near_edited == editprints.likeness(a, b) and r.near_next == editprints.likeness(a, c)
    assert len(found) == len(docs)


def test_plain_fingerprints(spark):
    rows = editprints.fingerprinted(hard(spark)).collect()
    assert sorted((r.id is None, r.id or 0, r.n_chars, r.fingerprint) for r in rows) == sorted((k is None, k or 0, len(t or ""), brute_walk(t or "")) for k, t, *_ in hard_rows())
    assert editprints.fingerprinted(empty(spark)).count() == 0


def test_query_of_near_fingerprints(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    value = {k: np.frombuffer(bytes.fromhex(brute_walk(t)), np.uint8) for k, t in docs.items()}
    parent = {k: k for k in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        if editprints.likeness(value[a], value[b]) >= 0.8:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    rows = queries.edit_fingerprint_classes(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.class_id for r in rows} == {k: root(k) for k in docs}
    first = {}  # the least id of each fingerprint stands for all that have it
    for k in sorted(docs):
        first.setdefault(value[k].tobytes(), k)
    links = dict.fromkeys(first.values(), 0)
    for a, b in itertools.combinations(sorted(links), 2):
        if editprints.likeness(value[a], value[b]) >= 0.8:
            links[a], links[b] = links[a] + 1, links[b] + 1
    assert {r.doc_id: r.n_links for r in rows} == {k: links[first[value[k].tobytes()]] for k in docs}


def test_bands_without_fingerprints(spark, monkeypatch):
    """Each fingerprint went along with all of its bands; now bands are hashes, and rows of no other fingerprint's band get none."""
    written = {}
    monkeypatch.setattr(editprints, "materialise", lambda df, tag, real=editprints.materialise: written.setdefault(tag, real(df, tag)))
    rng = np.random.default_rng(5)
    value = [rng.integers(0, 256, 128, np.uint8) for _ in range(40)]
    for i in range(120):  # near copies around the limit
        copy = value[i % 4].copy()
        at = rng.choice(128, rng.integers(1, 30), replace=False)
        copy[at] += 1
        value.append(copy)
    prints = spark.createDataFrame([(f"d{i:03}", v.tobytes().hex()) for i, v in enumerate(value)] + [("e", None), (None, value[0].tobytes().hex()), ("z", value[0].tobytes().hex())], "key string, fingerprint string")
    want = {(f"d{a:03}", f"d{b:03}", editprints.likeness(value[a], value[b])) for a, b in itertools.combinations(range(len(value)), 2) if editprints.likeness(value[a], value[b]) >= 0.8}
    for rows in (512, 7):
        written.clear()
        got = [tuple(r) for r in editprints.near_pairs(prints, id_col="key", rows=rows).collect()]
        assert len(got) == len(set(got)) and {g[:2] for g in got} == {w[:2] for w in want} and all(abs(g[2] - w[2]) < 1e-12 for g, w in zip(sorted(got), sorted(want)))
        assert sorted(written["bands"].columns) == ["band", "id", "k"]
    assert len(want) > 100

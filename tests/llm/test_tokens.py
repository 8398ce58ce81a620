import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm import editcounts, packing, queries
from waymark.llm.tokens import encoder

from .helpers import empty, hard, hard_rows, prose

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["it's IT'S o'clock", "<|endoftext|> <|startoftext|>", "x<|endoftext|>y", "e\u0301\u00e9 \u212b", "\u0130stanbul \u03a3\u03c3\u03c2", "a\u00a0b\u2003c\u3000d", "x\x1cy\x85z", "1234 5,678.90 \u00b2\u00bd", "\u4e2d\u6587\u5b57 \U0001f600\U0001f44d", "a_b-c/d\\e", "\u00b5\u00aa\u00ba", "\u00df\u1e9e", "don't<b>", "`~^", ""]


def test_word_cache_gives_the_tokenizers_ids():
    tool = Tokenizer.from_file(WORD_BPE)
    for text in [*ODD, *(r[1] or "" for r in hard_rows())]:
        got = np.frombuffer(encoder(WORD_BPE).encode(text.encode()), encoder(WORD_BPE).dtype).tolist()
        assert got == tool.encode(text, add_special_tokens=False).ids, text[:40]


def test_packing(spark):
    tool, length = Tokenizer.from_file(WORD_BPE), 64
    pieces = packing.pack(hard(spark).repartition(5), WORD_BPE, length=length).collect()
    want = sorted((str(r[0]), tool.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in hard_rows())
    rows, ends = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32 and 0 < p.length <= length - p.offset
        rows.setdefault(p.sequence_id * length + p.offset - p.start, []).append((p.start, str(p.id), p.doc_tokens, ids))
        ends.setdefault(p.sequence_id, []).append((p.offset, p.length))
    got = []
    for own in rows.values():
        own.sort()
        ids = [i for _, _, _, part in own for i in part]
        assert [s for s, *_ in own] == np.cumsum([0, *[len(part) for *_, part in own]])[:-1].tolist() and own[0][2] == len(ids)
        got.append((own[0][1], ids))
    assert sorted(got) == want
    for seq, own in ends.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == length or seq == max(ends)
    assert packing.pack(empty(spark), WORD_BPE).count() == 0


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_trees_follow_random_edits():
    tool, enc, rng = editcounts.counter(RANKS, public_tokenizers.PATTERN), encoding(), random.Random(4)
    parts = ["the ", "  ", "\n", "it's", "'", "s", " 12", "3", "\u00e9", "word", " \t x", "!?", "'ll", "   ", "\u4e2d", "\u00a0", "."]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.choice((0, 1, 5, 40, 900))))
        tree = editcounts.Tree(tool.split(text), tool)
        for _ in range(12):
            a = rng.randint(-2, len(text) + 2)
            b = a + rng.choice((0, 0, 1, 3, 50, 10000))
            new = "".join(rng.choice(parts) for _ in range(rng.choice((0, 0, 1, 2, 6, 200))))
            tree.edit(a, b, new)
            x = min(max(a, 0), len(text))
            text = text[:x] + new + text[min(max(b, x), len(text)) :]
            assert tree.text() == text and [t for b in range(len(tree.blocks)) for t in tree.block(b)[0]] == tool.split(text)
            if rng.random() < 0.3:
                tree = editcounts.Tree.kept(tree.keep(), tool)
            assert tree.tokens == len(enc.encode_ordinary(text)) and tree.characters == len(text)


def test_planted_blocks_are_those_of_a_tree():
    tool = editcounts.counter(RANKS, public_tokenizers.PATTERN)
    for text in [*ODD, "some words, 12 " * 300, *(r[1] or "" for r in hard_rows())]:
        tokens = tool.split(text)
        assert editcounts._planted(text, tool) == (len(tokens), editcounts.Tree(tokens, tool).keep())


def test_small_edit_of_a_long_text_encodes_little():
    tool = editcounts.counter(RANKS, public_tokenizers.PATTERN)
    tree = editcounts.Tree(tool.split("some words " * 5000), tool)
    tree.edit(20000, 20003, "other")
    assert tree.encoded < 20


def test_counts_of_hard_rows(spark):
    enc = encoding()
    got = editcounts.count(hard(spark), RANKS, public_tokenizers.PATTERN, queries.sample_edits()).collect()
    assert len(got) == len(hard_rows())
    by_id = {r.id: r for r in got}
    for key, text, *_ in hard_rows():
        t = text or ""
        assert by_id[key].n_tokens == len(enc.encode_ordinary(t)) and by_id[key].n_tokens_edited == len(enc.encode_ordinary(by_id[key].edited))
    assert editcounts.count(empty(spark), RANKS, public_tokenizers.PATTERN, queries.sample_edits()).count() == 0


def test_edits_from_a_table(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "x")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 0, "A"), (1, 1, 0, 5, "bye"), (1, 3, None, None, None), (9, 1, 0, 0, "z")], "doc_id long, seq int, start long, stop long, text string")
    joined = editcounts.attach(docs, edits)
    got = {r.id: r.edited for r in editcounts.count(joined, RANKS, public_tokenizers.PATTERN, F.col("edits")).collect()}
    assert got == {1: "Abye world", 2: "x"}


def test_kept_trees_take_a_second_round_without_a_full_encode(spark, tmp_path, monkeypatch):
    enc, long = encoding(), "some words, it's 42 " * 4000
    texts = {1: long, 2: "short text", 3: None, 4: prose(500, 5)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    trees = editcounts.plant(docs, RANKS, public_tokenizers.PATTERN)
    rounds = [[(1, 1, 40000, 40003, "other"), (2, 1, 0, 5, ""), (3, 1, 0, 0, "new")], [(1, 1, 10, 14, "x y"), (1, 2, 79990, 79995, ""), (4, 1, 7, 7, " in between ")]]
    for i, edits in enumerate(rounds):
        trees.write.parquet(str(tmp_path / str(i)))
        kept = spark.read.parquet(str(tmp_path / str(i)))
        table = spark.createDataFrame(edits, "doc_id long, seq int, start long, stop long, text string")
        trees = editcounts.edited(editcounts.attach(kept, table, "id", "doc_id"), RANKS, public_tokenizers.PATTERN)
        for key, _, start, stop, new in edits:
            t = texts[key] or ""
            texts[key] = t[:start] + new + t[stop:]
        for r in editcounts.totals(trees).collect():
            assert r.text == (texts[r.id] or "") and r.n_tokens == len(enc.encode_ordinary(r.text))
            assert r.encoded < 40 and (r.encoded == 0 or r.id in {e[0] for e in edits})
    untouched = {r.id: r.blocks for r in kept.collect()}[2]
    assert {r.id: r.blocks for r in trees.collect()}[2] == untouched


def test_query_of_counts(spark):
    enc, docs = encoding(), {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op10_edit_aware_counts(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(enc.encode_ordinary(t)) for k, t in docs.items()}
    for r in rows:
        text = docs[r.doc_id]
        n = len(text)
        for start, stop, new in ((n // 3, n // 3 + 7, "Edited in 2024"), (n // 2, n // 2, text[:40]), (n // 5, n // 5 + 12, "")):
            at = min(start, len(text))
            text = text[:at] + new + text[min(max(stop, at), len(text)) :]
        assert r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_tokens_edited == len(enc.encode_ordinary(text))


def test_query_of_pieces(spark):
    tool, docs = Tokenizer.from_file(WORD_BPE), {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = {k: np.array([*tool.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in docs.items()}
    rows = queries.op8_concatenate_and_cut(spark, "/root/testdata/sf0.001").collect()
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id]) for r in rows)
    assert sum(r.length for r in rows) == sum(map(len, ids.values())) and all(r.offset + r.length <= 4096 for r in rows)

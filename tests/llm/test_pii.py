import re

from waymark.llm import pii, queries

from .helpers import empty, hard, hard_rows


def brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


TEXTS = [
    "a@b.c_d@e.f x@y@z.w", "@x.y", "..@a.b.", "a@b", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3", "4111111111111111", "4111-1111-1111-1111 4111 1111 1111 1112", "1 2 3 4 5 6", "+1+12345678+1 (2) 3-4.5 67890", "+123456789012345678", "é+1 555 555 0199é", "9" * 5000, "a" * 5000 + "@b.c",
    "0.0.0." + "0" * 50, "", "4111 1111 1111 1111 4111 1111 1111 1111",
]


def test_patterns():
    for text in TEXTS:
        assert pii.base_spans(text) == brute(text), text[:40]


def test_operator(spark):
    rows = {r.id: r for r in pii.spans(hard(spark)).collect()}
    for key, text, *_ in hard_rows():
        assert rows[key].base == pii.joined(brute(text or ""))
    assert pii.spans(hard(spark)).count() == len(hard_rows())
    assert pii.spans(empty(spark)).count() == 0


def test_field_finds_what_patterns_miss():
    texts = ["the king said password=5198e9657651aa63e5 and left them", "plain words without any sign of a person at all", "on page 12 of 2024 there were 3.5 things, chapter 7."]
    found = [[k for k, *_ in more] for _, more in pii.all_spans([t.encode() for t in texts], pii.default_field())]
    assert found == [["secret"], [], []]


def test_held_out_labels():
    field, hit, total, wrong = pii.default_field(), 0, 0, 0
    for _, text, spans in pii.labelled_rows(150, seed=77):
        got = {(k, a, b) for base_more in pii.all_spans([text.encode()], field) for part in base_more for k, a, b in part}
        want = [tuple(s.split(":")) for s in spans.split(",") if s]
        total += len(want)
        hit += sum(any(a < int(y) and b > int(x) for _, a, b in got) for _, x, y in want)
        wrong += sum(not any(a < int(y) and b > int(x) for _, x, y in want) for _, a, b in got)
    assert hit / total > 0.85 and wrong < 0.1 * total


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    field = pii.Field(rng.normal(size=pii.Field.size))
    field.move, field.open = field.move[:3, :3], field.open[:3]
    scores = rng.normal(size=(5, 3))
    old, pii.LABELS = pii.LABELS, 3
    try:
        got = field.viterbi(scores, np.array([0]), np.array([5]))
    finally:
        pii.LABELS = old
    cost = lambda p: field.open[p[0]] + sum(scores[i, y] for i, y in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))
    assert tuple(got) == max(itertools.product(range(3), repeat=5), key=cost)


def test_redact(spark):
    df = hard(spark)
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert pii.redact(df).columns == df.columns
    assert got[0] is None and "[EMAIL]" in got[39] and "a.b@c" not in got[39] and got[9] == hard_rows()[3][1]
    assert {r.doc_id: r["_null"] for r in pii.redact(df).collect()} == {r.doc_id: "x_null" for r in df.collect()}


def test_long_numeric_texts_keep_within_memory():
    import resource

    text = (" ".join("1234567890"[i % 10] for i in range(1_500_000)) + " " + "x 5 y " * 2000).encode()  # 3 MB
    field, before = pii.default_field(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    pii.all_spans([text], field)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000  # kB


def test_query_of_spans(spark):
    import hashlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op2_shape_field(spark, "/root/testdata/sf0.001").collect():
        base = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for kind, *_ in base) for k in pii.BASE]
        assert set(filter(None, pii.joined(base).split(","))) <= set(r.spans.split(","))

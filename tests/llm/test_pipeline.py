import re

import corpus_pipeline
from waymark.llm import packing, pii
from waymark.llm.queries import tokenizer_path

from .helpers import DOCS, empty, hard_rows, prose
from .test_fingerprints import brute_components, brute_fingerprint
from .test_rules_and_leaks import grams


def test_against_brute_force(spark, tmp_path):
    item = prose(30, 500)
    rows = [r for r in hard_rows() if r[0] is not None][:-1] + [(500 + i, prose(150, 70 + i), "en", "s", 1) for i in range(12)] + [(600, prose(50, 90) + " " + item + " " + prose(50, 91), "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {r[0]: r[1] for r in rows if any(c.isalpha() for c in r[1] or "")}
    leaders = brute_components({k: brute_fingerprint(t) for k, t in kept.items()})
    kept = {k: t for k, t in kept.items() if leaders[k] == k}
    kept = {k: t for k, t in kept.items() if not 5 * len(grams(t) & grams(item)) >= 4 * len(grams(item))}
    assert 600 not in kept and 12 not in kept and {500, 511} <= set(kept)
    field = pii.default_field()
    clean = {k: pii.redacted(t, pii.joined(sum(pii.all_spans([t.encode()], field)[0], []))) for k, t in kept.items()}
    assert any("[EMAIL]" in t and not re.search("a.b@c", t) for t in clean.values())
    df = spark.createDataFrame([(k, t, None, None, 0) for k, t in clean.items()], DOCS)
    want = {(r.id, r.doc_tokens) for r in packing.pack(df, tokenizer_path()).collect()}
    assert {(r.doc_id, r.doc_tokens) for r in got} == want
    assert sum(r.length for r in got) == sum(n for _, n in want)


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([r for r in hard_rows()], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0

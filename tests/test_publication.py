"""Publication in order, cost of scans, remembered pages, budgets of attempts."""

import json

import pytest
from pyspark.sql import functions as F

from waymark.operators import snapshot
from waymark.sources import scancost, sinks, versions


def pair(spark, n):
    return spark.range(n).select(F.col("id"), F.lit(n).alias("v")), spark.createDataFrame([(n,)], "n int")


def diff(before, after):
    return snapshot.difference(before, after, "id", ["v"])


def test_a_failure_between_the_tables_leaves_the_old_pair(spark, tmp_path):
    root = str(tmp_path / "out")
    assert versions.current(spark, root) is None and versions.read(spark, root, "dataset") is None
    data, base = pair(spark, 3)
    versions.publish(data, diff(data.limit(0), data), root, base)
    more, _ = pair(spark, 5)
    broken = spark.range(1).select(F.raise_error(F.lit("disk full")).cast("int").alias("n"))
    with pytest.raises(Exception, match="disk full"):
        versions.publish(more, diff(data, more), root, broken)
    assert versions.read(spark, root, "dataset").count() == 3 and versions.read(spark, root, "baseline").first().n == 3
    assert versions.current(spark, root).number == 1
    versions.publish(more, diff(data, more), root, pair(spark, 5)[1])
    assert versions.read(spark, root, "dataset").count() == 5 and versions.read(spark, root, "baseline").first().n == 5
    assert versions.prune(spark, root, 1) and versions.read(spark, root, "dataset").count() == 5
    assert len(list((tmp_path / "out" / "tables").iterdir())) == 2 and versions.prune(spark, root, 1) == []


def test_a_version_can_be_made_from_the_one_before(spark, tmp_path):
    root = str(tmp_path / "out")
    versions.commit(spark, root, [("dataset", spark.range(3))])
    for _ in range(2):
        old = versions.read(spark, root, "dataset")
        versions.commit(spark, root, [("dataset", old.unionByName(old.select((F.col("id") + 100).alias("id"))))])
    assert versions.read(spark, root, "dataset").count() == 12 and versions.current(spark, root).number == 3


def test_nothing_new_keeps_the_dataset(spark, tmp_path):
    root = str(tmp_path / "out")
    data, base = pair(spark, 3)
    versions.publish(data, diff(data.limit(0), data), root, base)
    first = versions.current(spark, root)
    assert not versions.publish(data, diff(data, data), root, base).meaningful and versions.current(spark, root) == first
    versions.publish(data, diff(data, data), root, pair(spark, 9)[1], baseline_changed=True)
    now = versions.current(spark, root)
    assert now.tables["dataset"] == first.tables["dataset"] and now.number == 2 and versions.read(spark, root, "baseline").first().n == 9


def test_two_writers_and_unsafe_data(spark, tmp_path):
    root = str(tmp_path / "out")
    data, _ = pair(spark, 100)
    versions.commit(spark, root, [("dataset", data)])
    with pytest.raises(sinks.UnsafePublication):
        versions.publish(data.limit(10), diff(data, data.where("id < 10")), root)
    (tmp_path / "out" / "manifests" / "000000000002.json").write_text(json.dumps({"tables": {"other": "x"}, "notes": {}}))
    real = versions.current
    try:
        versions.current = lambda *_: versions.Version(1, {})
        with pytest.raises(versions.Conflict):
            versions.commit(spark, root, [("dataset", data)])
    finally:
        versions.current = real
    assert versions.current(spark, root).tables == {"other": "x"} and not [p for p in (tmp_path / "out" / "manifests").iterdir() if p.name.endswith(".tmp")]


def test_the_cost_of_scans(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20_000).selectExpr("id", "id % 4 AS part", "concat('text ', id) AS text", "id AS other").write.partitionBy("part").parquet(path)
    rows = spark.read.parquet(path)
    whole = scancost.estimated_bytes(rows)
    assert scancost.within(rows.select("id").where("id > 3"), whole // 2).count() == 19_996
    with pytest.raises(scancost.TooExpensive):
        scancost.within(rows, whole // 2)
    part = scancost.scans(rows.where("part = 1"))
    assert len(part) == 1 and part[0].bytes < whole / 3 and part[0].files < scancost.scans(rows)[0].files
    assert scancost.estimated_bytes(rows.join(rows.select("id"), "id")) > whole and scancost.estimated_bytes(spark.range(9)) == 0
    rows.createOrReplaceTempView("costly")
    assert len(scancost.scans(spark.sql("SELECT id FROM costly WHERE id > (SELECT avg(other) FROM costly)"))) == 2


def test_attempts_are_charged_in_order(spark):
    import random

    from waymark.operators import candidates

    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 8 + ["cold", None, "none"]), rng.choice([0, 1, 2, 3, None]), rng.random()) for i in range(3000)]
    budgets = {"hot": 500, "cold": 10_000}
    df = spark.createDataFrame(rows, "id long, p string, n int, at double")
    got = {r.id: (r.before, r.paid) for r in candidates.charged(df, "p", "n", ["at", "id"], spark.createDataFrame(list(budgets.items()), "provider string, n int")).collect()}
    spent = {}
    for i, p, n, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        before = spent.get(p, 0)
        assert got[i] == (before, max(0, min(n or 0, budgets.get(p, 0) - before))), i
        spent[p] = before + (n or 0)
    assert len(got) == 3000 and sum(got[r[0]][1] for r in rows if r[1] == "hot") == 500


def test_replayed_batches_are_remembered_once(spark, tmp_path):
    from waymark.streaming import memory

    root = str(tmp_path / "memory")
    batches = [[("a", 1, True), ("b", 2, False), ("a", 3, True)], [("a", 5, False), ("c", 4, True)], [("b", 9, True)], [("d", 1, True)]]
    frames = [spark.createDataFrame(b, "k string, t int, failed boolean") for b in batches]
    shown = lambda: sorted((r.k, r.first_seen, r.last_seen, r.seen, r.failed) for r in memory.remembered(spark, root).collect())
    for i in (0, 1, 1, 2, 0, 3):  # the second is delivered twice, the first once more after a merge
        memory.remember_batch(frames[i], i, root, "k", "t", "failed", merge_every=2)
    assert shown() == [("a", 1, 5, 3, False), ("b", 2, 9, 2, True), ("c", 4, 4, 1, True), ("d", 1, 1, 1, True)]
    memory.merge(spark, root)
    memory.remember_batch(frames[3], 3, root, "k", "t", "failed", merge_every=2)
    assert shown()[3] == ("d", 1, 1, 1, True) and memory.unresolved(spark, root).count() == 3

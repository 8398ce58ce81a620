import random
import re

from pyspark.sql import functions as F

from tests.oracle import same_rows
from waymark.llm import decontaminate, queries, urlrules

from .helpers import DOCS, empty, hard, hard_rows, prose

SF = "/root/testdata/sf0.001"


def test_queries_match_sql(spark):
    for name, sql in queries.ORACLE_SQL.items():
        same_rows(queries.QUERIES[name](spark, SF), SF, sql)


def verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_nested_rules(spark):
    rng = random.Random(8)
    hosts = ["com", "a.com", "b.a.com", "x.b.a.com", "ab.com", "net", "a.net", "c.a.net", "org"]
    paths = ["/", "/a", "/a/", "/a/b", "/ab", "/en/", ""]
    rules = sorted({(h, p): (h, p, "block" if rng.random() < 0.5 else "allow") for h in hosts for p in paths if rng.random() < 0.5}.values())
    urls = [f"{s}://{w}{rng.choice(hosts)}{rng.choice(['', '/', '/a/b/c', '/ab/c', '/en/x?y=/a', '#/a', '?/a', '/a?x', '/é/'])}" for s in ("http", "HTTPS") for w in ("", "WWW.", "q-") for _ in range(60)]
    urls += [None, "", "no scheme", "http://", "http:///a", "x://A.COM/a/://b", "http://a.com" + "/a" * 3000]
    pages = spark.createDataFrame([(i // 2, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"row": F.lit(1), "key": F.lit("k"), "host": F.lit("h"), "rule": F.lit("r")}).repartition(4)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = [tuple(r) for r in urlrules.judge(pages, table, ranges=7).collect()]
    want = [(i // 2, *verdict(u, rules)) for i, u in enumerate(urls)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rules_without_a_path_do_not_reach_other_hosts(spark):
    urls = ["http://x.community/a", "http://x.com/a", "http://com", "http://a.b.net", "http://a.b.network/", "http://.com/a"]
    rules = [("com", "", "block"), ("b.net", "", "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [tuple(r) for r in urlrules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()]
    assert sorted(got) == sorted((i, *verdict(u, rules)) for i, u in enumerate(urls))


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in urlrules.judge(pages, rules).collect()] == ["allow"]
    assert urlrules.judge(pages.limit(0), spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")).count() == 0


def grams(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_containment_of_hard_rows(spark):
    rng = random.Random(2)
    items = [(i, prose(n, 50 + i)) for i, n in enumerate((3, 5, 6, 9, 12, 20, 33, 60, 130, 260))] + [(90, None), (91, "  "), (92, "one two")]
    docs = [r[:2] for r in hard_rows() if r[0] is not None]
    for key, (_, text) in enumerate(items[:10]):
        words = text.split()
        for share in (0.5, 0.75, 0.85, 1.0):
            start = 0
            own = words[start : start + max(1, round(len(words) * share))]
            docs.append((1000 + 10 * key + int(share * 8), prose(rng.randint(0, 200), key) + " " + " ".join(own).upper() + " " + prose(40, key + 99)))
    df = spark.createDataFrame([(k, t, None, None, 0) for k, t in docs] + [(None, items[5][1], None, None, 0)], DOCS).withColumns({"h": F.lit(1), "id": F.lit(2), "item": F.lit(3)}).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"h": F.lit(1), "id": F.lit(2)})
    got = {(r.id, r.item, r.n_item, r.n_shared) for r in decontaminate.contained(df, bench).collect()}
    has, wants, want = [(k, grams(t)) for k, t in docs], {i: grams(t) for i, t in items}, {}
    for k, own in has:
        for i, w in wants.items():
            if w and 5 * len(own & w) >= 4 * len(w):
                want[k, i] = max(want.get((k, i), (0, 0)), (len(w), len(own & w)))
    assert got == {(*k, *v) for k, v in want.items()} and len(got) > 12


def test_decontaminated(spark):
    bench = spark.createDataFrame([(1, "one two"), (2, prose(6000, 3))], "item_id long, text string")
    kept = decontaminate.decontaminated(hard(spark), bench)
    assert kept.columns == hard(spark).columns
    assert kept.count() == len(hard_rows()) - 2
    assert decontaminate.decontaminated(hard(spark), bench.limit(0)).count() == len(hard_rows())
    assert decontaminate.contained(empty(spark), bench).count() == 0
    rows = [(None, prose(6000, 3)), (None, "one more"), (7, "ONE two"), (7, "other"), (8, None)]
    df = spark.createDataFrame([(k, t, None, None, 0) for k, t in rows], DOCS)
    assert sorted(str((r.doc_id, r.text)) for r in decontaminate.decontaminated(df, bench).collect()) == sorted(map(str, [rows[1], rows[3], rows[4]]))

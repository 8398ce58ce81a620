import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from tests.oracle import same_rows
from waymark.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def best_edits(rows):
    """rows: (role, text, fault). The cheapest edits, ASCII-least, by trying all of them from left to right: (cost, audit, lines)."""

    @cache
    def best(i, seen, inserted):  # seen: the last initial, "" at the start; at most 3 insertions in a row
        found = []
        if i == len(rows) and seen in ("", "a"):
            found.append((0, "", ()))
        fits = lambda h: h == "s" and seen == "" or h == "u" and seen in ("", "s", "a") or h == "a" and seen == "u"
        step = lambda cost, edit, line, j, now, again=0: [(cost + c, edit + e, line + x) for c, e, x in [best(j, now, again)] if c < 10**9]
        if inserted < 3:
            for role in ("user", "assistant"):
                if fits(role[0]):
                    found += step(5, "I", (f"{role}:",), i, role[0], inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            found += step(2, "D", (), i + 1, seen)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if fits(role[:1]):
                    found += step(more, "K", (f"{role}:{text}",), i + 1, role[:1])
                for r in ("user", "assistant"):
                    if fits(r[0]):
                        found += step(more + 1, "R", (f"{r}:{text}",), i + 1, r[0])
        return min(found, key=lambda x: x[:2], default=(10**9, "", ()))

    for i in range(len(rows), 0, -20):  # from the end, so that the recursion stays shallow
        for seen in ("", "s", "u", "a"):
            best(i, seen, 0)
    return best(0, "", 0)


def brute(rows):
    """What repair() and digests() have to say of damaged rows: {conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)}."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, judged = set(), []
        for _, _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            judged.append((role, text, "blank" if BLANK.match(text) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
            seen.add((role, text))
        numbers = {r[1] for r in own} - {None}
        count = lambda f: sum(x[2] == f for x in judged)
        odd = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, lines = best_edits(tuple(judged))
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, count("blank"), count("duplicate"), count("truncated"), odd, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def invented(n, seed, longest=9):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown", "assistant"]
    for conv in range(n):
        size = rng.randint(1, longest)
        for i in range(size):
            text = rng.choice(["Yes.", "No!", "Why?", "and so", " \t\n", "", None, "é. \x0b", "Well.\x85", ". x"]) if rng.random() < 0.6 else f"t{rng.random()}."
            rows.append((conv if conv else None, None if rng.random() < 0.1 else i + (rng.random() < 0.1), ["user", "assistant"][i % 2] if rng.random() < 0.5 else rng.choice(roles), text))
    return rows


def repaired(df):
    found = turns.repair(df)
    hashes = {r.conv: r.sha256 for r in turns.digests(found.turns).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv, nothing)) for r in found.conversations.collect()}


def test_walk_against_all_edits():
    rng = random.Random(1)
    for _ in range(4000):
        rows = tuple((rng.choice(["system", "user", "assistant", "tool"]), f"x{i}", rng.choice([None, None, None, "truncated", "blank"])) for i in range(rng.randint(0, 7)))
        codes = [3 * "suat".find(role[0]) + {None: 0, "truncated": 1, "blank": 2}[fault] for role, _, fault in rows]
        cost, audit, _ = best_edits(rows)
        assert turns.walk(codes, turns.LAST, True)[0][0] == audit
        table = turns.matrix(codes)
        assert min(table[q] + turns.LAST[q] for q in turns.STATES) == cost


def test_product_of_segments():
    rng = random.Random(2)
    for _ in range(500):
        codes = [rng.randrange(12) for _ in range(rng.randint(2, 20))]
        cut = rng.randrange(1, len(codes))
        a, b = turns.matrix(codes[:cut]), turns.matrix(codes[cut:])
        both = [min(min(a[4 * p + k] + b[4 * k + q] for k in turns.STATES), turns.NEVER) for p in turns.STATES for q in turns.STATES]
        assert both == turns.matrix(codes)


@pytest.mark.parametrize("bits", [12, 1])
def test_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(turns, "SEGMENT_BITS", bits)
    rows = invented(150, 3) + invented(1, 4, 60)
    rows += rows[:5]
    clashing = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "pos", "digest", "copy", "own", "at", "codes", "first", "fault", "rank")})
    want = brute([(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows])
    assert repaired(clashing) == want


def test_a_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENT_BITS", 4)
    rng = random.Random(5)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"{i}.", f"{i}", ""])) for i in range(900)] + [(7, None, "user", "Same.")] * 300
    want = brute(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert repaired(spark.createDataFrame(rows, SCHEMA)) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    found = turns.repair(spark.createDataFrame([], SCHEMA))
    assert found.conversations.count() == 0 and found.turns.count() == 0 and turns.digests(found.turns).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    rows = invented(300, 6)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    want = brute(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r[0]: tuple(r[1:]) for r in queries.op11_cost_to_go(spark, str(tmp_path)).collect()}
    assert got == {c: want.get(c, nothing) for c in {r[0] for r in rows}}
    assert any(got[c] == nothing for c in got) and len({g[6] for g in got.values()}) > 50
    same_rows(queries.op11_cost_to_go(spark, str(tmp_path)), str(tmp_path), queries.ORACLE_SQL["op11_cost_to_go"])


def test_query_matches_sql(spark):
    same_rows(queries.op11_cost_to_go(spark, "/root/testdata/sf0.01"), "/root/testdata/sf0.01", queries.ORACLE_SQL["op11_cost_to_go"])

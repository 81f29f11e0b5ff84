"""Repair of conversations against exhaustive search, and its rules for odd inputs."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

pytest.importorskip("metricway.llm")

from metricway.llm import queries, repair  # noqa: E402
from metricway.llm.common import table  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, repaired rows) by a search over all edits in the order of (cost, letters). rows: (role, text, fault)."""
    heap, seen = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, i, shape, out = heapq.heappop(heap)
        if (i, shape[-1:]) in seen and not (i == len(rows)):
            continue
        if i == len(rows) and (shape == "" or shape[-1] == "a"):
            return cost, audit, out
        if (i, shape[-1:], "x") in seen:
            continue
        seen.add((i, shape[-1:]))
        if i == len(rows):
            seen.add((i, shape[-1:], "x"))
        def fits(c):
            return {"": "su", "s": "u", "u": "a", "a": "u"}[shape[-1:]].find(c) >= 0 and c != ""
        for c, role in (("u", "user"), ("a", "assistant")):
            if fits(c):
                heapq.heappush(heap, (cost + 2, audit + "I", i, shape + c, [*out, (role, "")]))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, shape, out))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if fits(role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, shape + role[:1], [*out, (role, text)]))
                for c, other in (("u", "user"), ("a", "assistant")):
                    if fits(c):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, shape + c, [*out, (other, text)]))
    raise AssertionError


def expected(rows):
    """rows: (turn, role, text) after damage, in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        if not WORD.search(text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append(None if WORD.findall(text)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit, out = cheapest([(r, x, f) for (_, r, x), f in zip(rows, faults)])
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def fields(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def order(row):
    return (row[0] is not None, row[0] or 0, row[1], row[2])


def test_query_against_search(spark, sf):
    convs = {}
    for r in table(spark, sf, "conversations").collect():
        own = convs.setdefault(r.conv_id, [])
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        own += [(r.turn, "user" if kind == 4 else r.role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = {r.conv_id: fields(r) for r in queries.weighted_repair(spark, sf).collect()}
    assert got == {c: expected(sorted(rows, key=order)) for c, rows in convs.items()}


def conversations(rng, n, longest):
    for c in range(n):
        rows = []
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, None, t + 3])
            rows.append((turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", " ", "", "steward"]),
                         rng.choice(["", " \n", "One.", "Two", "Three! ", "four?\n", "five ", f"own {t}.", f"own {t}"])))
        yield c, sorted(rows, key=order)


def test_invented_conversations(spark):
    convs = dict(conversations(random.Random(5), 150, 9))
    df = spark.createDataFrame([(c, *r, "x") for c, rows in convs.items() for r in rows],
                               "conv_id long, turn long, role string, text string, start string")
    got = {r.conv_id: fields(r) for r in repair.report(repair.numbered(df)).collect()}
    assert got == {c: expected(rows) for c, rows in convs.items()}


def test_blocks_joined_equal_one_block(spark):
    rng = random.Random(8)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.random() < 0.3, rng.random() < 0.4) for _ in range(rng.randint(2, 14))]
        cut = rng.randint(1, len(rows) - 1)
        whole = repair.solved(repair.block_weights(rows), 3 * len(rows))
        parts = repair.joined(repair.block_weights(rows[:cut]), 3 * cut, repair.block_weights(rows[cut:]), 3 * (len(rows) - cut))
        assert repair.solved(parts, 3 * len(rows)) == whole


def test_a_conversation_of_many_blocks(spark):
    """2,500 rows in one conversation are 40 blocks, joined in two rounds."""
    (_, rows), = conversations(random.Random(9), 1, 1) and [(7, [(t, random.Random(t).choice(["user", "assistant", "system"]),
                                                               f"row {t}" + random.Random(-t).choice([".", ""])) for t in range(2500)])]
    df = spark.createDataFrame([(7, *r) for r in rows] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Ho.")],
                               "conv_id long, turn long, role string, text string")
    got = {r.conv_id: fields(r) for r in repair.report(repair.numbered(df)).collect()}
    assert got == {7: expected(rows), 8: expected([(0, "user", "Hi."), (1, "assistant", "Ho.")])}


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(None, None, None, None), (None, None, None, None), (1, None, "user", "x" * 200_000)], schema)
    got = {r.conv_id: fields(r) for r in repair.report(repair.numbered(df)).collect()}
    assert got[None] == expected([(None, " ", " "), (None, " ", " ")]) and got[None][6] == "DD"
    assert got[1] == expected([(None, "user", "x" * 200_000)])
    assert repair.report(repair.numbered(df.limit(0))).count() == 0
    assert queries.damaged(df).columns == ["conv_id", "turn", "role", "text"]

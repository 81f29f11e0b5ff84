"""SimHash against plain Python: edited texts, votes, neighbours, search within a radius."""

import hashlib
import random
import re

import pytest

pytest.importorskip("metricway.llm")

from pyspark.sql import functions as F  # noqa: E402

from metricway.llm import queries, simhash  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_edit(rows):
    ids = sorted({i for i, _ in rows})
    lowest = {i: min(t or "" for j, t in rows if j == i) for i in ids}
    out = {}
    for i, text in rows:
        text = text or ""
        q = len(text) // 4
        after = lowest[ids[(ids.index(i) + 1) % len(ids)]]
        out[(i, text)] = text[: len(text) - q] + after[:q]
    return out


def brute_print(spark, text):
    words = WORDS.findall(text)
    if not words:
        return 0
    pairs = list(zip(words, words[1:] + [None]))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h"))
    known = {(r.a, r.b): r.h & (2**64 - 1) for r in df.distinct().collect()}
    votes = [0] * 64
    for a, b in pairs:
        w = len(a) + len(b or "")
        for j in range(64):
            votes[j] += w if known[(a, b)] >> j & 1 else -w
    return sum(1 << j for j in range(64) if votes[j] > 0)


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    edits = brute_edit(docs)
    got = {r.doc_id: r for r in queries.simhash_tables(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edits[(i, text)].encode()).hexdigest()
    order = sorted(got)
    for i, text in docs[:12]:
        mine, other = brute_print(spark, text), brute_print(spark, edits[(i, text)])
        after = order[(order.index(i) + 1) % len(order)]
        assert got[i].fingerprint == f"{mine:016x}" and got[i].edited_fingerprint == f"{other:016x}"
        assert got[i].near_edited == 1 - (mine ^ other).bit_count() / 64
        assert got[i].near_next == 1 - (mine ^ int(got[after].fingerprint, 16)).bit_count() / 64
    prints = [int(r.fingerprint, 16) for r in got.values()]
    for i, r in got.items():
        own = int(r.fingerprint, 16)
        near = sum((own ^ p).bit_count() <= queries.RADIUS for p in prints) - 1
        assert r.n_within == (near if i % 50 == 0 else None)
    assert sum(r.near_edited for r in got.values()) > sum(r.near_next for r in got.values()) + 0.1 * len(got)


def test_nulls_ties_repeats_and_empty(spark):
    schema = "doc_id long, text string, fingerprint string"
    rows = [(5, None, "x"), (1, "", "x"), (9, "ab", "y"), (9, "ab", "y"), (3, "a b  c\td", None), (3, "zz", None)]
    out = {(r.doc_id, r.text): r for r in simhash.edited(spark.createDataFrame(rows, schema)).collect()}
    expected = brute_edit([r[:2] for r in rows])
    assert {k: r.edited for k, r in out.items()} == expected
    assert simhash.edited(spark.createDataFrame([], schema)).count() == 0
    one = simhash.edited(spark.createDataFrame([(4, "abcdefgh", "")], schema)).first()
    assert one.next_id == 4 and one.edited == "abcdefab"
    prints = simhash.fingerprints(spark.createDataFrame([(1, None), (2, " \n"), (3, "a b")], "doc_id long, text string"),
                                  "text", ["doc_id"])
    assert {r.doc_id: r.fingerprint for r in prints.filter("doc_id < 3").collect()} == {1: 0, 2: 0}


@pytest.mark.parametrize("radius", [0, 3, 5])
def test_block_tables_find_all(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = []
    for b in base:
        for _ in range(6):
            x = b
            for j in rng.sample(range(64), rng.randint(0, radius + 2)):
                x ^= 1 << j
            prints.append(x)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    corpus = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    got = {(r.query, r.fingerprint) for r in simhash.within(corpus, corpus, radius).collect()}
    assert got == {(a, b) for a, x in zip(signed, prints) for b, y in zip(signed, prints)
                   if (x ^ y).bit_count() <= radius}

"""Periodic runs against brute force over all periods, and their rules for odd inputs."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("metricway.llm")

from metricway.llm import queries, runs  # noqa: E402
from metricway.llm.common import table  # noqa: E402


def brute(words):
    """Every maximal stretch of a period that is its least, (start, length, period)."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(12, 2 * q) and not any(
                    all(words[k] == words[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def words_of(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def test_random_words():
    rng = random.Random(3)
    for _ in range(1500):
        n, letters = rng.randint(0, 90), "abcdefgh"[: rng.choice([1, 2, 2, 3, 5])]
        words = [rng.choice(letters) for _ in range(n)]
        if n > 6 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        (found,), (rest,) = runs.found_in([" ".join(words)])
        found = [(r["start"], r["length"], r["period"]) for r in found]
        assert found == brute(words) and rest == collapsed(words, found)


def test_automaton_over_all_words_gives_the_same():
    """The stretches of repeated six words leave no square of a run out."""
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice("ab") for _ in range(rng.randint(12, 60))]
        whole = sorted(set(runs.runs_of(words, 0, len(words))), key=lambda r: (r[0], r[2]))
        assert whole == brute(words)


def test_texts_of_a_batch_stay_apart():
    same = "one two three four five six seven eight"
    assert runs.found_in([same, same, f"{same} {same}"])[0] == [[], [], [{"start": 0, "length": 16, "period": 8}]]


def test_query_against_brute_force(spark, sf):
    want = {}
    for r in table(spark, sf, "documents").collect():
        words, h = words_of(r.text), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = brute(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        listed = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        want[r.doc_id] = (len(found), *best, found and 1000 * best[1] // best[2] or None,
                          *(hashlib.sha256(t.encode()).hexdigest() for t in (listed, collapsed(words, found))))
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
           for r in queries.automaton_runs(spark, sf).collect()}
    assert got == want and any(w[0] for w in want.values())


def test_odd_texts(spark):
    texts = [None, "", " \n\t", "a " * 11, "a " * 12, "x\xa0y " * 12, "a\x0bb\x1cc " * 6, "日本 " * 13 + "語", "k l m " * 30_000]
    df = spark.createDataFrame([(None, t, i) for i, t in enumerate([*texts, *texts])], "doc_id long, text string, start int")
    out = {}
    for r in runs.with_runs(df).collect():
        out[r.start] = [tuple(x) for x in r.runs], r.collapsed
    for i, t in enumerate([*texts[:-1], *texts[:-1]]):
        i += i >= len(texts) - 1
        found = brute(words_of(t))
        assert out[i] == (found, collapsed(words_of(t), found))
    assert out[len(texts) - 1] == ([(0, 90_000, 3)], "k l m")
    assert runs.with_runs(df.limit(0)).count() == 0
    assert runs.with_runs(df).columns == ["doc_id", "start", "runs", "collapsed"]
    with pytest.raises(ValueError):
        runs.with_runs(df.withColumnRenamed("start", "runs"))

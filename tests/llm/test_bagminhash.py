"""BagMinHash: unbiased registers, exact classes against brute force, odd inputs."""

import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("metricway.llm")

from metricway.llm import bagminhash as bag  # noqa: E402
from metricway.llm.components import components  # noqa: E402


def multiset(text):
    words = bag.WORD.findall(text or "")
    size = min(5, len(words))
    return Counter(tuple(words[i: i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def jaccard(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [multiset(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            equal = rows[i][1] == rows[j][1]
            if equal or (sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= bag.SIMILARITY):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return {i: min(rows[k][0] for k in g) for g in groups.values() for i in g}


def test_registers_estimate_the_weighted_jaccard():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
    a[:5], b[:5] = 1000, 700
    m = 4000
    both = [bag.signatures(hashes[w > 0], w[w > 0], np.zeros((w > 0).sum(), int), 1, m)[0] for w in (a, b)]
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((both[0] == both[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / m)


def test_a_block_of_texts_equals_each_alone():
    shingler = bag.Shingler()
    texts = ["a b c d e f", "a b c d e f " * 30, "x", "one two three four five six seven eight"]
    own = [shingler(t) for t in texts]
    whole = bag.signatures(np.concatenate([o[0] for o in own]), np.concatenate([o[1] for o in own]),
                           np.repeat(np.arange(4), [len(o[0]) for o in own]), 4, 50)
    for i, o in enumerate(own):
        assert (bag.signatures(*o, np.zeros(len(o[0]), int), 1, 50)[0] == whole[i]).all()


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def test_classes_against_brute_force(spark):
    rng = random.Random(1)
    rows, vocabulary = [], [f"w{i}" for i in range(300)]
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 200))]
        rows += [near(rng, base, rng.randint(0, 3)) for _ in range(rng.randint(1, 6))]
    base = [rng.choice(vocabulary) for _ in range(300)]
    rows += [near(rng, base, rng.randint(0, 9)) for _ in range(60)]  # one large group of near copies
    rows += [None, None, "", "", " \n", "one", "one", "two words", "a b c d e " * 40, "a b c d e " * 41]
    rows = [(rng.randrange(10**6), t) for t in rows]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long")
    out = bag.classes(df).collect()
    expected = brute_classes(rows)
    assert sorted((r.doc_id, r.class_id) for r in out) == sorted((rows[i][0], c) for i, c in expected.items())
    assert sum(r.kept for r in out) == len(set(expected.values()))
    assert bag.classes(df.limit(0)).count() == 0


def test_a_bucket_with_several_groups_is_searched_through(spark):
    """All rows in one bucket: links that the first round misses are found by later ones."""
    rng = random.Random(2)
    bases = [[f"b{k}w{i}" for i in range(40)] for k in range(50)]
    rows = [(i, near(rng, bases[i % 50], i // 50)) for i in range(100)]
    nodes = spark.createDataFrame([(i, len(multiset(t).values()), [7]) for i, t in rows],
                                  "row long, weight long, bands array<long>")
    texts = spark.createDataFrame(rows, "row long, text string")
    found = {r.node: r.component for r in bag.linked(bag.buckets(nodes), texts).collect()}
    expected = brute_classes(rows)
    assert {i: found.get(i, i) for i, _ in rows} == expected


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    links += [(500, i) for i in range(501, 560)]
    label = {n: n for e in links for n in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(n, n) == c for n, c in label.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_ids_and_very_long_texts_are_linked(spark):
    """The same links with and without ids, also for texts of 60,000 words."""
    words = [f"w{i * 7919 % 50021}" for i in range(60_000)]
    base = " ".join(f"t{i}" for i in range(60))
    rows = [(None, base), (None, base + " end"), (None, " ".join(words)), (None, " ".join([*words, "more"])), (3, "something else altogether in here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = sorted(r.class_size for r in bag.classes(df).collect())
    assert sizes == [1, 2, 2, 2, 2] and bag.representatives(df).count() == 3

"""Sharding, rules, chat formatting, mixing and toxicity: laws, round trips and odd inputs."""

import random
import re

import pytest

pytest.importorskip("metricway.llm")

from pyspark.sql import functions as F  # noqa: E402

from metricway.llm import chat, language, mixing, queries, rules, sharding, toxicity  # noqa: E402
from registry.compare import compare  # noqa: E402


@pytest.mark.parametrize("name", sorted(k for k, v in queries.QUERIES.items() if v[1]))
def test_query_against_sql(spark, duck, sf, name):
    ok, note, rows = compare(spark, duck, sf, *queries.QUERIES[name])
    assert ok and rows, note


# sharding

def shard_checks(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    loads = [sum(r.size for r in by.get(k, [])) for k in range(shards)]
    assert sum(loads) == sum(r.size for r in rows)
    return loads


def test_shards_of_documents(spark, sf):
    rows = queries.histogram_sort(spark, sf).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    loads, largest = shard_checks(rows, 24), max(r.size for r in rows)
    assert max(loads) - min(loads) <= 2 * largest


def test_a_hot_key_is_cut_by_the_second(spark):
    rng = random.Random(3)
    rows = [(7 if rng.random() < 0.4 else rng.randrange(-2**62, 2**62), i, rng.randint(8, 60), "a") for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, size long, shard_name string").withColumnRenamed("shard_name", "leaf")
    out = sharding.histogram_sort(df, "a", "b", "size", 10).collect()
    loads = shard_checks(out, 10)
    assert max(loads) / min(loads) < 1.05 and len(out) == 3000
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [(r.a, r.b) for r in order] == sorted((r.a, r.b) for r in out)


def test_shards_of_little(spark):
    df = spark.createDataFrame([(1, 1, 8)] * 5, "a long, b long, size long")
    assert sorted(r.slot for r in sharding.histogram_sort(df, "a", "b", "size", 4).collect()) == list(range(5))
    assert sharding.histogram_sort(df.limit(0), "a", "b", "size", 4).count() == 0


# rules

def test_rules_of_odd_texts(spark):
    texts = [None, "", " \n", "a", "a b c a b c", "a b c d\na b c d", "x " * 60, "one two one two one two", "a\x0bb c"]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)],
                               "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in rules.adaptive_filter(rules.measured(df)).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k: k + 3]) for k in range(len(words) - 2)]
        covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert rules.adaptive_filter(rules.measured(df.limit(0))).count() == 0


def test_rules_follow_the_group(spark):
    """What is usual in one source is far outside the limits of another."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(500)]

    def text(marks):
        return " ".join(rng.choice(words) + ("#" if rng.random() < marks else "") for _ in range(120))

    rows = [(i, text(0.0), "en", "plain") for i in range(300)] + [(i, text(0.5), "en", "marked") for i in range(300, 600)]
    rows += [(600, text(0.5), "en", "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in rules.adaptive_filter(rules.measured(df)).collect()}
    assert not kept[600] and sum(kept.values()) == 600


# chat

def test_chat_round_trip(spark):
    rng = random.Random(8)
    parts = ["\\", "#", "##", "###", "####", "</turn>", "</turn>\n", "### User: ", "\n", "<", "/turn>", " ", "é", "x", "$1", "\\n"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]),
              None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))))
             for c in range(60) for t in range(rng.randint(1, 5))]
    df = spark.createDataFrame([(*t, "q") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    for c in range(60):
        own = [t for t in turns if t[0] == c]
        assert [(r["role"], r["text"]) for r in out[c].turns] == [(t[2] or "", t[3] or "") for t in own]
        assert out[c].loss_texts == [t[3] or "" for t in own if t[2] == "assistant"]
    assert chat.formatted(df.limit(0)).count() == 0


@pytest.mark.parametrize("roles, valid", [("u", True), ("ua", True), ("suaua", True), ("a", False), ("s", False), ("uu", False),
                                          ("su", True), ("sa", False), ("uaa", False), ("usa", False)])
def test_machine_over_roles(spark, roles, valid):
    names = {"u": "user", "a": "assistant", "s": "system"}
    df = spark.createDataFrame([(1, i, names[r], "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    assert chat.formatted(df).first().valid is valid


# mixing

def test_raking_meets_the_targets(spark):
    rng = random.Random(2)
    rows = [(s, g, t, rng.randint(500, 1500)) for s in "abcd" for g in ("x", None) for t in ("p", "q")]
    counted = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    out = mixing.raked(mixing.tempered(counted), rounds=40)
    for d in mixing.DIMENSIONS:
        for r in out.groupBy(d).agg(F.sum("weight").alias("w"), F.max(f"{d}_target").alias("t")).collect():
            assert abs(r.w - r.t) < 1e-6
    assert all(0 <= r.probability <= 1 + 1e-12 for r in mixing.probabilities(out).collect())


def test_mixing_odd_inputs(spark):
    rows = [(1, None, None, None, 1), (1, None, None, None, 1), (2, "a b", "s", "en", 2), (3, "", "s", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens_seen long")
    out = mixing.mixed(df.withColumnRenamed("tokens_seen", "id")).collect()
    assert len(out) == 4 and sorted(r.id for r in out) == [1, 1, 2, 3]
    assert len({r.chosen for r in out if r.doc_id == 1}) == 1
    assert mixing.mixed(df.limit(0)).count() == 0


# toxicity

def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.toxicity_label_model(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i].predicted, y) for i, y in labels.items() if i in got and got[i].held_out]
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(p == y for p, y in held) / len(held) > 0.96
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.85
    assert sum(p for p, y in held if not y) / sum(1 - y for _, y in held) < 0.03


def test_toxicity_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you worthless moron you stupid clown"), (4, "a fine day"), (4, "a fine day")],
                                 "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    marks = spark.createDataFrame([(3, 1), (3, None), (9, 1), (None, 1)], "doc_id long, toxic int")
    for labels in (none, marks):
        model = toxicity.fit(docs, labels, language.fold("doc_id", 5) >= 0)
        out = toxicity.score(docs, model, ["doc_id"]).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none, F.lit(True)), ["doc_id"]).count() == 0


def test_label_model_finds_accuracies_and_correlations():
    """Votes drawn from a known model: a noisy voter, a good one, and two that copy each other."""
    rng = random.Random(6)
    counts, truth = {}, {}
    for _ in range(40_000):
        y = rng.random() < 0.1
        good = rng.random() < (0.9 if y else 0.02)
        noisy = rng.random() < (0.5 if y else 0.3)
        copied = rng.random() < (0.6 if y else 0.05)
        pattern = good << 0 | noisy << 1 | copied << 2 | copied << 3
        counts[pattern] = counts.get(pattern, 0) + 1
        truth[(pattern, int(y))] = truth.get((pattern, int(y)), 0) + 1
    few = {k: max(1, v // 40) for k, v in truth.items()}
    model = toxicity.LabelModel.fitted(counts, few)
    assert model.accuracy[0] > model.accuracy[1] and model.correlation[2, 3] > 1
    posterior = model.posterior()
    for pattern, n in counts.items():
        if n > 500:
            assert abs(posterior[pattern] - truth.get((pattern, 1), 0) / n) < 0.15

import random

import pytest
from pyspark.sql import functions as F

from metricway.operators import scoring as E

RANKED = "a x b y z c q r s t".split()


@pytest.mark.parametrize("relevant, k, recall", [("abc", 5, 2 / 3), ("ab", 5, 1.0), ("axbyQ", 5, 4 / 5), ("abcqUVWXYZ", 10, 0.4)])
def test_recall_is_capped(spark, relevant, k, recall):
    hits = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(RANKED)], "query_id int, doc_id string, rank int")
    rel = spark.createDataFrame([(1, d) for d in relevant], "query_id int, doc_id string")
    row = E.retrieval_scores(hits, rel, (k,), 10).first()
    assert row[f"recall_{k}"] == pytest.approx(recall)


@pytest.mark.parametrize("relevant, mrr", [("a", 1.0), ("bz", 1 / 3), ("N", 0.0)])
def test_mrr(spark, relevant, mrr):
    hits = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(RANKED)], "query_id int, doc_id string, rank int")
    rel = spark.createDataFrame([(1, d) for d in relevant], "query_id int, doc_id string")
    assert E.retrieval_scores(hits, rel).first().mrr_10 == pytest.approx(mrr)


@pytest.mark.parametrize("values, q, want", [([5.0], 50, 5.0), ([1.0, 2.0, 3.0, 4.0], 50, 2.5), (list(map(float, range(1, 101))), 95, 95.05)])
def test_percentile(spark, values, q, want):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert E.percentiles(df, "v", [q]).first()[0] == pytest.approx(want)


def test_percentile_with_one_value_in_a_third_of_all_rows(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 77.0).otherwise(F.col("id").cast("double")).alias("v"))
    want = df.agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))).first()[0]
    assert list(E.percentiles(df, "v", [5, 50, 95]).first()) == pytest.approx(want)


def test_setups():
    with pytest.raises(ValueError):
        E.setup_warnings({"dataset": "golden"}, {"dataset": "holdout"})
    notes = E.setup_warnings({"judge model": "a", "search k": 5}, {"judge model": "b", "search k": 10})
    assert len(notes) == 2 and "not comparable" in notes[0] and "delta" in notes[1]


def test_gate(spark):
    found = spark.createDataFrame([("a", "sql"), ("b", "route")], "item string, key string")
    known = spark.createDataFrame([("b", "route"), ("c", "sql")], "item string, key string")
    assert {tuple(r) for r in E.gate(found, known).collect()} == {("a", "sql", "new failure"), ("c", "sql", "now passes")}


def test_percentiles_of_skewed_groups_in_several_rounds(spark, monkeypatch):
    """A group with most of the rows, one with a single value, one with a null key, none of nulls."""
    monkeypatch.setattr(E, "PROBES", 5)
    monkeypatch.setattr(E, "RANGE_VALUES", 7)
    rng = random.Random(4)
    rows = [("hot", rng.lognormvariate(0, 3)) for _ in range(3000)] + [("one", 5.0)] * 40 + [(None, float(i)) for i in range(90)]
    rows += [("few", 1.0), ("few", 2.0), ("none", None), ("inf", float("-inf")), ("inf", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0, 5, 50, 99.5, 100]
    got = {r.k: r for r in E.percentiles(df, "v", qs, ("k",)).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        values.sort()
        for q, name in zip(qs, ("p0", "p5", "p50", "p99_5", "p100")):
            spot = (len(values) - 1) * q / 100
            low, high = values[int(spot)], values[min(int(spot) + 1, len(values) - 1)]
            if k != "inf":
                assert got[k][name] == pytest.approx(low + (high - low) * (spot - int(spot)))
    empty = E.percentiles(df.filter("v > 1e99"), "v", [50]).collect()
    assert [r.p50 for r in empty] == [None]

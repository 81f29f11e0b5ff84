import hashlib
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from metricway.operators import assign as A
from metricway.operators import training as T


def skewed(spark, n=3000):
    """A third of all rows in one category."""
    return spark.range(n).select(F.concat(F.lit("CALL-"), F.col("id").cast("string")).alias("call_id"), F.when(
        F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("category"))


def test_rank_by_hash_is_a_plain_rank(spark):
    rows = skewed(spark).withColumn("h", F.sha2("call_id", 256))
    got = A.rank_by_hash(rows, ["category"], "h", "call_id")
    want = rows.withColumn("want", F.row_number().over(Window.partitionBy("category").orderBy("h")))
    assert got.join(want, "call_id").filter("place <> want").count() == 0


def test_splits_are_exact_and_stable(spark):
    calls = skewed(spark, 1250)
    rows = T.splits(calls)
    assert {r.split: r["count"] for r in rows.groupBy("split").count().collect()} == {"train": 800, "dev": 150, "test": 300}
    again = T.splits(calls.repartition(7))
    assert rows.select("call_id", "split").exceptAll(again.select("call_id", "split")).isEmpty()
    hot = [r.call_id for r in rows.filter("category = 'hot' AND split = 'test'").collect()]
    everyone = sorted((r.call_id for r in calls.filter("category = 'hot'").collect()),
                      key=lambda c: hashlib.sha256(f"summary_v1:{c}".encode()).hexdigest())
    assert set(hot) == set(everyone[:len(hot)])


def test_renumber_is_dense_when_one_moment_holds_a_third(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("at"))
    got = A.renumber(rows.withColumn("h", F.sha2(F.col("id").cast("string"), 256)), ["at", "h"], "n")
    want = rows.withColumn("w", F.row_number().over(Window.orderBy("at", F.sha2(F.col("id").cast("string"), 256))))
    assert got.join(want, "id").filter("n <> w").count() == 0


def test_review_quotas_are_the_slot_by_slot_rule(spark):
    def slot_by_slot(sizes, size, floor):
        """The rule as it is told, one slot after the other."""
        total = sum(sizes.values())
        if total <= size:
            return sizes
        held = {c: min(floor, n) for c, n in sizes.items()}
        while sum(held.values()) < size and any(held[c] < n for c, n in sizes.items()):
            free = [c for c, n in sizes.items() if held[c] < n]
            held[max(free, key=lambda c: (size * sizes[c] / total - held[c], c))] += 1
        return held

    for sizes, size in (({"a": 5, "b": 3}, 10), ({"a": 90, "b": 9, "c": 1}, 20), ({"a": 40, "b": 40, "c": 41}, 50),
                        ({"a": 1000, "b": 1, "c": 2, "d": 30}, 17), ({c: 3 for c in "abcdef"}, 14)):
        rows = spark.createDataFrame(list(sizes.items()), "category string, n long")
        assert {r.category: r.quota for r in T.review_quotas(rows, size).collect()} == slot_by_slot(sizes, size, 2)


def test_review_sample_takes_the_lowest_hashes(spark):
    rows = skewed(spark)
    got = T.review_sample(rows, 20)
    assert got.count() == 20
    hot = sorted(r.call_id for r in got.filter("category = 'hot'").collect())
    everyone = sorted((r.call_id for r in rows.filter("category = 'hot'").collect()),
                      key=lambda c: hashlib.sha256(f"review_v1:{c}".encode()).hexdigest())
    assert hot == sorted(everyone[:len(hot)])


def test_fingerprint_ignores_order_and_sees_a_change(spark):
    rows = skewed(spark)
    a = T.content_fingerprint(rows, "call_id", "category").first()[0]
    assert T.content_fingerprint(rows.repartition(5), "call_id", "category").first()[0] == a
    assert T.content_fingerprint(rows.limit(2999), "call_id", "category").first()[0] != a
    copy = rows.unionByName(rows.limit(1))
    assert T.content_fingerprint(copy, "call_id", "category").first()[0] != a
    assert T.content_fingerprint(rows.limit(0), "call_id").collect() == T.content_fingerprint(rows.filter("false"), "call_id").collect()


@pytest.mark.parametrize("a, b, want", [([], [], 1.0), (["x"], [], 0.0), (["x", "y"], ["y"], 2 / 3)])
def test_f1(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(T.f1(F.col("a"), F.col("b"))).first()
    assert row[0] == pytest.approx(want)


def test_shares_cover_the_unit(spark):
    shares = {"Westside": 0.20, "Downtown": 0.30, "Northgate": 0.25, "Riverside": 0.25}
    rows = spark.range(20000).select(A.hash_bucket(F.col("id").cast("string"), shares).alias("b")).groupBy("b").count().collect()
    assert {r.b for r in rows} == set(shares)
    assert all(abs(r["count"] / 20000 - shares[r.b]) < 0.02 for r in rows)


def test_fingerprint_folds_the_counted_rows_in_order(spark):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    rows = [(f"C{i % 900}", "train") for i in range(1000)]
    counted = sorted(Counter(sha(f"{a}\x01{b}") for a, b in rows).items())
    folds = {n: sha("".join(f"{h}x{m}" for h, m in counted if h[:4] == n)) for n in sorted({h[:4] for h, _ in counted})}
    halves = [sha("".join(h for n, h in folds.items() if n[:2] == p)) for p in sorted({n[:2] for n in folds})]
    got = T.content_fingerprint(spark.createDataFrame(rows, "call_id string, split string"), "call_id", "split").first()[0]
    assert got == sha("".join(halves))


def test_calls_are_dealt_by_their_number_and_labels_join_them_where_they_lie(spark):
    from metricway.session import dealt

    texts = dealt(spark.range(1000).select(F.concat(F.lit("C"), "id").alias("call_id"), F.lit("said").alias("text")), "call_id", rows=20)
    assert texts.rdd.getNumPartitions() == 50
    label = F.lit(None).cast("struct<reason_for_call:string,product_line:string,metric_mentioned:array<struct<name:string,value:string>>,"
                             "resolution:string,follow_up:struct<needed:boolean,action:string>>")
    labels = texts.select("call_id", F.lit(0).alias("seq"), label.alias("label"), F.sha2("text", 256).alias("text_sha256"))
    plan = T.kept_labels(labels, texts)._jdf.queryExecution().executedPlan().toString()
    assert "text_sha256" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)

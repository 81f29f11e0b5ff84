import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from metricway.operators import store
from metricway.operators.store import VersionedTable, ingest, tag_name, upsert
from metricway.sources import files, schemas
from metricway.streaming.ingest import bucket_stream, document_stream, upsert_stream


def test_every_declared_column_has_a_type():
    assert len(schemas.TABLES) == 21
    assert all(schemas.schema(t).fields for t in schemas.TABLES)
    assert schemas.KEYS["interaction_account"] == ("interaction_id", "account_id")
    with pytest.raises(ValueError):
        schemas.spark_type("MONEY")


def test_json_array_is_read_as_declared(spark, folder):
    rows = [{"survey_id": 1, "interaction_id": "7", "score": 5, "comment": None, "surveyed_at": "2026-03-01T10:00:00"},
            {"survey_id": 2, "interaction_id": 8, "score": "4", "comment": "x", "surveyed_at": "2026-03-02"}]
    with open(f"{folder}/csat.json", "w") as f:
        json.dump(rows, f, indent=1)
    got = files.read_json_array(spark, f"{folder}/csat.json", "csat_survey").orderBy("survey_id").collect()
    assert (got[0].interaction_id, got[0].surveyed_at, got[0].question_code) == (7, date(2026, 3, 1), None)


def test_a_bad_value_fails_the_load(spark):
    raw = spark.createDataFrame([("1", "five")], "survey_id string, score string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        schemas.typed(raw, "csat_survey").collect()


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = upsert(old, new, ["k"])
    assert sorted(map(tuple, upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "C")]


def test_batch_last_wins(spark):
    store = spark.createDataFrame([("a", "old")], "call_id string, text string")
    batch = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 0)], "call_id string, text string, seq int")
    assert sorted(map(tuple, ingest(store, batch).collect())) == [("a", "y"), ("b", "z")]


def test_versions_tags_and_rollback(spark, folder):
    table = VersionedTable(spark, folder)
    one = spark.createDataFrame([(1,)], "k int")
    assert table.publish(one) == 1 and table.tag("abc") == "seed-abc"
    assert table.publish(one.union(one)) == 2 and table.tag("abc") == "seed-abc-2"
    assert table.rollback("seed-abc") == 3
    assert (table.as_of().count(), table.as_of(2).count()) == (1, 2)
    with pytest.raises(ValueError):
        table.as_of("nothing")
    assert tag_name("x", {"seed-x", "seed-x-2"}) == "seed-x-3"


def test_counted_load(spark, folder):
    one = spark.range(5)
    assert files.load_counted({"a": one, "b": one.filter("id < 2")}, folder) == {"a": 5, "b": 2}


def test_record_is_never_overwritten(spark, folder):
    m = F.create_map(F.lit("python"), F.lit("3"))
    record = spark.range(1).select(F.lit("2026-01-01").alias("date"), *(F.lit("x").alias(c) for c in ("git_sha", "run", "hardware", "notes")),
                                   F.lit("evals").alias("area"), *(m.alias(c) for c in ("versions", "params", "metrics")))
    files.write_record(record, folder, "r1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_record(record, folder, "r1")
    with pytest.raises(ValueError):
        files.write_record(record.withColumn("area", F.lit("elsewhere")), folder, "r2")
    assert spark.read.text(f"{folder}/LATEST").first()[0] == "r1"


def test_change_log_and_csv(spark, folder):
    assert files.read_change_log(spark, f"{folder}/none.json").count() == 0
    with open(f"{folder}/log.json", "w") as f:
        json.dump([{"name": "b", "date": "2026-02-01"}, {"name": "a", "date": "2026-01-01"}, {"name": "", "date": "2026-01-01"}, {"name": "c"}], f)
    assert [r.name for r in files.read_change_log(spark, f"{folder}/log.json").collect()] == ["a", "b"]
    with open(f"{folder}/r.csv", "w") as f:
        f.write("Call_Volume,Rate,Name\n1250,0.575,\n")
    row = files.best_effort(files.read_result_csv(spark, f"{folder}/r.csv"), "call_volume", "rate", "name").first()
    assert (row.call_volume_long, row.rate_double, row.name_text) == (1250, 0.575, None)
    with open(f"{folder}/e.csv", "w") as f:
        f.write("a,b\n")
    with pytest.raises(ValueError):
        files.read_result_csv(spark, f"{folder}/e.csv")


def test_streamed_files_are_upserted(spark, folder):
    import os

    os.makedirs(f"{folder}/in")
    table = VersionedTable(spark, f"{folder}/table")

    def arrive(name, rows):
        with open(f"{folder}/in/{name}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        upsert_stream(document_stream(spark, f"{folder}/in", "call_id string, text string"), table, f"{folder}/check").awaitTermination()

    arrive("one", [{"call_id": "a", "text": "1"}, {"call_id": "b", "text": "1"}])
    arrive("two", [{"call_id": "b", "text": "2"}])
    assert sorted(map(tuple, table.as_of().select("call_id", "text").collect())) == [("a", "1"), ("b", "2")]
    newest = table.newest()
    upsert_stream(document_stream(spark, f"{folder}/in", "call_id string, text string"), table, f"{folder}/check").awaitTermination()
    assert table.newest() == newest


def test_buckets_rewritten_and_replayed(spark, folder):
    """Through the stream: only the buckets of a batch's keys get new files; late and repeated batches change nothing newer."""
    import os

    os.makedirs(f"{folder}/in")
    table = f"{folder}/table"

    def arrive(name, rows):
        with open(f"{folder}/in/{name}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        stream = document_stream(spark, f"{folder}/in", "call_id string, text string, metadata map<string,string>")
        bucket_stream(stream, table, f"{folder}/check", buckets=8).awaitTermination()

    def rows():
        return {r.call_id: (r.text, r.metadata) for r in spark.read.parquet(table).collect()}

    arrive("one", [{"call_id": f"c{i}", "text": "1", "metadata": {"n": str(i)}} for i in range(40)])
    before = {r.bucket: r.files for r in store.bucket_files(spark, table).collect()}
    arrive("two", [{"call_id": "c3", "text": "2", "metadata": {}}, {"call_id": "new", "text": "2"}])
    after = {r.bucket: r.files for r in store.bucket_files(spark, table).collect()}
    keys = spark.createDataFrame([("c3",), ("new",)], "k string").select(store.bucket_of(F.col("k"), 8)).collect()
    assert {b for b in after if after[b] != before.get(b)} == {r[0] for r in keys} != set(after)
    now = rows()
    assert len(now) == 41 and now["c3"] == ("2", {}) and now["new"] == ("2", None) and now["c4"] == ("1", {"n": "4"})
    stored = spark.read.parquet(table)
    older = stored.filter("call_id IN ('c3', 'c5')").drop("bucket").withColumn("text", F.lit("0")).withColumn(
        "seq", F.col("seq").withField("at", F.col("seq.at") - F.expr("INTERVAL 1 DAY")))
    store.ingest_buckets(table, older, "call_id", "seq", 8)
    assert rows() == now and store.ingest_buckets(table, older.limit(0), "call_id", "seq", 8) == []


def test_upsert_keeps_the_last_by_order_and_any_type(spark):
    old = spark.createDataFrame([(1, {"a": 1}, 0), (2, {"b": 1}, 0)], "id int, m map<string,int>, seq int")
    new = spark.createDataFrame([(1, {"z": 9}, 1), (1, {"a": 2}, 2), (3, None, 1)], "id int, m map<string,int>, seq int")
    rows = {r.id: r.m for r in store.upsert(old, new, ["id"], "seq").collect()}
    assert rows == {1: {"a": 2}, 2: {"b": 1}, 3: None}
    assert {r.id: r.m for r in store.upsert(old, new.filter("seq = 1"), ["id"]).collect()}[1] == {"z": 9}

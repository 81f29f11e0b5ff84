"""Reading with provenance, typed records, and arrays read by splits."""

import json

import pytest
from pyspark.sql import functions as F

from metricway.sources import checked, files, schemas


def test_line_numbers_are_exact_over_splits(spark, folder):
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(1, 3001)]
    for name in ("a.txt", "b.txt"):
        with open(f"{folder}/{name}", "w") as f:
            f.write("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = checked.numbered_lines(spark, folder)
        assert rows.filter(F.col("value") != F.element_at(F.array(*map(F.lit, lines[:50])), F.least("line", F.lit(50)).cast("int"))
                           ).filter("line <= 50").count() == 0
        got = sorted((r.file[-5:], r.line, r.value) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(n, i, v) for n in ("a.txt", "b.txt") for i, v in enumerate(lines, 1)]


def test_all_errors_are_told_together(spark, folder):
    good = {"id": "a", "type": "exact", "query": "q", "derivation": "d", "relevant": ["x"]}
    rows = [good, {**good, "id": 5}, "", {**good, "id": "b", "relevant": "x"}, {**good, "query": None, "type": 1}, good]
    with open(f"{folder}/q.jsonl", "w") as f:
        f.write("\n".join(json.dumps(r) if r else "" for r in rows) + "\n{broken\n[1]\n")
    read = checked.read_queries(spark, f"{folder}/q.jsonl")
    told = {r.line: r.errors for r in read.collect()}
    assert told == {1: ["id is repeated"], 2: ["id is no string"], 4: ["relevant is no array"], 5: ["query missing", "type is no string", "id is repeated"],
                    6: ["id is repeated"], 7: ["no JSON"], 8: ["no object"]}
    with pytest.raises(ValueError, match=r"7 bad records: q.jsonl:1: id is repeated; q.jsonl:2"):
        checked.require_clean(read)
    assert checked.require_clean(read.filter("line < 1")).count() == 0


@pytest.mark.parametrize("indent, split", [(None, True), (0, True), (2, False)])
def test_arrays(spark, folder, indent, split):
    """One line, an object a line, or objects over lines."""
    rows = [{"household_id": i, "household_label": f"name, ] {i}"} for i in range(40)]
    body = "[\n" + ",\n".join(json.dumps(r) for r in rows) + "\n]" if indent == 0 else json.dumps(rows, indent=indent)
    with open(f"{folder}/h.json", "w") as f:
        f.write(body)
    table = next(t for t in schemas.TABLES if "household_id" in schemas.declared(t) and "household_label" in schemas.declared(t))
    got = checked.read_json_array(spark, f"{folder}/h.json", table)
    want = files.read_json_array(spark, f"{folder}/h.json", table)
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 40


def test_result_csv_with_rows_that_do_not_fit(spark, folder):
    with open(f"{folder}/r.csv", "w") as f:
        f.write("A,B\n1,2\n3\n4,5,6\n")
    rows = {r.a: (r.b, len(r.errors)) for r in checked.read_result_csv(spark, f"{folder}/r.csv").collect()}
    assert rows == {"1": ("2", 0), "3": (None, 1), "4": ("5", 1)}
    with open(f"{folder}/e.csv", "w") as f:
        f.write("a,b\n")
    with pytest.raises(ValueError):
        checked.read_result_csv(spark, f"{folder}/e.csv")


def test_records_are_typed_and_never_written_over(spark, folder):
    record = {"date": "2026-01-02", "git_sha": "a1", "area": "evals", "run": "smoke / one", "hardware": "x", "versions": {"python": "3"},
              "params": {}, "metrics": {"recall": 0.5}, "notes": ""}
    one = spark.createDataFrame([(json.dumps(record),)], "value string")
    path = checked.write_record(one, folder)
    assert path.endswith("2026-01-02_smoke-one") and json.loads(spark.read.text(path).first()[0]) == record
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        checked.write_record(one, folder)
    assert checked.write_record(one, folder, {"2026-01-02_smoke-one"}).endswith("smoke-one-2")
    assert spark.read.text(f"{folder}/LATEST").first()[0] == "2026-01-02_smoke-one-2"
    bad = {"date": 5, "metrics": {"a": "high", "b": 1}, "area": None}
    told = checked.record_errors(spark.createDataFrame([(json.dumps({**record, **{k: v}}),) for k, v in bad.items()] + [("[]",)],
                                                       "value string")).collect()
    assert [r.errors for r in told] == [["date is no text"], ["no number: a"], ["missing area"], ["no JSON object"]]
    with pytest.raises(ValueError):
        checked.write_record(one.limit(0), folder)


def test_lines_of_an_array_are_parsed_once_for_each_form(spark, folder):
    lines = ["[", '{"interaction_id": 1, "category_code": "[a]"},', '[{"interaction_id": 2},', '{"interaction_id": 3}]', '[{"interaction_id": 4}],', "]"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{folder}/a")
    rows = checked.read_json_array(spark, f"{folder}/a", "interaction")
    assert sorted(r.interaction_id for r in rows.collect()) == [1, 2, 3, 4]
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("json(") <= 4 + 2  # the four forms; out and in again


@pytest.mark.parametrize("query", ["json_array", "query_file"])
def test_files_are_written_in_as_many_parts_as_there_are_tasks(spark, sf, query):
    from registry import ingestion

    ran = spark._jsparkSession.sharedState().statusStore().executionsList
    before = ran().size()
    getattr(ingestion, query)(spark, sf)
    executions = ran()
    plans = [executions.apply(i).physicalPlanDescription() for i in range(before, executions.size())]
    laid = [p for p in plans if "InsertIntoHadoopFs" in p and "Text" in p]
    assert laid and not any("rangepartitioning" in p for p in laid)

"""Many analyses at once against one at a time, in the small world with a planted change."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from metricway.operators import analyses as A
from metricway.operators import change as C
from test_change import calls, log  # noqa: F401 - fixtures

QUESTIONS = [
    ("free", "call_volume", None, None, None, None, None, 42),
    ("alpha", "csat_average_score", ["alpha", " alpha "], None, None, None, None, 42),
    ("dated", "average_handle_time", ["alpha"], ["North"], date(2026, 4, 1), None, None, 28),
    ("ranged", "average_handle_time", ["alpha"], [], None, date(2026, 4, 1), date(2026, 5, 1), 42),
    ("edge", "csat_average_score", ["alpha"], None, date(2026, 6, 20), None, None, 42),
    ("undated", "average_handle_time", None, None, None, None, None, 42),
    ("calm", "call_volume", ["beta"], None, None, None, None, 42),
    ("close", "call_volume", None, None, date(2026, 1, 6), None, None, 42),
    ("unknown", "nps", None, None, None, None, None, 5),
]
SCHEMA = ("id string, metric string, categories array<string>, branches array<string>, argument date, start date, end date, window_days int")


@pytest.fixture(scope="module")
def world(spark, calls, log):  # noqa: F811
    labels = calls.select("call_id", F.lit(0).alias("seq"), F.when(F.col("category") == "alpha", 1).otherwise(9).alias("number"),
                          F.concat(F.lit("said by "), "call_id").alias("quote"))
    fetched = calls.filter("call_id NOT LIKE '%7'")
    asked = spark.createDataFrame(QUESTIONS, SCHEMA)
    cube = A.CallCube(calls, fetched, labels, 3)
    out = A.analysed(asked, cube, log)
    return out, {r.id: r for r in out["analyses"].collect()}, cube


def test_states(world):
    rows = world[1]
    assert {i: r.status for i, r in rows.items() if r.status != "ok"} == {
        "undated": "needs a change point", "calm": "no change point", "close": "too near an end of the data",
        "unknown": "metric cannot be compared; window_days is not in 14..91"}


@pytest.mark.parametrize("name", ["free", "alpha", "dated", "ranged", "edge"])
def test_same_as_one_at_a_time(world, calls, log, name):  # noqa: F811
    row = world[1][name]
    _, metric, categories, branches, argument, start, end, days = next(q for q in QUESTIONS if q[0] == name)
    filters = {k: v for k, v in (("category", categories), ("home_branch", branches)) if v}
    search = {"start": str(start), "end": str(end)} if start else None
    want = C.explain(calls, log, metric, filters, str(argument) if argument else None, search, days)
    one = want["windows"].first()
    assert (row.day, row.source) == (want["change_point"]["day"], want["change_point"]["source"])
    for column in ("length", "before_start", "after_end", "before_n", "after_n"):
        assert row[column] == one[column]
    for column in ("before_value", "after_value", "change"):
        assert row[column] == pytest.approx(one[column])
    weeks = sorted(tuple(r) for r in world[0]["weeks"].filter(F.col("id") == name).select("week", "value", "n").collect())
    assert weeks == sorted(tuple(r) for r in want["weekly"].select("week", "value", "n").collect())
    picked = [r.scope for r in world[0]["picked"].filter(F.col("id") == name).collect()]
    assert picked == [f"={c}{A.SEP}{A.ALL}" for c in want["filters"].get("category", [])] if name == "free" else picked == []


def test_coverage_drivers_and_citations(world, calls):  # noqa: F811
    row = world[1]["free"]
    mine = calls.filter(F.col("category").eqNullSafe("alpha") & (F.col("day") >= row.before_start) & (F.col("day") < row.after_end))
    sides = {r.side: (r.n, r.got) for r in mine.groupBy(F.when(F.col("day") < row.day, "before").otherwise("after").alias("side")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("call_id").endswith("7")).alias("got")).collect()}
    assert (row.before_calls, row.before_fetched) == sides["before"] and (row.after_calls, row.after_fetched) == sides["after"]
    assert row.limits == "fewer calls fetched than counted" and (row.before_unassigned, row.after_unassigned) == (0, 0)
    assert "windows shortened" in world[1]["edge"].limits and "fewer records than calls" in world[1]["edge"].limits
    driver = world[0]["drivers"].filter("id = 'free'").collect()
    assert len(driver) == 1 and driver[0].after_scaled == pytest.approx(sides["after"][0]) and driver[0].direction == "up"
    cited = world[0]["citations"].filter("id = 'free'").orderBy("place").collect()
    want = mine.filter((F.col("day") >= row.day) & ~F.col("call_id").endswith("7")).orderBy(F.sha2("call_id", 256)).limit(3).collect()
    assert [c.call_id for c in cited] == [w.call_id for w in want]
    behind = A.driver_calls(world[0], world[2]).filter("id = 'free'")
    assert behind.count() == sides["before"][1] + sides["after"][1] == behind.select("call_id").distinct().count()
    assert not row.unsupported and row.drivers == 1


def test_no_questions(spark, world, log):  # noqa: F811
    out = A.analysed(spark.createDataFrame([], SCHEMA), world[2], log)
    assert all(out[k].count() == 0 for k in ("analyses", "drivers", "citations", "weeks"))

"""A small world with one planted change: 26 weeks from 2026-01-05, volume up in alpha from 2026-04-06."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from metricway.operators import change as C
from metricway.operators import evidence as E

START, CHANGE, END = date(2026, 1, 5), date(2026, 4, 6), date(2026, 7, 6)


@pytest.fixture(scope="module")
def calls(spark):
    rows, n = [], 0
    day = START
    while day < END:
        if day.weekday() < 5:
            for category in ("alpha", "beta", "gamma"):
                for _ in range(4 if category == "alpha" and day >= CHANGE else 1):
                    n += 1
                    late = category == "alpha" and day >= CHANGE
                    rows.append((f"CALL-{n:05d}", day, category, "South" if n % 5 == 0 else "North",
                                 None if n % 2 else (3 if late else 4), not (late and n % 3 == 0),
                                 420 if late else 300))
        day += timedelta(days=1)
    return spark.createDataFrame(rows, "call_id string, day date, category string, home_branch string, score int, "
                                       "resolved boolean, seconds int").cache()


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([("new fee", date(2026, 4, 8)), ("other", date(2026, 6, 20))], "name string, date date")


def test_detects_the_planted_week(calls):
    cube = C.daily_cube(calls, "call_volume")
    found = C.detect(cube, C.data_range(calls), "call_volume").first()
    assert (found.day, found.direction) == (CHANGE, "rise") and found.score > C.MIN_SCORE


def test_segments_without_change_do_not_stand_out(calls):
    cube = C.daily_cube(calls, "call_volume", ("category",))
    found = {r.category: r for r in C.detect(cube, C.data_range(calls), "call_volume", ("category",)).collect()}
    assert found["alpha"].day == CHANGE
    assert all(found[c].score < C.MIN_SCORE for c in ("beta", "gamma") if c in found)


def test_explain_snaps_to_the_log_and_picks_the_riser(calls, log):
    out = C.explain(calls, log, "call_volume")
    assert out["change_point"]["source"] == "detected"
    assert out["change_point"]["logged_change"] == "new fee"
    assert out["filters"] == {"category": ["alpha"]}
    row = out["windows"].first()
    assert (row.before_start, row.after_end, row.length) == (date(2026, 2, 25), date(2026, 5, 20), 42)
    assert row.before_n == calls.filter("category = 'alpha' AND day >= '2026-02-25' AND day < '2026-04-08'").count()
    assert [r.week for r in out["weekly"].orderBy("week").collect()][0] == date(2026, 4, 6)


def test_point_from_the_search_range(calls, log):
    out = C.explain(calls, log, "average_handle_time", {"category": "alpha"}, None,
                    {"start": "2026-04-01", "end": "2026-05-01"})
    assert out["change_point"]["source"] == "argument" and out["change_point"]["day"] == date(2026, 4, 8)


def test_windows_are_shortened_at_the_edge(calls, log):
    out = C.explain(calls, log, "csat_average_score", {"category": ["alpha"]}, "2026-06-20")
    assert out["notes"] and out["windows"].first().length == (END - timedelta(days=2) - date(2026, 6, 20)).days


@pytest.mark.parametrize("arguments", [
    {"metric": "nps"}, {"metric": "call_volume", "window_days": 7}, {"metric": "call_volume", "filters": {"x": ["y"]}},
    {"metric": "average_handle_time"}, {"metric": "call_volume", "change_point": "2026-01-06"},
    {"metric": "call_volume", "search_range": {"start": "2026-05-01", "end": "2026-05-01"}}])
def test_bad_requests(calls, log, arguments):
    with pytest.raises(ValueError):
        C.explain(calls, log, **arguments)


def test_nearest_logged_prefers_the_earlier_on_a_tie(spark):
    log = spark.createDataFrame([("a", date(2026, 4, 1)), ("b", date(2026, 4, 7))], "name string, date date")
    points = spark.createDataFrame([(date(2026, 4, 4),), (date(2026, 4, 20),)], "day date")
    hits = {r.day: r.logged_name for r in C.nearest_logged(points, log, 7).collect()}
    assert hits == {date(2026, 4, 4): "a", date(2026, 4, 20): None}


def test_quotes(spark):
    rows = spark.createDataFrame([
        ("I never agreed  to\nthis fee", "well I never agreed to this fee at all"), ("too short", "too short"),
        ('"I never agreed to this"', "I never agreed to this"), ("ask AGT-7 about this one", "ask AGT-7 about this one"),
        ("account 123456789 is mine", "account 123456789 is mine"), ("not in there at all", "something else")], "q string, t string")
    kept = [r[0] for r in rows.select(E.verbatim(F.col("q"), F.col("t"))).collect()]
    assert kept == ["I never agreed to this fee", None, "I never agreed to this", None, None, None]


def test_tally_counts_first_valid_label_and_caps_citations(spark):
    calls = spark.createDataFrame([(f"c{i}", "after" if i < 9 else "before") for i in range(12)], "call_id string, window string")
    sample = E.placed(calls, "window")
    assert sorted((r.window, r.place) for r in sample.collect()) == [("after", i) for i in range(1, 10)] + [("before", i) for i in range(1, 4)]
    labels = spark.createDataFrame([(f"c{i}", s, n, "a quote of some length") for i in range(12) for s, n in ((0, 9), (1, 1), (2, 2))]
                                   + [("zz", 0, 1, "x")], "call_id string, seq int, number int, quote string")
    valid = E.valid_assignments(labels, sample, 2)
    assert valid.count() == 12 and valid.filter("number = 1").count() == 12
    read = E.population(calls, "window")
    row = E.tally(valid, read).first()
    assert (row.before_n, row.after_n, len(row.citations), row.direction) == (3, 9, 3, "up")
    left = {r.window: r.unassigned for r in E.unassigned(E.tally(valid, read), read).collect()}
    assert left == {"before": 0, "after": 0}

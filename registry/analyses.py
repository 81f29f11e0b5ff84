"""Many change analyses at once: questions over every category and branch, and their answers as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricway.operators import analyses as A
from metricway.operators import change as C
from registry.base import check, plain, rounded, tables
from registry.changes import LOG_SQL, labels_of, log_of

ITEMS = 5
#: (id prefix, metric, argument, start, end, window_days), asked of every category, and of every branch.
PER_CATEGORY = (
    ("volume", "call_volume", None, None, None, 42),
    ("score", "csat_average_score", "1998-06-15", None, None, 42),
    ("resolution", "first_contact_resolution_rate", None, "1998-01-01", "1999-01-01", 28),
    ("logged", "first_contact_resolution_rate", None, "1999-10-01", "1999-12-01", 91),
    ("time", "average_handle_time", None, None, None, 42),
    ("late", "call_volume", "1998-08-01", None, None, 42),
)
PER_BRANCH = (
    ("branch volume", "call_volume", "1999-11-01", None, None, 42),
    ("branch time", "average_handle_time", "2000-05-08", None, None, 28),
    ("wrong", "nps", None, "1999-01-01", "1998-01-01", 7),
)
ALL_CALLS = (("all", "call_volume", "1995-03-06", None, None, 91), ("all scores", "csat_average_score", None, None, None, 42))


def asked_of(spark, sf):
    """A question for every value of both filters, and two over all calls."""
    calls = tables(spark, sf)["call_log"]

    def laid(values, kinds, categories, branches):
        rows = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(k, ("prefix", "metric", "argument", "start", "end",
                                                                                      "window_days")))) for k in kinds)))
        return values.select("v", rows.alias("k")).select(
            F.concat_ws("/", "k.prefix", "v").alias("id"), "k.metric", categories.alias("categories"), branches.alias("branches"),
            *(F.col(f"k.{c}").cast("date").alias(c) for c in ("argument", "start", "end")), "k.window_days")

    none = F.lit(None).cast("array<string>")
    one = F.array(F.concat(F.lit(" "), "v"))  # names are trimmed
    return laid(calls.select(F.col("category").alias("v")).distinct(), PER_CATEGORY, one, none).unionByName(
        laid(calls.filter("home_branch IS NOT NULL").select(F.col("home_branch").alias("v")).distinct(), PER_BRANCH, none, one)).unionByName(
        laid(spark.range(1).select(F.lit(None).cast("string").alias("v")), ALL_CALLS, none, none))


def answers_of(spark, sf):
    calls = tables(spark, sf)["call_log"]
    fetched = calls.filter("seconds % 10 <> 3")
    cube = A.CallCube(calls, fetched, labels_of(spark, sf), ITEMS)
    return A.analysed(asked_of(spark, sf), cube, log_of(spark)), cube


def answers(spark, sf):
    return rounded(answers_of(spark, sf)[0]["analyses"], 4)


def drivers(spark, sf):
    out = answers_of(spark, sf)[0]
    cited = out["citations"].groupBy("id", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "place", "call_id", "quote"))), lambda c: F.concat(c["call_id"], F.lit("="), c["quote"])), ";").alias("citations"))
    return rounded(out["drivers"].join(cited, ["id", "number"], "left").na.fill("", ["citations"]), 4)


def weeks(spark, sf):
    return rounded(answers_of(spark, sf)[0]["weeks"], 4)


def calls_behind(spark, sf):
    out, cube = answers_of(spark, sf)
    return A.driver_calls(out, cube).groupBy("id", "number", "side").agg(
        F.count("*").alias("calls"), F.min("call_id").alias("lowest"), F.max("call_id").alias("highest"))


def _asked_sql():
    def rows(kinds, source, cats, brs):
        values = ", ".join("('{}', '{}', {}, {}, {}, {})".format(
            p, m, *("NULL" if d is None else f"DATE '{d}'" for d in (a, s, e)), w) for p, m, a, s, e, w in kinds)
        return (f"SELECT {'prefix' if source is None else chr(39).join(('prefix || ', '/', ' || v'))} AS id, metric, {cats} AS cats, {brs} AS brs, "
                f"CAST(argument AS DATE) AS argument, CAST(s AS DATE) AS s, CAST(e AS DATE) AS e, wd "
                f"FROM (VALUES {values}) AS k(prefix, metric, argument, s, e, wd)"
                + (f", (SELECT DISTINCT {source} AS v FROM call_log WHERE {source} IS NOT NULL)" if source else ""))
    return " UNION ALL ".join((rows(PER_CATEGORY, "category", "v", "CAST(NULL AS VARCHAR)"),
                               rows(PER_BRANCH, "home_branch", "CAST(NULL AS VARCHAR)", "v"),
                               rows(ALL_CALLS, None, "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)")))


_VALUE = """CASE metric WHEN 'csat_average_score' THEN CAST(score AS DOUBLE) WHEN 'first_contact_resolution_rate' THEN CAST(resolved AS INT)
    WHEN 'average_handle_time' THEN seconds ELSE 1 END"""
_NEAR = f"""(SELECT {{}} FROM {LOG_SQL} WHERE abs(date_diff('day', top.d, date)) <= 7
    ORDER BY abs(date_diff('day', top.d, date)), date LIMIT 1)"""

#: From the questions to the calls of both windows, each rule as it is worded.
_BASE = f"""asked AS (SELECT *, CASE metric WHEN 'call_volume' THEN 'count' WHEN 'csat_average_score' THEN 'mean'
        WHEN 'first_contact_resolution_rate' THEN 'ratio' WHEN 'average_handle_time' THEN 'average' END AS kind FROM ({_asked_sql()})),
    good AS (SELECT * FROM asked WHERE kind IS NOT NULL AND wd BETWEEN 14 AND 91 AND (s IS NULL OR e > s)),
    span AS (SELECT min(day) AS data_start, max(day) + 1 AS data_end FROM call_log),
    w AS (SELECT id, CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS n, sum({_VALUE})::DOUBLE AS t
        FROM good JOIN call_log ON (cats IS NULL OR cats = category) AND (brs IS NULL OR brs = home_branch)
        WHERE metric <> 'csat_average_score' OR score IS NOT NULL GROUP BY ALL),
    c AS (SELECT id, kind, CAST(d AS DATE) AS d, data_start, data_end FROM good, span,
            unnest(generate_series(CAST(date_trunc('week', data_start) AS TIMESTAMP), CAST(data_end AS TIMESTAMP), INTERVAL 7 DAY)) AS g(d)
        WHERE d >= coalesce(s, data_start) AND d < least(coalesce(e, data_end), data_end)),
    sides AS (SELECT c.id, kind, d, sum(n) FILTER (week < d) AS n_b, sum(t) FILTER (week < d) AS t_b,
            sum(n) FILTER (week >= d) AS n_a, sum(t) FILTER (week >= d) AS t_a,
            date_diff('day', greatest(d - 91, data_start), d) / 7 AS w_b, date_diff('day', d, least(d + 28, data_end)) / 7 AS w_a
        FROM c JOIN w ON w.id = c.id AND week >= d - 91 AND week < d + 28 GROUP BY ALL),
    rates AS (SELECT *, CASE kind WHEN 'count' THEN n_b / w_b ELSE t_b / n_b END AS rb, CASE kind WHEN 'count' THEN n_a / w_a ELSE t_a / n_a END AS ra,
            (t_b + t_a) / (n_b + n_a) AS p FROM sides WHERE n_b >= 8 AND n_a >= 8),
    scored AS (SELECT id, d, coalesce(CASE kind WHEN 'count' THEN abs(ra - rb) / nullif(sqrt(ra / w_a + rb / w_b), 0)
            WHEN 'mean' THEN abs(ra - rb) / sqrt(1.0 / n_a + 1.0 / n_b)
            WHEN 'ratio' THEN abs(ra - rb) / nullif(sqrt(p * (1 - p) * (1.0 / n_a + 1.0 / n_b)), 0) END, 0) AS score,
            CASE WHEN ra > rb THEN 'rise' WHEN ra < rb THEN 'fall' END AS direction FROM rates),
    top AS (SELECT * FROM scored WHERE score > 1e-9 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 8) DESC, d) = 1),
    near AS (SELECT id, d, score, direction, {_NEAR.format('date')} AS near_date, {_NEAR.format('name')} AS near_name FROM top),
    inside AS (SELECT id, min(date) AS in_date, min(name) AS in_name FROM good JOIN {LOG_SQL} ON date >= s AND date < e
        GROUP BY 1 HAVING count(*) = 1),
    points AS (SELECT g.*, data_start, data_end,
            CASE WHEN argument IS NOT NULL THEN argument WHEN in_date IS NOT NULL THEN in_date WHEN score >= 2 THEN coalesce(near_date, d) END AS day,
            CASE WHEN argument IS NOT NULL OR in_date IS NOT NULL THEN 'argument' WHEN score >= 2 THEN 'detected' ELSE 'none' END AS source,
            CASE WHEN argument IS NOT NULL THEN (SELECT min(name) FROM {LOG_SQL} WHERE date = argument) WHEN in_date IS NOT NULL THEN in_name
                WHEN score >= 2 THEN near_name END AS logged_change,
            CASE WHEN argument IS NULL AND in_date IS NULL THEN round(coalesce(score, 0), 2) END AS score,
            CASE WHEN argument IS NULL AND in_date IS NULL AND score >= 2 THEN direction END AS direction
        FROM good g, span LEFT JOIN near ON near.id = g.id LEFT JOIN inside ON inside.id = g.id),
    placed AS (SELECT *, CASE WHEN kind = 'average' AND source <> 'argument' THEN 'needs a change point' WHEN day IS NULL THEN 'no change point'
            WHEN length < 7 THEN 'too near an end of the data' ELSE 'ok' END AS status
        FROM (SELECT *, CAST(least(wd, date_diff('day', data_start, day), date_diff('day', day, data_end)) AS INT) AS length FROM points)),
    ok AS (SELECT * FROM placed WHERE status = 'ok'),
    picked AS (SELECT id, category FROM (SELECT o.id, l.category, count(*) FILTER (l.day < o.day) AS b, count(*) FILTER (l.day >= o.day) AS a
            FROM ok o JOIN call_log l ON l.day >= o.day - length AND l.day < o.day + length WHERE cats IS NULL AND brs IS NULL GROUP BY 1, 2)
        WHERE a > b AND (a - b) / sqrt(a + b) >= 2
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY (a - b) / sqrt(a + b) DESC, category) <= 5),
    seen AS (SELECT o.id, metric, kind, o.day AS point, length, l.*, CASE WHEN l.day < o.day THEN 'before' ELSE 'after' END AS side,
            seconds % 10 <> 3 AS has, CASE WHEN seconds % 10 <> 3 THEN CASE WHEN seconds % 7 BETWEEN 1 AND 5 THEN seconds % 7
                WHEN (seconds + 1) % 7 BETWEEN 1 AND 5 THEN (seconds + 1) % 7 END END AS number
        FROM ok o JOIN call_log l ON (cats IS NULL OR cats = category) AND (brs IS NULL OR brs = home_branch)
          AND (category IN (SELECT category FROM picked WHERE picked.id = o.id) OR NOT EXISTS (SELECT 1 FROM picked WHERE picked.id = o.id)))"""

_SUMS = f"""{_BASE},
    inwin AS (SELECT * FROM seen WHERE day >= point - length AND day < point + length),
    tallied AS (SELECT id, number, count(*) FILTER (side = 'before') AS before_n, count(*) FILTER (side = 'after') AS after_n
        FROM inwin WHERE number IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (side = 'after') > 0),
    held AS (SELECT id, count(*) AS drivers, sum(before_n) AS b, sum(after_n) AS a FROM tallied GROUP BY 1),
    sums AS (SELECT id, {", ".join(f"count(*) FILTER (side = '{s}' AND (kind <> 'mean' OR score IS NOT NULL)) AS {s}_n, "
                                  f"sum({_VALUE}) FILTER (side = '{s}')::DOUBLE AS {s}_total, count(*) FILTER (side = '{s}') AS {s}_calls, "
                                  f"count(*) FILTER (side = '{s}' AND has) AS {s}_fetched" for s in ("before", "after"))}
        FROM inwin GROUP BY 1)"""


def _answers_sql():
    def v(side):
        return f"CASE WHEN kind = 'count' THEN CAST({side}_n AS DOUBLE) ELSE {side}_total / nullif({side}_n, 0) END"
    def r(side):
        return f"CASE WHEN kind = 'count' THEN {side}_n / (length / 7) ELSE {side}_total / nullif({side}_n, 0) END"
    sides = ", ".join(f"coalesce({s}_{x}, 0) AS {s}_{x}" for x in ("n", "calls", "fetched") for s in ("before", "after"))
    return check(f"""WITH {_SUMS},
        filled AS (SELECT o.*, {sides}, before_total, after_total, b, a, drivers
            FROM ok o LEFT JOIN sums USING (id) LEFT JOIN held USING (id)),
        done AS (SELECT id, length, strftime(day - length, '%Y-%m-%d') AS before_start, strftime(day + length, '%Y-%m-%d') AS after_end,
            round({v('before')}, 4) AS before_value, round({v('after')}, 4) AS after_value,
            before_n, after_n, before_calls, after_calls, before_fetched, after_fetched,
            round(({r('after')} - {r('before')}) * CASE WHEN kind = 'ratio' THEN 100 ELSE 1 END, 4) AS change,
            CASE WHEN kind = 'count' THEN round(({r('after')} - {r('before')}) / nullif({r('before')}, 0), 4) END AS change_share,
            CAST(before_fetched - coalesce(b, 0) AS BIGINT) AS before_unassigned, CAST(after_fetched - coalesce(a, 0) AS BIGINT) AS after_unassigned,
            coalesce(drivers, 0) AS drivers, source = 'detected' AND before_fetched + after_fetched > 0 AND drivers IS NULL AS unsupported,
            concat_ws('; ', CASE WHEN length < wd THEN 'windows shortened' END,
                CASE WHEN before_fetched + after_fetched < before_calls + after_calls THEN 'fewer calls fetched than counted' END,
                CASE WHEN before_n + after_n < before_calls + after_calls THEN 'fewer records than calls' END) AS limits FROM filled)
        SELECT p.id, metric, status, strftime(p.day, '%Y-%m-%d') AS day, source, logged_change, score, direction, done.* EXCLUDE (id)
        FROM placed p LEFT JOIN done USING (id)
        UNION ALL BY NAME
        SELECT id, metric, concat_ws('; ', CASE WHEN kind IS NULL THEN 'metric cannot be compared' END,
            CASE WHEN wd NOT BETWEEN 14 AND 91 THEN 'window_days is not in 14..91' END,
            CASE WHEN e <= s THEN 'the search range ends before it starts' END) AS status
        FROM asked WHERE id NOT IN (SELECT id FROM good)""")


QUERIES = {
    "change_analyses": (answers, _answers_sql()),
    "change_analysis_drivers": (drivers, check(f"""WITH {_SUMS},
        cites AS (SELECT id, number, string_agg(call_id || '=the length was ' || seconds, ';' ORDER BY r) AS citations FROM (
            SELECT *, row_number() OVER (PARTITION BY id, number ORDER BY sha256(call_id)) AS r FROM inwin
            WHERE side = 'after' AND number IS NOT NULL AND seconds % 2 = 0) WHERE r <= 3 GROUP BY 1, 2),
        scaled AS (SELECT t.*, coalesce(t.before_n * (before_calls / nullif(before_fetched, 0)), 0) AS before_scaled,
            coalesce(t.after_n * (after_calls / nullif(after_fetched, 0)), 0) AS after_scaled FROM tallied t JOIN sums USING (id))
        SELECT s.id, s.number, before_n, after_n, round(before_scaled, 4) AS before_scaled, round(after_scaled, 4) AS after_scaled,
            CASE WHEN after_scaled > before_scaled THEN 'up' WHEN after_scaled < before_scaled THEN 'down' ELSE 'flat' END AS direction,
            coalesce(citations, '') AS citations FROM scaled s LEFT JOIN cites USING (id, number)""")),
    "change_analysis_weeks": (weeks, check(f"""WITH {_BASE}
        SELECT id, strftime(CAST(date_trunc('week', day) AS DATE), '%Y-%m-%d') AS week,
            round(CASE WHEN kind = 'count' THEN count(*) ELSE sum({_VALUE})::DOUBLE / count(*) END, 4) AS value, count(*) AS n
        FROM seen WHERE (kind <> 'mean' OR score IS NOT NULL) AND date_trunc('week', day) + INTERVAL 7 DAY > point
          AND date_trunc('week', day) < point + length GROUP BY id, kind, date_trunc('week', day)""")),
    "change_analysis_calls": (calls_behind, check(f"""WITH {_SUMS}
        SELECT id, number, side, count(*) AS calls, min(call_id) AS lowest, max(call_id) AS highest FROM inwin JOIN tallied USING (id, number)
        GROUP BY 1, 2, 3""")),
}

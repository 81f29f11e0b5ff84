"""Change analysis: series, detection, windows, samples, tallies, grounding."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from metricway.operators import change as C
from metricway.operators import evidence as E
from metricway.operators.quotes import quote_pairs
from registry.base import check, plain, rounded, star, tables

LOG = (("fee schedule", "1997-03-04"), ("card outage", "1998-06-15"), ("app release", "1998-06-19"),
       ("branch move", "1999-11-01"), ("new phone menu", "2000-05-08"))
POINT, LENGTH = date(1998, 6, 15), 42
LOG_SQL = "(VALUES " + ", ".join(f"('{n}', DATE '{d}')" for n, d in LOG) + ") AS log(name, date)"


def log_of(spark):
    return spark.createDataFrame(LOG, "name string, date string").select(
        "name", F.col("date").cast("date").alias("date"))


def calls_of(spark, sf):
    return tables(spark, sf)["call_log"]


_RECORD = {"call_volume": "true", "csat_average_score": "score IS NOT NULL",
           "first_contact_resolution_rate": "true", "average_handle_time": "true"}
_ADDS = {"call_volume": "1", "csat_average_score": "score",
         "first_contact_resolution_rate": "CAST(resolved AS INT)", "average_handle_time": "seconds"}


def _value_sql(metric, total, n):
    if metric == "call_volume":
        return f"CAST(coalesce({n}, 0) AS DOUBLE)"
    return f"CAST({total} AS DOUBLE) / nullif({n}, 0)"


# ── series and windows ────────────────────────────────────────────────────────

def weekly(metric, segment=()):
    def run(spark, sf):
        cube = C.daily_cube(calls_of(spark, sf), metric, segment)
        return rounded(C.weekly_series(cube, metric, segment))
    return run


def weekly_sql(metric, segment=()):
    cols = "".join(f"{s}, " for s in segment)
    return check(f"""SELECT strftime(CAST(date_trunc('week', day) AS DATE), '%Y-%m-%d') AS week, {cols}
        round({_value_sql(metric, f'sum({_ADDS[metric]})', 'count(*)')}, 6) AS value, count(*) AS n
        FROM call_log WHERE {_RECORD[metric]} GROUP BY ALL""")


def data_range(spark, sf):
    return plain(C.data_range(calls_of(spark, sf)))


def fixed_windows(spark):
    return spark.createDataFrame([(POINT,)], "day date")


def windows_of(spark, sf, segment=()):
    calls = calls_of(spark, sf)
    return C.fit_windows(fixed_windows(spark), C.data_range(calls), LENGTH)


def window_values(metric):
    def run(spark, sf):
        cube = C.daily_cube(calls_of(spark, sf), metric)
        values = C.movement(C.window_values(cube, windows_of(spark, sf), metric), metric)
        return rounded(values)
    return run


def window_values_sql(metric):
    kind = C.METRICS[metric].kind
    both = ", ".join(
        f"{_value_sql(metric, f'sum({_ADDS[metric]}) FILTER ({w})', f'count(*) FILTER ({w})')} AS {s}_value, "
        f"count(*) FILTER ({w}) AS {s}_n"
        for s, w in (("before", "day < DATE '1998-06-15'"), ("after", "day >= DATE '1998-06-15'")))
    if kind == "count":
        change = "(after_n - before_n) / 6.0"
        share = "round((after_n - before_n) / before_n, 6)"
    else:
        change = f"(after_value - before_value) * {100 if kind == 'ratio' else 1}"
        share = "CAST(NULL AS DOUBLE)"
    return check(f"""WITH sums AS (SELECT {both} FROM call_log WHERE {_RECORD[metric]}
            AND day >= DATE '1998-05-04' AND day < DATE '1998-07-27')
        SELECT '1998-06-15' AS point, '1998-05-04' AS before_start, '1998-07-27' AS after_end, 42 AS length,
            round(before_value, 6) AS before_value, before_n, round(after_value, 6) AS after_value, after_n,
            round({change}, 6) AS change, {share} AS change_share FROM sums""")


def after_weeks(spark, sf):
    cube = C.daily_cube(calls_of(spark, sf), "first_contact_resolution_rate")
    series = C.weekly_series(cube, "first_contact_resolution_rate")
    return rounded(C.after_weeks(series, windows_of(spark, sf)))


def riser_rows(spark, sf):
    calls = calls_of(spark, sf)
    points = spark.createDataFrame([(date(1995, 3, 6),)], "day date")
    windows = C.fit_windows(points, C.data_range(calls), 91)
    # Every customer segment is a category here, so the small volumes of some rise by chance.
    wide = calls.withColumn("category", F.concat_ws("/", "category", "home_branch", F.col("resolved").cast("string")))
    return rounded(C.risers(C.daily_cube(wide, "call_volume", ("category",)), windows))


# ── detection ─────────────────────────────────────────────────────────────────

def detected(metric, segment=(), search=None):
    def run(spark, sf):
        calls = calls_of(spark, sf)
        cube = C.daily_cube(calls, metric, segment)
        return rounded(C.detect(cube, C.data_range(calls), metric, segment, search), 4)
    return run


def detect_sql(metric, segment=(), search=None):
    """Candidates joined to the weeks of each side, as the rule is worded."""
    kind = C.METRICS[metric].kind
    keys = "".join(f"{s}, " for s in segment)
    on = "".join(f" AND c.{s} IS NOT DISTINCT FROM w.{s}" for s in segment)
    first, last = ((f"DATE '{search[0]}'", f"least(DATE '{search[1]}', data_end)") if search
                   else ("data_start", "data_end"))
    if kind == "count":
        rb, ra = "n_b / weeks_b", "n_a / weeks_a"
        score = f"coalesce(abs({ra} - {rb}) / nullif(sqrt({ra} / weeks_a + {rb} / weeks_b), 0), 0)"
    elif kind == "mean":
        rb, ra = "t_b / n_b", "t_a / n_a"
        score = f"abs({ra} - {rb}) / sqrt(1.0 / n_a + 1.0 / n_b)"
    else:
        rb, ra = "t_b / n_b", "t_a / n_a"
        p = "((t_b + t_a) / (n_b + n_a))"
        score = f"coalesce(abs({ra} - {rb}) / nullif(sqrt({p} * (1 - {p}) * (1.0 / n_a + 1.0 / n_b)), 0), 0)"
    return check(f"""
        WITH span AS (SELECT min(day) AS data_start, max(day) + 1 AS data_end FROM call_log),
        w AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, {keys} count(*) AS n,
                     CAST(sum({_ADDS[metric]}) AS DOUBLE) AS t
              FROM call_log WHERE {_RECORD[metric]} GROUP BY ALL),
        k AS (SELECT DISTINCT {keys} 1 AS one FROM w),
        c AS (SELECT k.*, CAST(d AS DATE) AS d, data_start, data_end FROM k, span,
                unnest(generate_series(CAST(date_trunc('week', data_start) AS TIMESTAMP),
                       CAST(data_end AS TIMESTAMP), INTERVAL 7 DAY)) AS g(d)
              WHERE d >= {first} AND d < {last}),
        s AS (SELECT {''.join(f'c.{x}, ' for x in segment)} d, data_start, data_end,
                sum(n) FILTER (week < d) AS n_b, sum(t) FILTER (week < d) AS t_b,
                sum(n) FILTER (week >= d) AS n_a, sum(t) FILTER (week >= d) AS t_a,
                date_diff('day', greatest(d - 91, data_start), d) / 7 AS weeks_b,
                date_diff('day', d, least(d + 28, data_end)) / 7 AS weeks_a
              FROM c JOIN w ON week >= d - 91 AND week < d + 28{on} GROUP BY ALL),
        scored AS (SELECT {keys} d, {score} AS score,
                CASE WHEN {ra} > {rb} THEN 'rise' WHEN {ra} < {rb} THEN 'fall' END AS direction
              FROM s WHERE n_b >= 8 AND n_a >= 8)
        SELECT {keys} strftime(d, '%Y-%m-%d') AS day, round(score, 4) AS score, direction FROM scored
        WHERE score > 1e-9 QUALIFY row_number() OVER (
            {f"PARTITION BY {', '.join(segment)}" if segment else ''} ORDER BY round(score, 8) DESC, d) = 1""")


def nearest(spark, sf):
    days = calls_of(spark, sf).groupBy("day").agg(F.count("*").alias("calls"))
    return plain(C.nearest_logged(days, log_of(spark), C.SNAP_DAYS))


def inside(spark, sf):
    """For every category and year: the logged changes inside its range of days."""
    ranges = calls_of(spark, sf).groupBy("category", F.year("day").alias("y")).agg(
        F.min("day").alias("start"), F.date_add(F.max("day"), 1).alias("end")).select(
            F.concat_ws("/", "category", "y").alias("id"), "start", "end")
    return plain(C.logged_inside(ranges, log_of(spark)))


def resolved(spark, sf):
    """One analysis per category: an argument, a search range, or nothing but the data."""
    calls = calls_of(spark, sf)
    cube = C.daily_cube(calls, "first_contact_resolution_rate", ("category",))
    found = C.detect(cube, C.data_range(calls), "first_contact_resolution_rate", ("category",))
    number = F.substring("category", 1, 1).cast("int")
    asked = calls.select("category").distinct().select(
        "category", F.when(number == 1, F.lit("1998-06-15").cast("date")).alias("argument"),
        F.when(number == 2, F.lit("1999-10-01").cast("date")).alias("start"),
        F.when(number == 2, F.lit("1999-12-01").cast("date")).alias("end"))
    return rounded(C.resolve_points(asked, found, log_of(spark), "category"), 2)


def fitted(spark, sf):
    """Windows around every Monday of the data, shortened where the data ends."""
    calls = calls_of(spark, sf)
    mondays = calls.select(C.monday(F.col("day")).alias("day")).distinct()
    return plain(C.fit_windows(mondays, C.data_range(calls), 42))


def explain_windows(spark, sf):
    out = C.explain(calls_of(spark, sf), log_of(spark), "call_volume", None, "1998-06-15", None, 42)
    return rounded(out["windows"])


# ── evidence ──────────────────────────────────────────────────────────────────

def in_windows(spark, sf):
    """Calls of both windows: before [1998-05-04, 1998-06-15), after [.., 1998-07-27)."""
    calls = calls_of(spark, sf).filter((F.col("day") >= "1998-05-04") & (F.col("day") < "1998-07-27"))
    return calls.withColumn("window", F.when(F.col("day") < "1998-06-15", "before").otherwise("after"))


def window_calls(spark, sf):
    return in_windows(spark, sf).select("window", "call_id", "category", "seconds")


def labels_of(spark, sf):
    """Two labels a call, from a rule on its length; numbers outside 1..5 are no label."""
    calls = calls_of(spark, sf)
    rows = calls.select("call_id", "seconds", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    return rows.select("call_id", "seq", ((F.col("seconds") + F.col("seq")) % 7).alias("number"),
                       F.when(F.col("seconds") % 2 == 0, F.concat(F.lit("the length was "), "seconds")).alias("quote"))


def tallied(spark, sf):
    calls = window_calls(spark, sf)
    assigned = E.valid_assignments(labels_of(spark, sf), calls, 5)
    read = E.population(calls, "window")
    return assigned, E.tally(assigned, read), read


def driver_tally(spark, sf):
    _, rows, _ = tallied(spark, sf)
    cited = F.array_join(F.transform("citations", lambda c: F.concat(c["call_id"], F.lit("="), c["quote"])), ";")
    return rounded(rows.select("number", "before_n", "after_n", "before_scaled", "after_scaled", "direction", cited.alias("citations")))


def driver_calls(spark, sf):
    """The calls behind every driver, a row each."""
    assigned, rows, _ = tallied(spark, sf)
    return E.item_calls(assigned, rows)


_WINDOWED = """windowed AS (SELECT *, CASE WHEN day < DATE '1998-06-15' THEN 'before' ELSE 'after' END AS win
        FROM call_log WHERE day >= DATE '1998-05-04' AND day < DATE '1998-07-27'),
    sampled AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY sha256(call_id)) AS place
        FROM windowed),
    marked AS (SELECT s.*, CASE WHEN seconds % 7 BETWEEN 1 AND 5 THEN seconds % 7
                                WHEN (seconds + 1) % 7 BETWEEN 1 AND 5 THEN (seconds + 1) % 7 END AS number,
        CASE WHEN seconds % 2 = 0 THEN 'the length was ' || seconds END AS quote FROM sampled s),
    reads AS (SELECT win, count(*) AS population, count(*) AS n FROM windowed GROUP BY 1)"""

_TALLY = f"""{_WINDOWED},
    rough AS (SELECT number, count(*) FILTER (win = 'before') AS before_n, count(*) FILTER (win = 'after') AS after_n
        FROM marked WHERE number IS NOT NULL GROUP BY 1),
    cites AS (SELECT number, string_agg(call_id || '=' || quote, ';' ORDER BY place) AS citations FROM (
        SELECT *, row_number() OVER (PARTITION BY number ORDER BY place) AS r FROM marked
        WHERE win = 'after' AND quote IS NOT NULL AND number IS NOT NULL) WHERE r <= 3 GROUP BY 1),
    counted AS (SELECT r.*, coalesce(citations, '') AS citations, CAST(before_n AS DOUBLE) AS before_scaled, CAST(after_n AS DOUBLE) AS after_scaled
        FROM rough r LEFT JOIN cites USING (number) WHERE after_n > 0)"""


def unassigned_rows(spark, sf):
    _, rows, read = tallied(spark, sf)
    return E.unassigned(rows, read)


def quotes(spark, sf):
    """Which passages stand verbatim in which documents (whole texts, white space aside).

    Candidate pairs share the rarest words of the passage, so only those are compared.
    """
    t = tables(spark, sf)
    pairs = quote_pairs(t["benchmark"].select("item_id", F.col("text").alias("quote")),
                        t["documents"].select("doc_id", "text"))
    return pairs.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


def cited(spark, sf):
    """What of a text may be cited: cut from every document at a place of its own, some with an agent's id or an account number."""
    d = tables(spark, sf)["documents"].select("doc_id", "text")
    start = (F.col("doc_id") * 37 % 400 + 1).cast("int")
    cut = F.substr("text", start, (F.col("doc_id") * 13 % 420).cast("int"))
    quote = (F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("agent AGT-17 said "), cut))
             .when(F.col("doc_id") % 9 == 1, F.concat(cut, F.lit(" of account 1234567890")))
             .when(F.col("doc_id") % 9 == 2, F.concat(F.lit('"'), cut, F.lit('"'))).when(F.col("doc_id") % 9 == 3, F.upper(cut)).otherwise(cut))
    shown = E.verbatim(quote, F.concat(F.lit("agent AGT-17 said "), F.col("text"), F.lit(" of account 1234567890")))
    return d.select("doc_id", F.length(shown).alias("chars"), F.sha2(shown, 256).alias("quote_sha256"))


def coaching(spark, sf):
    calls = calls_of(spark, sf)
    groups = calls.select(F.concat_ws("/", "category", F.year("day")).alias("label"), "call_id")
    labels = labels_of(spark, sf).filter("seq = 0 AND number BETWEEN 1 AND 3")
    rows = E.patterns(groups, labels)
    return rows.select("label", "number", "n", "of", F.array_join(
        F.transform("citations", lambda c: c["call_id"]), ",").alias("cited"))


def grounding(spark, sf):
    """Each year's answer cites all its calls; every fifth id is one that does not exist."""
    calls = calls_of(spark, sf)
    cited = calls.select(
        F.year("day").alias("answer"),
        F.when(F.col("seconds") % 5 == 0, F.concat("call_id", F.lit("X"))).otherwise(F.col("call_id")).alias("call_id"))
    windows = calls.groupBy(F.year("day").alias("answer")).agg(
        F.min("day").alias("before_start"), F.date_sub(F.max("day"), 30).alias("after_end"))
    return E.grounded_citations(cited, calls, windows)


def grounded(spark, sf):
    calls = calls_of(spark, sf)
    checked = grounding(spark, sf)
    answers = calls.groupBy(F.year("day").alias("answer")).agg(F.max("seconds").alias("longest")).select(
        "answer", F.lit("SELECT 1").alias("sql"),
        F.when(F.col("answer") % 2 == 0, "agent AGT-007 said").otherwise("calls rose").alias("shown"),
        F.lit(True).alias("claims_point"))
    return E.grounded_answers(answers, checked)


def recomputed(spark, sf):
    """The answer key: (value, n) per category and week straight from the raw calls, beside the
    cube's series. `same` says whether they agree."""
    calls = calls_of(spark, sf)
    raw = calls.filter("score IS NOT NULL").groupBy(C.monday(F.col("day")).alias("week"), "category").agg(
        F.avg("score").alias("raw_value"), F.count("*").alias("raw_n"))
    series = C.weekly_series(C.daily_cube(calls, "csat_average_score", ("category",)), "csat_average_score", ("category",))
    both = raw.join(series, ["week", "category"], "full_outer")
    same = (F.round("value", 2) == F.round("raw_value", 2)) & (F.col("n") == F.col("raw_n"))
    return both.groupBy("category").agg(F.count("*").alias("weeks"), F.count_if(same).alias("same"))


def truth(spark, sf):
    calls = calls_of(spark, sf)
    events = log_of(spark).select(F.col("name").alias("id"), F.col("date").alias("day"),
                                  F.when(F.col("name").contains("card"), "1-URGENT").alias("category"))
    return rounded(E.event_truth(events, calls, 42, C.data_range(calls)), 4)


def unsupported_rows(spark, sf):
    """Per category: a shift found only by detection, with calls read and no label among them."""
    calls = calls_of(spark, sf)
    found = resolved(spark, sf).select("category", "source")
    labels = labels_of(spark, sf).filter("number BETWEEN 1 AND 5").select("call_id").distinct()
    read = calls.join(labels.withColumn("has", F.lit(1)), "call_id", "left").groupBy(
        "category").agg(F.count("*").alias("calls_read"), F.count("has").alias("labelled"))
    return found.join(read, "category").select("category", "source", "calls_read", "labelled", E.unsupported(
        F.col("source"), F.col("calls_read"), F.col("labelled")).alias("unsupported"))


_MONDAYS = "SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS d FROM call_log"
_SPAN = "span AS (SELECT min(day) AS s, max(day) + 1 AS e FROM call_log)"

def resolved_sql():
    inner = detect_sql("first_contact_resolution_rate", ("category",))
    return f"""
        SELECT category, CASE WHEN category LIKE '1%' THEN '1998-06-15' WHEN category LIKE '2%' THEN '1999-11-01'
                   WHEN score >= 2 THEN coalesce(near_date, day) END AS day,
               CASE WHEN category[1] IN ('1', '2') THEN 'argument' WHEN score >= 2 THEN 'detected' ELSE 'none' END AS source,
               CASE WHEN category LIKE '1%' THEN 'card outage' WHEN category LIKE '2%' THEN 'branch move'
                   WHEN score >= 2 THEN near_name END AS logged_change,
               CASE WHEN category[1] NOT IN ('1', '2') THEN round(score, 2) END AS score,
               CASE WHEN category[1] NOT IN ('1', '2') AND score >= 2 THEN direction END AS direction
        FROM (SELECT *, (SELECT strftime(date, '%Y-%m-%d') FROM {LOG_SQL}
                         WHERE abs(date_diff('day', CAST(day AS DATE), date)) <= 7
                         ORDER BY abs(date_diff('day', CAST(day AS DATE), date)), date LIMIT 1) AS near_date,
                     (SELECT name FROM {LOG_SQL} WHERE abs(date_diff('day', CAST(day AS DATE), date)) <= 7
                         ORDER BY abs(date_diff('day', CAST(day AS DATE), date)), date LIMIT 1) AS near_name
              FROM ({inner}) AS det) AS rows_in"""


_CITED = """cited AS (SELECT CAST(year(day) AS INT) AS answer, CASE WHEN seconds % 5 = 0 THEN call_id || 'X' ELSE call_id END AS call_id
        FROM call_log),
    wins AS (SELECT CAST(year(day) AS INT) AS answer, min(day) AS b, max(day) - 30 AS e FROM call_log GROUP BY 1),
    checked AS (SELECT c.answer, c.call_id, l.day IS NOT NULL AS "exists", coalesce(l.day >= b AND l.day < e, false) AS inside
        FROM cited c LEFT JOIN call_log l USING (call_id) LEFT JOIN wins w ON w.answer = c.answer)"""

def explain_sql():
    """The windows of the call volume over the categories that rose, or over all when none did."""
    plain_sql = window_values_sql("call_volume")
    picked = """(SELECT category FROM (SELECT category, count(*) FILTER (day < DATE '1998-06-15') AS b,
            count(*) FILTER (day >= DATE '1998-06-15') AS a FROM call_log
            WHERE day >= DATE '1998-05-04' AND day < DATE '1998-07-27' GROUP BY 1)
        WHERE a > b AND (a - b) / sqrt(a + b) >= 2 ORDER BY (a - b) / sqrt(a + b) DESC, category LIMIT 5)"""
    return plain_sql.replace("FROM call_log WHERE true", f"FROM call_log WHERE (category IN {picked} OR NOT EXISTS {picked})")


QUERIES = {
    **{f"change_weekly_{m}": (weekly(m), weekly_sql(m)) for m in C.METRICS},
    "change_weekly_by_segment": (weekly("first_contact_resolution_rate", ("category", "home_branch")),
                                 weekly_sql("first_contact_resolution_rate", ("category", "home_branch"))),
    "change_data_range": (data_range, check("""SELECT strftime(min(day), '%Y-%m-%d') AS data_start,
        strftime(max(day) + 1, '%Y-%m-%d') AS data_end FROM call_log""")),
    **{f"change_windows_{m}": (window_values(m), window_values_sql(m)) for m in C.METRICS},
    "change_after_weeks": (after_weeks, check("""SELECT strftime(CAST(date_trunc('week', day) AS DATE), '%Y-%m-%d') AS week,
        round(avg(CAST(resolved AS INT)), 6) AS value, count(*) AS n FROM call_log GROUP BY 1
        HAVING date_trunc('week', min(day)) + INTERVAL 7 DAY > DATE '1998-06-15'
           AND date_trunc('week', min(day)) < DATE '1998-07-27'""")),
    "change_risers": (riser_rows, check("""
        WITH counted AS (SELECT concat_ws('/', category, home_branch, CAST(resolved AS VARCHAR)) AS category,
                count(*) FILTER (day < DATE '1995-03-06') AS before_n, count(*) FILTER (day >= DATE '1995-03-06') AS after_n
            FROM call_log, (SELECT least(91, date_diff('day', min(day), DATE '1995-03-06')) AS len FROM call_log)
            WHERE day >= DATE '1995-03-06' - CAST(len AS INT) AND day < DATE '1995-03-06' + CAST(len AS INT) GROUP BY 1),
        scored AS (SELECT *, (after_n - before_n) / sqrt(after_n + before_n) AS score FROM counted WHERE after_n > before_n)
        SELECT category, before_n, after_n, round(score, 6) AS score,
            CAST(row_number() OVER (ORDER BY score DESC, category) AS INT) AS place FROM scored WHERE score >= 2
        QUALIFY place <= 5""")),
    "change_detect_volume": (detected("call_volume"), detect_sql("call_volume")),
    "change_detect_score": (detected("csat_average_score", ("category",)), detect_sql("csat_average_score", ("category",))),
    "change_detect_resolution": (detected("first_contact_resolution_rate", ("home_branch",)),
                                 detect_sql("first_contact_resolution_rate", ("home_branch",))),
    "change_detect_search_range": (
        detected("call_volume", ("category",), (date(1998, 1, 1), date(1999, 1, 1))),
        detect_sql("call_volume", ("category",), ("1998-01-01", "1999-01-01"))),
    "change_nearest_logged": (nearest, check(f"""
        WITH days AS (SELECT day, count(*) AS calls FROM call_log GROUP BY 1),
        near AS (SELECT day, date, name, row_number() OVER (PARTITION BY day
                    ORDER BY abs(date_diff('day', day, date)), date) AS r
                 FROM days JOIN {LOG_SQL} ON abs(date_diff('day', day, date)) <= 7)
        SELECT strftime(d.day, '%Y-%m-%d') AS day, calls, strftime(date, '%Y-%m-%d') AS logged_date, name AS logged_name
        FROM days d LEFT JOIN near n ON n.day = d.day AND r = 1""")),
    "change_logged_inside": (inside, check(f"""
        WITH ranges AS (SELECT category || '/' || year(day) AS id, min(day) AS s, max(day) + 1 AS e FROM call_log
                        GROUP BY category, year(day))
        SELECT id, count(date) AS entries, CASE WHEN count(date) = 1 THEN strftime(min(date), '%Y-%m-%d') END AS logged_date,
            CASE WHEN count(date) = 1 THEN min(name) END AS logged_name
        FROM ranges LEFT JOIN {LOG_SQL} ON date >= s AND date < e GROUP BY id""")),
    "change_resolve_points": (resolved, resolved_sql()),
    "change_fit_windows": (fitted, check(f"""
        WITH {_SPAN}, m AS (SELECT d, CAST(least(42, date_diff('day', s, d), date_diff('day', d, e)) AS INT) AS length
                            FROM ({_MONDAYS}), span)
        SELECT strftime(d, '%Y-%m-%d') AS day, length, strftime(d - length, '%Y-%m-%d') AS before_start,
            strftime(d + length, '%Y-%m-%d') AS after_end, length < 42 AS shortened, length >= 7 AS fits FROM m""")),
    "change_explain": (explain_windows, explain_sql()),
    "change_hash_sample": (
        lambda spark, sf: E.hash_sample(window_calls(spark, sf), "window").select("window", "call_id", "hash", "place"),
        check(f"WITH {_WINDOWED} SELECT win AS window, call_id, sha256(call_id) AS hash, CAST(place AS INT) AS place FROM sampled "
              "WHERE place <= 200")),
    "change_population": (
        lambda spark, sf: E.population(in_windows(spark, sf), "window", E.SAMPLE_CAP),
        check(f"WITH {_WINDOWED} SELECT win AS window, population, least(n, 200) AS read, population > 200 AS sampled FROM reads")),
    "change_fetched": (
        lambda spark, sf: E.population(in_windows(spark, sf), "window", None, calls_of(spark, sf).filter("seconds % 10 <> 3")),
        check(f"WITH {_WINDOWED} SELECT win AS window, count(*) AS population, count(*) FILTER (seconds % 10 <> 3) AS read, "
              "count(*) FILTER (seconds % 10 = 3) > 0 AS sampled FROM windowed GROUP BY 1")),
    "change_batches": (
        lambda spark, sf: E.batches(E.placed(window_calls(spark, sf), "window")).groupBy("window", "batch").agg(
            F.count("*").alias("n"), F.min("call_id").alias("lowest")),
        check(f"WITH {_WINDOWED} SELECT win AS window, CAST((place - 1) // 20 AS INT) AS batch, count(*) AS n, "
              "min(call_id) AS lowest FROM sampled GROUP BY 1, 2")),
    "change_assignments": (
        lambda spark, sf: E.valid_assignments(labels_of(spark, sf), window_calls(spark, sf), 5).select(
            "window", "call_id", "number", "quote"),
        check(f"WITH {_WINDOWED} SELECT win AS window, call_id, number, quote FROM marked WHERE number IS NOT NULL")),
    "change_driver_tally": (driver_tally, check(f"""WITH {_TALLY}
        SELECT number, before_n, after_n, round(before_scaled, 6) AS before_scaled, round(after_scaled, 6) AS after_scaled,
            CASE WHEN after_scaled > before_scaled THEN 'up' WHEN after_scaled < before_scaled THEN 'down' ELSE 'flat' END
            AS direction, citations FROM counted""")),
    "change_driver_calls": (driver_calls, check(f"""WITH {_TALLY}
        SELECT number, win AS window, call_id FROM marked WHERE number IN (SELECT number FROM counted)""")),
    "change_unassigned": (unassigned_rows, check(f"""WITH {_TALLY}
        SELECT win AS window, CAST(n - (SELECT coalesce(sum(CASE WHEN win = 'before' THEN before_n ELSE after_n END), 0)
            FROM counted) AS BIGINT) AS unassigned FROM reads""")),
    "change_verbatim_quotes": (quotes, """
        SELECT item_id, count(*) AS documents, min(doc_id) AS first_doc FROM (
            SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM benchmark) b
        JOIN (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) d ON contains(t, q)
        WHERE q <> '' GROUP BY 1"""),
    "change_verbatim_kept": (cited, r"""
        WITH cut AS (SELECT doc_id, text, substr(text, CAST(doc_id * 37 % 400 + 1 AS INT), CAST(doc_id * 13 % 420 AS INT)) AS c FROM documents),
        q AS (SELECT doc_id, text, CASE doc_id % 9 WHEN 0 THEN 'agent AGT-17 said ' || c WHEN 1 THEN c || ' of account 1234567890'
            WHEN 2 THEN '"' || c || '"' WHEN 3 THEN upper(c) ELSE c END AS c FROM cut),
        n AS (SELECT doc_id, trim(trim(regexp_replace(c, '\s+', ' ', 'g')), '"''“” ') AS c,
            trim(regexp_replace('agent AGT-17 said ' || text || ' of account 1234567890', '\s+', ' ', 'g')) AS t FROM q),
        k AS (SELECT doc_id, CASE WHEN length(c) BETWEEN 12 AND 300 AND NOT regexp_matches(c, '\b(?:AGT|MBR)-\d+\b')
            AND NOT regexp_matches(c, '(^|[^0-9$.,])(([0-9]{4}[ -])+|[0-9]+)[0-9]{4}($|[^0-9,.]|\\.($|[^0-9]))') AND contains(t, c) THEN c END AS c FROM n)
        SELECT doc_id, CAST(length(c) AS INT) AS chars, sha256(c) AS quote_sha256 FROM k""".replace("\\\\", "\\")),
    "change_coaching_patterns": (coaching, check("""
        WITH g AS (SELECT category || '/' || year(day) AS label, call_id, seconds % 7 AS number,
                CASE WHEN seconds % 2 = 0 THEN 1 END AS quoted, sha256(call_id) AS h FROM call_log),
        s AS (SELECT * FROM g),
        c AS (SELECT label, number, call_id, row_number() OVER (PARTITION BY label, number ORDER BY h) AS r FROM s
              WHERE quoted = 1),
        a AS (SELECT label, number, count(*) AS n FROM s WHERE number BETWEEN 1 AND 3 GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT a.label, a.number, a.n, (SELECT count(*) FROM s WHERE s.label = a.label) AS "of",
            coalesce((SELECT string_agg(call_id, ',' ORDER BY r) FROM c WHERE c.label = a.label AND c.number = a.number
                      AND r <= 3), '') AS cited FROM a""")),
    "change_grounded_citations": (grounding, check(f"WITH {_CITED} SELECT * FROM checked")),
    "change_grounded_answers": (grounded, check(f"""WITH {_CITED}
        SELECT y.answer, coalesce(cited, 0) AS cited, coalesce(real, 0) AS real,
            y.answer % 2 = 1 AND coalesce(cited, 0) = coalesce(real, 0) AND coalesce(real, 0) > 0 AS grounded
        FROM (SELECT DISTINCT CAST(year(day) AS INT) AS answer FROM call_log) y LEFT JOIN (
            SELECT answer, count(*) AS cited, count(*) FILTER (inside) AS real FROM checked GROUP BY 1) c USING (answer)""")),
    "change_recomputed": (recomputed, check("""
        SELECT category, count(DISTINCT date_trunc('week', day)) AS weeks, count(DISTINCT date_trunc('week', day)) AS same
        FROM call_log WHERE score IS NOT NULL GROUP BY 1""")),
    "change_event_truth": (truth, check(f"""
        WITH {_SPAN}, ev AS (SELECT name AS id, date AS p, CAST(least(42, date_diff('day', s, date), date_diff('day', date, e)) AS INT)
                AS len, CASE WHEN name LIKE '%card%' THEN '1-URGENT' END AS cat FROM {LOG_SQL}, span)
        SELECT id, count(*) FILTER (day < p) AS calls_before, count(*) FILTER (day >= p) AS calls_after,
            count(score) FILTER (day < p) AS responses_before, count(score) FILTER (day >= p) AS responses_after,
            round(avg(score) FILTER (day < p), 4) AS score_before, round(avg(score) FILTER (day >= p), 4) AS score_after
        FROM ev JOIN call_log ON day >= p - len AND day < p + len AND (cat IS NULL OR cat = category) GROUP BY 1""")),
    "change_unsupported": (unsupported_rows, f"""
        WITH src AS ({resolved_sql()}), lo AS ({check("SELECT category, seconds FROM call_log")})
        SELECT category, source, count(*) AS calls_read,
            count(*) FILTER (seconds % 7 BETWEEN 1 AND 5 OR (seconds + 1) % 7 BETWEEN 1 AND 5) AS labelled,
            source = 'detected' AND count(*) > 0
              AND count(*) FILTER (seconds % 7 BETWEEN 1 AND 5 OR (seconds + 1) % 7 BETWEEN 1 AND 5) = 0 AS unsupported
        FROM src JOIN lo USING (category) GROUP BY 1, 2"""),
}

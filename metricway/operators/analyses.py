"""Many change analyses at once: a table of questions in, tables of answers out, all keyed by the question's id.

Questions (`asked`): id, metric, categories and branches (ARRAY<STRING>, NULL or empty for all), argument (a date or NULL), start and end
(a search range or NULL), window_days. Calls are read once, into a cube by day and segment that also holds what each metric counts, how many
calls were fetched, and how many carry each label. A segment is looked up by the text of its filters, so questions meet the cube in joins
by equality, and no step handles one question after the other: its size is questions times days, whatever the number of calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricway.operators import change as C
from metricway.operators.evidence import MAX_CITATIONS
from metricway.session import written

ALL, SEP = "*", "\u0001"
FETCHED = "fetched"
KINDS = {m.name: m.kind for m in C.METRICS.values()}


def _scope(category: Column, branch: Column) -> Column:
    return F.concat_ws(SEP, category, branch)


def _named(column: str) -> Column:
    """The key of one value: NULL is a value of its own that no filter names."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("null"))


def _rolled(df: DataFrame) -> DataFrame:
    """Each row in the four scopes it belongs to: its category or all, its branch or all."""
    pairs = [(c, b) for c in (_named("category"), F.lit(ALL)) for b in (_named("home_branch"), F.lit(ALL))]
    return df.withColumn("scope", F.explode(F.array(*(_scope(c, b) for c, b in pairs)))).drop("category", "home_branch")


class CallCube:
    """What the analyses read: sums by scope, day and measure; label counts; the first quotes of each label."""

    def __init__(self, calls: DataFrame, fetched: DataFrame, labels: DataFrame, items: int):
        """calls: call_id, day, category, home_branch and what the metrics read. fetched: the call_ids whose text could be read.
        labels: call_id, seq, number, quote; the first number in 1..items of a call counts."""
        segment = ["day", "category", "home_branch"]
        good = labels.filter(F.col("number").between(1, items)).groupBy("call_id").agg(
            F.min_by(F.struct("number", "quote"), "seq").alias("label"))
        has = fetched.select("call_id").distinct().withColumn("has", F.lit(True))
        rows = calls.join(has, "call_id", "left").join(good, "call_id", "left").withColumn(
            "number", F.when(F.col("has"), F.col("label.number")))
        sums = []
        for m in C.METRICS.values():
            record = F.coalesce(F.expr(m.record), F.lit(False))
            sums.append(F.struct(F.lit(m.name).alias("measure"), F.count_if(record).alias("n"), F.coalesce(F.sum(
                F.when(record, F.expr(m.value).cast("double"))), F.lit(0.0)).alias("total")))
        sums.append(F.struct(F.lit(FETCHED).alias("measure"), F.count("has").alias("n"), F.lit(0.0).alias("total")))
        base = written(rows.groupBy(*segment, "number").agg(F.array(*sums).alias("sums")))
        long = base.select(*segment, "number", F.explode("sums").alias("s")).select(*segment, "number", "s.*")
        self.sums = written(_rolled(long.drop("number")).groupBy("scope", "day", "measure").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total")))
        self.labels = written(_rolled(long.filter((F.col("measure") == FETCHED) & F.col("number").isNotNull()).select(
            *segment, "number", "n")).groupBy("scope", "day", "number").agg(F.sum("n").alias("n")))
        quoted = rows.filter(F.col("number").isNotNull() & F.col("label.quote").isNotNull()).select(
            *segment, "number", "call_id", F.sha2("call_id", 256).alias("hash"), F.col("label.quote").alias("quote"))
        first = F.row_number().over(Window.partitionBy(*segment, "number").orderBy("hash", "call_id"))
        self.quotes = written(_rolled(quoted.withColumn("place", first).filter(F.col("place") <= MAX_CITATIONS).drop("place")))
        self.span = written(C.data_range(calls))
        self.rows = rows.select("call_id", *segment, "number")


def checked(asked: DataFrame) -> DataFrame:
    """asked with `kind` and `error`: all that is wrong with a question, or NULL."""
    low, high = C.WINDOW_DAYS_RANGE
    kind = F.lit(None).cast("string")
    for name, value in KINDS.items():
        kind = F.when(F.col("metric") == name, value).otherwise(kind)
    wrong = F.array_compact(F.array(
        F.when(kind.isNull(), F.lit("metric cannot be compared")),
        F.when(~F.coalesce(F.col("window_days").between(low, high), F.lit(False)), F.lit(f"window_days is not in {low}..{high}")),
        F.when(F.col("start").isNull() != F.col("end").isNull(), F.lit("a search range has two ends")),
        F.when(F.col("end") <= F.col("start"), F.lit("the search range ends before it starts"))))
    return asked.withColumn("kind", kind).withColumn("error", F.when(F.size(wrong) > 0, F.array_join(wrong, "; ")))


def _values(column: str) -> Column:
    """The keys of a filter's values, trimmed, once each; all for a filter that names none."""
    named = F.array_distinct(F.filter(F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.trim(x)),
                                        lambda x: x != ""))
    return F.when(F.size(named) > 0, F.transform(named, lambda x: F.concat(F.lit("="), x))).otherwise(F.array(F.lit(ALL)))


def scopes(asked: DataFrame) -> DataFrame:
    """id, scope: the segments that make up each question's filters."""
    laid = asked.select("id", F.explode(_values("categories")).alias("c"), _values("branches").alias("b"))
    return laid.select("id", "c", F.explode("b").alias("b")).select("id", _scope(F.col("c"), F.col("b")).alias("scope"))


def detected(cube: CallCube, asked: DataFrame, mine: DataFrame) -> DataFrame:
    """id, day, score, direction: the clearest shift of each question's own weeks inside its search range."""
    own = asked.filter(~F.col("metric").isin(*C.NEEDS_EXPLICIT_POINT)).select("id", "metric", "kind", "start", "end")
    weekly = mine.join(own, "id").join(cube.sums.withColumnRenamed("measure", "metric"), ["scope", "metric"]).groupBy(
        "id", C.monday(F.col("day")).alias("week")).agg(F.sum("n").cast("double").alias("n"), F.sum("total").alias("total"))
    spine = own.join(cube.span).select("*", F.explode(F.sequence(  # span is one row
        C.monday(F.col("data_start")), C.monday(F.date_sub("data_end", 1)), F.expr("INTERVAL 7 DAYS"))).alias("week"))
    filled = spine.join(weekly, ["id", "week"], "left").na.fill(0.0, ["n", "total"])
    at = Window.partitionBy("id").orderBy(F.unix_date("week"))  # one question's weeks
    before, after = at.rangeBetween(-7 * C.WEEKS_BEFORE, -7), at.rangeBetween(0, 7 * (C.WEEKS_AFTER - 1))
    day = F.col("week")

    def weeks(start: Column, end: Column) -> Column:
        return F.datediff(F.least(end, F.col("data_end")), F.greatest(start, F.col("data_start"))) / 7
    sides = filled.select(
        "id", "kind", day.alias("day"), "start", "end", "data_start", "data_end",
        F.sum("n").over(before).alias("n_b"), F.sum("total").over(before).alias("t_b"), F.sum("n").over(after).alias("n_a"),
        F.sum("total").over(after).alias("t_a"), weeks(F.date_sub(day, 7 * C.WEEKS_BEFORE), day).alias("w_b"),
        weeks(day, F.date_add(day, 7 * C.WEEKS_AFTER)).alias("w_a"))
    sides = sides.filter((F.col("day") >= F.coalesce("start", "data_start"))
                         & (F.col("day") < F.least(F.coalesce("end", "data_end"), F.col("data_end")))
                         & (F.col("n_b") >= C.MIN_RECORDS) & (F.col("n_a") >= C.MIN_RECORDS) & (F.col("w_b") > 0) & (F.col("w_a") > 0))
    v_b, v_a = F.col("t_b") / F.col("n_b"), F.col("t_a") / F.col("n_a")
    count = F.col("kind") == "count"
    rate_b = F.when(count, F.col("n_b") / F.col("w_b")).otherwise(v_b)
    rate_a = F.when(count, F.col("n_a") / F.col("w_a")).otherwise(v_a)
    args = (v_b, F.col("n_b"), F.col("w_b"), v_a, F.col("n_a"), F.col("w_a"))
    score = F.when(count, C.shift_score("count", *args)).when(F.col("kind") == "mean", C.shift_score("mean", *args)).otherwise(
        C.shift_score("ratio", *args))
    scored = sides.select("id", "day", score.alias("score"), C.direction(rate_a, rate_b).alias("direction")).filter(
        F.col("score") > C.TIE).withColumn("best", F.max("score").over(Window.partitionBy("id")))
    return scored.filter(F.col("score") >= F.col("best") - C.TIE).groupBy("id").agg(
        F.min_by(F.struct("day", "score", "direction"), "day").alias("top")).select("id", "top.*")


def _days(windows: DataFrame) -> DataFrame:
    """id, day, side: every day of both windows."""
    laid = windows.select("id", F.col("day").alias("point"), F.explode(F.sequence(
        "before_start", F.date_sub("after_end", 1))).alias("day"))
    return laid.select("id", "day", F.when(F.col("day") < F.col("point"), "before").otherwise("after").alias("side"))


def risen(cube: CallCube, days: DataFrame) -> DataFrame:
    """id, scope, place: the categories whose volume rose most, RISER_LIMIT at most, for questions without a filter."""
    volume = cube.sums.filter((F.col("measure") == "call_volume") & F.col("scope").startswith("=") & F.col("scope").endswith(SEP + ALL))
    counted = days.join(volume, "day").groupBy("id", "scope").agg(
        *(F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(s) for s in ("before", "after")))
    b, a = F.col("before"), F.col("after")
    scored = counted.filter(a > b).withColumn("score", (a - b) / F.sqrt(a + b)).filter(F.col("score") >= C.MIN_SCORE)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "scope"))
    return scored.withColumn("place", place).filter(F.col("place") <= C.RISER_LIMIT).select("id", "scope", "place")


def _per_side(name: str, value: Column) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("side") == s, value)), F.lit(0)).alias(f"{s}_{name}") for s in ("before", "after")]


def analysed(asked: DataFrame, cube: CallCube, log: DataFrame) -> dict[str, DataFrame]:
    """The answers: `analyses` (a row for each question), `drivers`, `citations`, `weeks` and `picked` (categories used).

    status: ok, or why there is no answer. limits: what the numbers do not cover.
    """
    asked = written(checked(asked))
    good = asked.filter("error IS NULL")
    mine = written(scopes(good))
    points = C.resolve_points(good.select("id", "argument", "start", "end"), detected(cube, good, mine), log, "id")
    length = F.least(F.col("window_days"), F.datediff("day", "data_start"), F.datediff("data_end", "day"))
    placed = good.join(points, "id").join(cube.span).withColumn("length", length)  # span is one row
    named = F.col("metric").isin(*C.NEEDS_EXPLICIT_POINT) & (F.col("source") != "argument")
    status = (F.when(named, "needs a change point").when(F.col("day").isNull(), "no change point")
              .when(F.col("length") < C.MIN_WINDOW_DAYS, "too near an end of the data").otherwise("ok"))
    placed = written(placed.select(
        "id", "metric", "kind", "day", "source", "logged_change", "score", "direction", "window_days", "length", status.alias("status"),
        F.date_sub("day", F.col("length")).alias("before_start"), F.date_add("day", F.col("length")).alias("after_end"),
        (_values("categories")[0] == ALL).alias("every_category"), (_values("branches")[0] == ALL).alias("every_branch")))
    windows = placed.filter("status = 'ok'")
    days = written(_days(windows))
    free = windows.filter("every_category AND every_branch").select("id")
    picked = written(risen(cube, days.join(free, "id")))
    scope = written(mine.join(picked.select("id").distinct(), "id", "left_anti").unionByName(picked.select("id", "scope")))
    seen = written(scope.join(days, "id"))  # questions x scopes x days of their windows
    both = seen.join(cube.sums, ["scope", "day"]).join(windows.select("id", "metric"), "id")
    own = F.col("measure") == F.col("metric")
    sums = both.groupBy("id").agg(
        *_per_side("n", F.when(own, F.col("n"))), *_per_side("total", F.when(own, F.col("total"))),
        *_per_side("calls", F.when(F.col("measure") == "call_volume", F.col("n"))),
        *_per_side("fetched", F.when(F.col("measure") == FETCHED, F.col("n"))))
    tallied = seen.join(cube.labels, ["scope", "day"]).groupBy("id", "number").agg(*_per_side("n", F.col("n"))).filter("after_n > 0")
    tallied = written(tallied)
    held = tallied.groupBy("id").agg(F.count("*").alias("drivers"), F.sum("before_n").alias("before_held"),
                                     F.sum("after_n").alias("after_held"))
    rows = placed.join(sums, "id", "left").join(held, "id", "left")
    ok = F.col("status") == "ok"

    def when_ok(column: Column) -> Column:
        return F.when(ok, column)

    def value(side: str) -> Column:
        n = F.coalesce(f"{side}_n", F.lit(0))
        return F.when(F.col("kind") == "count", n.cast("double")).otherwise(F.col(f"{side}_total") / F.nullif(n, F.lit(0)))
    fetched = F.coalesce(F.col("before_fetched") + F.col("after_fetched"), F.lit(0))
    weeks = F.col("length") / 7
    rate = {s: F.when(F.col("kind") == "count", value(s) / weeks).otherwise(value(s)) for s in ("before", "after")}
    moved = (rate["after"] - rate["before"]) * F.when(F.col("kind") == "ratio", 100).otherwise(1)
    share = F.when(F.col("kind") == "count", (rate["after"] - rate["before"]) / F.nullif(rate["before"], F.lit(0.0)))
    records = F.col("before_n") + F.col("after_n")
    calls = F.col("before_calls") + F.col("after_calls")
    limits = F.array_join(F.array_compact(F.array(
        F.when(F.col("length") < F.col("window_days"), F.lit("windows shortened")),
        F.when(fetched < calls, F.lit("fewer calls fetched than counted")),
        F.when(records < calls, F.lit("fewer records than calls")))), "; ")
    sides = [F.coalesce(f"{s}_{x}", F.lit(0)).cast("long") for x in ("n", "calls", "fetched") for s in ("before", "after")]
    names = [f"{s}_{x}" for x in ("n", "calls", "fetched") for s in ("before", "after")]
    left = [when_ok(F.coalesce(f"{s}_fetched", F.lit(0)) - F.coalesce(f"{s}_held", F.lit(0))).cast("long").alias(f"{s}_unassigned")
            for s in ("before", "after")]
    answers = rows.select(
        "id", "metric", "status", "day", "source", "logged_change", "score", "direction",
        *(when_ok(F.col(c)).alias(c) for c in ("length", "before_start", "after_end")),
        when_ok(value("before")).alias("before_value"), when_ok(value("after")).alias("after_value"),
        *(when_ok(c).alias(n) for c, n in zip(sides, names)), when_ok(moved).alias("change"), when_ok(share).alias("change_share"),
        *left, when_ok(F.coalesce("drivers", F.lit(0))).alias("drivers"),
        when_ok((F.col("source") == "detected") & (fetched > 0) & F.col("drivers").isNull()).alias("unsupported"),
        when_ok(limits).alias("limits"))
    refused = asked.filter("error IS NOT NULL").select("id", "metric", F.col("error").alias("status"))
    scale = {s: F.col(f"{s}_calls") / F.nullif(F.col(f"{s}_fetched"), F.lit(0)) for s in ("before", "after")}
    scaled = {s: F.coalesce(F.col(f"{s}_n") * scale[s], F.lit(0.0)) for s in ("before", "after")}
    drivers = tallied.join(sums.drop("before_n", "after_n"), "id").select(
        "id", "number", "before_n", "after_n", *(scaled[s].alias(f"{s}_scaled") for s in scaled),
        F.when(scaled["after"] > scaled["before"], "up").when(scaled["after"] < scaled["before"], "down").otherwise("flat").alias(
            "direction"))
    best = Window.partitionBy("id", "number").orderBy("hash", "call_id")
    citations = seen.filter("side = 'after'").join(cube.quotes, ["scope", "day"]).withColumn("place", F.row_number().over(best)).filter(
        F.col("place") <= MAX_CITATIONS).select("id", "number", "place", "call_id", "quote")
    return {"analyses": answers.unionByName(refused, allowMissingColumns=True), "drivers": drivers, "citations": citations,
            "weeks": _weeks(cube, windows, scope), "picked": picked, "scopes": scope, "days": days}


def _weeks(cube: CallCube, windows: DataFrame, scope: DataFrame) -> DataFrame:
    """id, week, value, n: the whole weeks that overlap the after window."""
    laid = windows.select("id", "metric", "kind", F.explode(F.sequence(
        C.monday(F.col("day")), C.monday(F.date_sub("after_end", 1)), F.expr("INTERVAL 7 DAYS"))).alias("week"))
    laid = laid.join(scope, "id").select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("d"))
    rows = laid.withColumn("day", F.date_add("week", F.col("d"))).withColumnRenamed("metric", "measure").join(
        cube.sums, ["scope", "day", "measure"])
    sums = rows.groupBy("id", "kind", "week").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n > 0")
    return sums.select("id", "week", F.when(F.col("kind") == "count", F.col("n").cast("double")).otherwise(
        F.col("total") / F.col("n")).alias("value"), "n")


def driver_calls(answers: dict[str, DataFrame], cube: CallCube) -> DataFrame:
    """id, number, side, call_id: the calls behind each driver as rows."""
    mine = answers["scopes"].join(answers["days"], "id")
    rows = _rolled(cube.rows.filter(F.col("number").isNotNull()))
    return mine.join(rows, ["scope", "day"]).join(answers["drivers"].select("id", "number"), ["id", "number"]).select(
        "id", "number", "side", "call_id")

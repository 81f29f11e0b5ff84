"""Scores over ranked lists and evaluation runs."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricway.session import written

# Query types, matching thresholds, name pattern of a run's file.
QUERY_TYPES = ("topical", "filter", "exact", "paraphrase")
MATCH_RECALL, MATCH_PRECISION = 0.5, 0.6
MIN_PLANTED = 5
SHARE_POINTS = 0.10
DETECTED_DAYS = 4
EQUAL_BELOW = 0.005
RUN_FILE = r"^(\d{4}-\d{2}-\d{2}T\d{6}Z)_(.+)_([0-9a-f]{7})(?:-\d+)?\.json$"
PROBES, RANGE_VALUES = 24, 5000  # cuts of a round; distinct values that a task may list


# ── ranked lists ──────────────────────────────────────────────────────────────

def retrieval_scores(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10), k: int = 10,
                     query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """query, recall@k (over min(k, relevant)) and mrr@k, for every query that has relevant rows.

    Relevance stays in rows; only hits that are relevant reach the grouping.
    """
    rel = relevant.select(query, doc).distinct()
    sizes = rel.groupBy(query).agg(F.count("*").alias("relevant"))
    found = hits.select(query, doc, "rank").join(rel, [query, doc]).groupBy(query).agg(
        *(F.count_if(F.col("rank") <= n).alias(f"_in_{n}") for n in ks),
        F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("_first"))
    return sizes.join(found, query, "left").select(
        query, "relevant",
        *((F.coalesce(f"_in_{n}", F.lit(0)) / F.least(F.lit(n), "relevant")).alias(f"recall_{n}") for n in ks),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias(f"mrr_{k}"))


def without_relevant(queries: DataFrame, relevant: DataFrame, query: str = "query_id") -> DataFrame:
    """Queries whose relevant set is empty: an error in a labels file."""
    return queries.select(query).join(relevant.select(query), query, "left_anti")


def macro_means(scores: DataFrame, kind: str, values: list[str]) -> DataFrame:
    """Mean of each score over all queries ("all") and per kind, with the number of queries."""
    both = scores.withColumn("group", F.explode(F.array(F.lit("all"), F.col(kind))))
    return both.groupBy("group").agg(F.count("*").alias("queries"), *(F.avg(v).alias(v) for v in values))


def percentiles(df: DataFrame, value: str, qs: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact percentiles, linear between order statistics, for all groups at once.

    Equal values are counted first. Each rank looked for lies in a range of distinct values; rounds cut every open range at
    approximate quantiles of its own values and count what lies below the cuts, until no range holds more than RANGE_VALUES
    values. Counts are added up in the tasks, so a group of a third of all rows is no more work for one task than another, and there are as
    many rounds as the data need: each leaves about 1/PROBES of a range.
    """
    names = [f"p{q:g}".replace(".", "_") for q in qs]
    keys = [f"_k{i}" for i in range(len(by))]
    kept = [F.col(c).alias(k) for c, k in zip(by, keys)]
    counts = written(df.filter(F.col(value).isNotNull()).groupBy(*kept, F.col(value).cast("double").alias("v")).agg(
        F.count("*").alias("n")))
    totals = written(counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("values")))
    spots = []
    for name, q in zip(names, qs):
        spot = (F.col("total") - 1) * q / 100
        for side, rank in (("low", F.floor(spot)), ("high", F.least(F.floor(spot) + 1, F.col("total") - 1))):
            spots.append(F.struct(F.lit(f"{name}_{side}").alias("target"), rank.alias("rank")))
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    ranges = totals.select(*keys, "values", low.alias("low"), high.alias("high"), F.explode(F.array(*spots)).alias("s")).select(
        *keys, "values", "low", "high", "s.target", "s.rank")
    probes = [i / PROBES for i in range(1, PROBES)]

    def same(a: str, b: str, *more: str) -> Column:
        return reduce(and_, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in [*keys, *more]), F.lit(True))

    def inside(parts: DataFrame) -> DataFrame:
        """The counts of each distinct range; low is outside, but for the lowest range of all."""
        within = ((F.col("c.v") > F.col("r.low")) | (F.col("r.low") == low)) & (F.col("c.v") <= F.col("r.high"))
        return counts.alias("c").join(parts.alias("r"), same("c", "r") & within).select(
            *(F.col(f"c.{k}") for k in keys), "r.low", "r.high", "c.v", "c.n")

    done = None
    while True:
        open_ = ranges.filter(F.col("values") > RANGE_VALUES)
        if open_.isEmpty():
            break
        closed = ranges.filter(F.col("values") <= RANGE_VALUES)
        done = closed if done is None else done.unionByName(closed)
        mine = inside(open_.select(*keys, "low", "high").distinct())
        cuts = mine.groupBy(*keys, "low", "high").agg(F.percentile_approx("v", probes, 20 * PROBES).alias("cuts"))
        cell = F.size(F.filter("x.cuts", lambda c: c < F.col("m.v")))
        cells = mine.alias("m").join(cuts.alias("x"), same("m", "x", "low", "high")).groupBy(
            *(F.col(f"m.{k}") for k in keys), "m.low", "m.high", cell.alias("cell")).agg(
                F.sum("m.n").alias("n"), F.count("*").alias("values"), F.max("m.v").alias("last"))
        upto = Window.partitionBy(*keys, "low", "high").orderBy("cell")  # PROBES rows
        cells = cells.withColumns({"ahead": F.coalesce(F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                                   "from": F.coalesce(F.lag("last").over(upto), F.col("low"))})
        held = (F.col("o.rank") >= F.col("c.ahead")) & (F.col("o.rank") < F.col("c.ahead") + F.col("c.n"))
        ranges = written(open_.alias("o").join(cells.alias("c"), same("o", "c", "low", "high") & held).select(
            *(F.col(f"o.{k}") for k in keys), "c.values", F.col("c.from").alias("low"), F.col("c.last").alias("high"), "o.target",
            (F.col("o.rank") - F.col("c.ahead")).alias("rank")))
    ranges = ranges if done is None else done.unionByName(ranges)
    lists = inside(ranges.select(*keys, "low", "high").distinct()).groupBy(*keys, "low", "high").agg(
        F.array_sort(F.collect_list(F.struct("v", "n"))).alias("list"))  # RANGE_VALUES at most
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
    found = ranges.alias("o").join(lists.alias("l"), same("o", "l", "low", "high")).select(
        *(F.col(f"o.{k}") for k in keys), "o.target", F.aggregate("l.list", start, lambda a, x: F.struct(
            (a["seen"] + x["n"]).alias("seen"), F.when(a["v"].isNotNull() | (a["seen"] + x["n"] <= F.col("o.rank")), a["v"]).otherwise(
                x["v"]).alias("v")))["v"].alias("v"))
    sides = found.groupBy(*keys).agg(*(F.max(F.when(F.col("target") == f"{n}_{s}", F.col("v"))).alias(f"{n}_{s}")
                                       for n in names for s in ("low", "high")))
    out = []
    for name, q in zip(names, qs):
        spot = (F.col("t.total") - 1) * q / 100
        out.append((F.col(f"s.{name}_low") + (F.col(f"s.{name}_high") - F.col(f"s.{name}_low")) * (spot - F.floor(spot))).alias(name))
    joined = sides.alias("s").join(totals.alias("t"), same("s", "t"))
    result = joined.select(*(F.col(f"s.{k}").alias(c) for k, c in zip(keys, by)), *out)
    if by:
        return result
    empty = df.sparkSession.range(1).select(F.lit(1).alias("_one"))  # one row, also for no values
    return empty.join(result.withColumn("_one", F.lit(1)), "_one", "left").select(*names)


# ── evaluation runs (rows: item, group, key, score BOOLEAN or DOUBLE, comment) ───

def pass_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """group, n, tool_errors and a rate per check; a score that does not apply is left out."""
    both = rows.withColumn("group", F.explode(F.array(F.lit("all"), F.col("group"))))
    rate = [F.round(F.avg(F.when(F.col("key") == k, F.col("score").cast("double"))), 3).alias(k) for k in keys]
    items = both.groupBy("group", "item").agg(F.max(F.col("tool_error").cast("int")).alias("failed"))
    sizes = items.groupBy("group").agg(F.count("*").alias("n"), F.sum("failed").alias("tool_errors"))
    return sizes.join(both.groupBy("group").agg(*rate), "group")


def failures(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("score").cast("double") == 0).select("item", "key", "comment")


def gate(found: DataFrame, known: DataFrame) -> DataFrame:
    """item, key, problem: failures nobody knows of, and known ones that now pass."""
    new = found.join(known, ["item", "key"], "left_anti").select("item", "key", F.lit("new failure").alias("problem"))
    gone = known.join(found, ["item", "key"], "left_anti").select("item", "key", F.lit("now passes").alias("problem"))
    return new.unionByName(gone)


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """group, key, before, after, delta of two long frames (group, key, value); "=" below 0.005."""
    rows = a.select("group", "key", F.col("value").alias("before")).join(
        b.select("group", "key", F.col("value").alias("after")), ["group", "key"], "full_outer")
    gap = F.col("after") - F.col("before")
    shown = F.when(gap.isNull(), "").when(F.abs(gap) < EQUAL_BELOW, "=").otherwise(F.format_string("%+.2f", gap))
    return rows.select("group", "key", "before", "after", shown.alias("delta"))


# What a difference of setups makes incomparable.
AFFECTED = {"judge model": "judge", "judge prompt": "judge", "golden set": "every check", "limit": "every check",
            "groups": "the 'all' group"}


def setup_warnings(a: dict, b: dict, allow_datasets: bool = False) -> list[str]:
    """Differences between what two runs ran; two question sets have no before and after."""
    if a.get("dataset", "golden") != b.get("dataset", "golden") and not allow_datasets:
        raise ValueError("the runs scored different question sets")
    return [f"{name} differs ({a.get(name)} -> {b.get(name)}): "
            + (f"{AFFECTED[name]} is not comparable" if name in AFFECTED else "the delta measures this change")
            for name in dict.fromkeys([*a, *b]) if a.get(name) != b.get(name)]


def run_files(names: DataFrame, column: str = "name") -> DataFrame:
    """name, at, run: the files that are runs."""
    at = F.regexp_extract(column, RUN_FILE, 1)
    return names.filter(F.col(column).rlike(RUN_FILE)).select(
        F.col(column).alias("name"), at.alias("at"), F.regexp_extract(column, RUN_FILE, 2).alias("run"))


def newest_of_runs(files: DataFrame, keep: int = 2) -> DataFrame:
    """The newest files of each run name, with their place from 0; each task keeps `keep` a run."""
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("at"), F.desc("name")))
    return files.withColumn("run_place", place).filter(F.col("run_place") <= keep).withColumn("run_place", F.col("run_place") - 1)


def latest(files: DataFrame, back: int = 0) -> DataFrame:
    """The newest run's file, or the one `back` places before it."""
    return files.orderBy(F.desc("at"), F.desc("name")).limit(back + 1).orderBy("at", "name").limit(1)


def ambiguous_runs(files: DataFrame) -> DataFrame:
    """Runs whose two newest files fall in the same minute: their name alone picks neither."""
    newest = newest_of_runs(files, 2).groupBy("run").agg(
        F.count("*").alias("n"), F.count_distinct(F.substring("at", 1, 15)).alias("minutes"))
    return newest.filter("n = 2 AND minutes = 1").select("run")


# ── matching planted and reported groups ──────────────────────────────────────

def match_groups(planted: DataFrame, reported: DataFrame) -> DataFrame:
    """planted, reported, recall, precision: the first reported group that holds at least half of
    a planted group's calls at 60% precision; NULL when none does.

    Both sides are rows (planted, call_id) and (reported, call_id), joined on the call.
    """
    p_size = planted.groupBy("planted").agg(F.count("*").alias("p"))
    r_size = reported.groupBy("reported").agg(F.count("*").alias("r"))
    hits = planted.join(reported, "call_id").groupBy("planted", "reported").agg(F.count("*").alias("hit"))
    rated = hits.join(p_size, "planted").join(r_size, "reported").select(
        "planted", "reported", (F.col("hit") / F.col("p")).alias("recall"), (F.col("hit") / F.col("r")).alias("precision"))
    good = rated.filter((F.col("recall") >= MATCH_RECALL) & (F.col("precision") >= MATCH_PRECISION))
    first = good.groupBy("planted").agg(F.min_by(F.struct("reported", "recall", "precision"), "reported").alias("m"))
    return p_size.join(first, "planted", "left").select("planted", F.col("p").alias("size"), "m.reported", "m.recall", "m.precision")


def group_recall(matches: DataFrame, min_size: int = MIN_PLANTED) -> DataFrame:
    """One row: planted groups large enough, how many were found, and whether all were."""
    big = matches.filter(F.col("size") >= min_size)
    return big.agg(F.count("*").alias("planted"), F.count("reported").alias("found")).withColumn(
        "passed", (F.col("planted") > 0) & (F.col("planted") == F.col("found")))


def group_shares(matches: DataFrame, reported: DataFrame, read: DataFrame, min_size: int = MIN_PLANTED) -> DataFrame:
    """planted, got, want, close: a found group's share of the calls read, within ten points."""
    total = read.agg(F.count("*").alias("n")).select("n").scalar()
    sizes = reported.groupBy("reported").agg(F.count("*").alias("r"))
    return matches.filter((F.col("size") >= min_size) & F.col("reported").isNotNull()).join(sizes, "reported").select(
        "planted", (F.col("r") / total).alias("got"), (F.col("size") / total).alias("want")).withColumn(
            "close", F.abs(F.col("got") - F.col("want")) <= SHARE_POINTS)


# ── checks of single answers ──────────────────────────────────────────────────

def same_set(a: str, b: str) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def answer_checks(answers: DataFrame, corpus: DataFrame) -> DataFrame:
    """item, key, score: route, interrupt, metric, sql, citations, call_id; NULL where a check
    does not apply.

    `answers` has item, expected_route, route, expected_interrupts, interrupts, expected_metrics, metrics, expect_sql,
    sql, answer, citations, expect_citations, call_id. Cited ids meet the corpus in a join.
    """
    ids = F.array_distinct(F.array_union("citations", F.regexp_extract_all("answer", F.lit(r"CALL-\d+"), F.lit(0))))
    known = corpus.select("call_id").withColumn("_real", F.lit(1))
    named = answers.select("item", F.explode(ids).alias("call_id")).join(known, "call_id", "left").groupBy("item").agg(
        F.count_if(F.col("_real").isNull()).alias("_invented"))
    wanted = answers.join(known, "call_id", "left").join(named, "item", "left")
    text = F.coalesce("answer", F.lit(""))
    cited = F.size("citations") > 0
    metric_route = F.col("expected_route") == "resolve_metric"
    checks = {
        "route": F.col("route") == F.col("expected_route"),
        "interrupt": same_set("interrupts", "expected_interrupts"),
        "metric": F.when(F.size("expected_metrics") > 0, same_set("metrics", "expected_metrics")),
        "sql": F.when(F.col("expect_sql"), F.coalesce(
            F.col("sql").rlike(r"(?i)\bselect\b") & text.contains(F.col("sql")), F.lit(False))),
        "citations": F.when(metric_route, None).when(~F.col("expect_citations"), ~cited).otherwise(
            cited & (F.coalesce("_invented", F.lit(0)) == 0)),
        "call_id": F.when(F.col("call_id").isNotNull(), F.when(
            F.col("_real").isNotNull(), F.array_contains("citations", F.col("call_id"))).otherwise(
                text.contains(F.col("call_id")) & ~cited)),
    }
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("score")) for k, v in checks.items()))
    return wanted.select("item", F.inline(entries))


def point_check(expected: Column, how: Column, got: Column, source: Column) -> Column:
    """A stated or logged point is exact; a detected one may be four days off."""
    near = (source == "detected") & (F.abs(F.datediff(got, expected)) <= DETECTED_DAYS)
    exact = (source == "argument") & (got == expected)
    return F.coalesce(F.when(how == "detected", near).otherwise(exact), F.lit(False))


def values_check(answer: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """keys, same: value equal at two decimals and n equal, NULLs alike."""
    both = answer.select(*keys, F.round("value", 2).alias("v"), F.col("n").alias("m")).join(
        truth.select(*keys, F.round("value", 2).alias("tv"), F.col("n").alias("tm")), keys, "left")
    return both.select(*keys, (F.col("v").eqNullSafe(F.col("tv")) & (F.col("m") == F.coalesce("tm", F.lit(0)))).alias("same"))


def names_agent(*texts: Column) -> Column:
    return reduce(or_, (F.coalesce(t, F.lit("")).rlike(r"\bAGT-\d+\b") for t in texts))

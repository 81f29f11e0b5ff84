"""What the calls say about a change: samples, assignments, tallies, quotes, grounding.

Labels come from outside (a model or a rule) as rows (call_id, number, quote, seq); everything
that is counted is counted here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricway.functions.text import mask_accounts, squeeze
from metricway.operators.assign import rank_by_hash

# Sample and batch sizes, quote lengths, citation limits, id pattern.
SAMPLE_CAP = 200
BATCH = 20
MIN_QUOTE, MAX_QUOTE = 12, 300
MAX_CITATIONS = 3
MIN_PATTERN_CALLS = 2
STAFF_OR_MEMBER_ID = r"\b(?:AGT|MBR)-\d+\b"
AGENT_ID = r"\bAGT-\d+\b"
QUOTE_EDGES = "\"'“” "


def hash_sample(calls: DataFrame, by: str | None = None, cap: int = SAMPLE_CAP) -> DataFrame:
    """The `cap` calls with the lowest SHA-256 of their id (per `by`), with their place.

    Each task keeps only its own lowest `cap` rows before the shuffle.
    """
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(1))).orderBy("hash", "call_id")
    return calls.withColumn("hash", F.sha2(F.col("call_id"), 256)).withColumn(
        "place", F.row_number().over(w)).filter(F.col("place") <= cap)


def population(calls: DataFrame, by: str, cap: int | None = None, fetched: DataFrame | None = None) -> DataFrame:
    """by, population, read, sampled: how much of a window is read: all of it, unless `cap` says fewer or fewer were fetched (call_id)."""
    if fetched is not None:
        calls = calls.join(fetched.select("call_id").distinct().withColumn("_has", F.lit(1)), "call_id", "left")
    had = F.count("_has") if fetched is not None else F.count("*")
    rows = calls.groupBy(by).agg(F.count("*").alias("population"), had.alias("_had"))
    read = F.least("_had", F.lit(cap)) if cap else F.col("_had")
    return rows.select(by, "population", read.alias("read"), (F.col("population") > read).alias("sampled"))


def placed(calls: DataFrame, by: str) -> DataFrame:
    """All calls with `hash` and their place by it in each window; a window is ranked in pieces by the first digits of the hash."""
    return rank_by_hash(calls.withColumn("hash", F.sha2(F.col("call_id"), 256)), [by], "hash", "call_id")


def batches(sample: DataFrame, size: int = BATCH) -> DataFrame:
    """Adds the batch each sampled call is read in."""
    return sample.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int"))


def verbatim(quote: Column, text: Column) -> Column:
    """The cleaned quote when it may be cited and stands in the text, else NULL."""
    clean = F.regexp_replace(squeeze(quote), f"^[{QUOTE_EDGES}]+|[{QUOTE_EDGES}]+$", "")
    return F.when(
        F.length(clean).between(MIN_QUOTE, MAX_QUOTE) & ~clean.rlike(STAFF_OR_MEMBER_ID)
        & (mask_accounts(clean) == clean) & squeeze(text).contains(clean), clean)


def valid_assignments(assigned: DataFrame, sample: DataFrame, items: int) -> DataFrame:
    """One row per sampled call that has an item: the first in-range row of each call, in order
    of `seq`. A call outside the sample, or with a number outside 1..items, stays unassigned."""
    good = assigned.filter(F.col("number").between(1, items))
    first = good.groupBy("call_id").agg(F.min_by(F.struct("number", "quote"), "seq").alias("a"))
    return sample.join(first, "call_id").select(*sample.columns, "a.number", "a.quote")


def tally(assigned: DataFrame, windows_read: DataFrame) -> DataFrame:
    """One row per item seen after the change: counts, what they come to in the population, and the first citations.

    `assigned` has window (before/after), call_id, number, quote (already verified); `windows_read` has window, population, read. The
    calls themselves are rows of `assigned`; no row lists them.
    """
    def n(window: str) -> Column:
        return F.count_if(F.col("window") == window)

    per_item = assigned.groupBy("number").agg(n("before").alias("before_n"), n("after").alias("after_n")).filter("after_n > 0")
    best = Window.partitionBy("number").orderBy("hash", "call_id")
    quoted = assigned.filter((F.col("window") == "after") & F.col("quote").isNotNull()).withColumn("hash", F.sha2("call_id", 256))
    cited = quoted.withColumn("best", F.row_number().over(best)).filter(F.col("best") <= MAX_CITATIONS).groupBy("number").agg(
        F.array_sort(F.collect_list(F.struct("best", "call_id", "quote"))).alias("citations"))
    none = F.array().cast(dict(cited.dtypes)["citations"])
    scale = {w: windows_read.filter(F.col("window") == w).select(
        (F.col("population") / F.nullif(F.col("read"), F.lit(0))).alias("s")).scalar() for w in ("before", "after")}
    before = F.col("before_n") * F.coalesce(scale["before"], F.lit(0.0))
    after = F.col("after_n") * F.coalesce(scale["after"], F.lit(0.0))
    return per_item.join(cited, "number", "left").select(
        "number", "before_n", "after_n", before.alias("before_scaled"), after.alias("after_scaled"),
        F.when(after > before, "up").when(after < before, "down").otherwise("flat").alias("direction"),
        F.coalesce("citations", none).alias("citations")).orderBy(F.desc("after_n"), "number")


def item_calls(assigned: DataFrame, tallied: DataFrame) -> DataFrame:
    """number, window, call_id: the calls behind each reported item, as rows."""
    return assigned.join(tallied.select("number"), "number", "left_semi").select("number", "window", "call_id")


def unassigned(tallied: DataFrame, windows_read: DataFrame) -> DataFrame:
    """window, unassigned: calls read that no reported item holds."""
    held = tallied.agg(F.coalesce(F.sum("before_n"), F.lit(0)).alias("before"),
                       F.coalesce(F.sum("after_n"), F.lit(0)).alias("after"))
    return windows_read.select("window", (F.col("read") - F.when(
        F.col("window") == "before", held.select("before").scalar()).otherwise(
            held.select("after").scalar())).alias("unassigned"))


def unsupported(source: Column, calls_read: Column, items: Column) -> Column:
    """A shift found by detection alone, with calls read and no reason among them."""
    return (source == "detected") & (calls_read > 0) & (items == 0)


def patterns(groups: DataFrame, assigned: DataFrame, cap: int | None = None) -> DataFrame:
    """Items shared by two or more calls of a group: n of the calls read, which are all unless `cap` says fewer.

    `groups` has label, call_id; `assigned` has call_id, number, quote. Citations are those of the lowest hashes,
    picked by rank, so that no list holds more than MAX_CITATIONS.
    """
    members = groups.dropDuplicates(["label", "call_id"])
    read = hash_sample(members, by="label", cap=cap) if cap else members.withColumn("hash", F.sha2(F.col("call_id"), 256))
    of = read.groupBy("label").agg(F.count("*").alias("of"))
    shared = read.join(assigned.select("call_id", "number", "quote"), "call_id")
    found = shared.groupBy("label", "number").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_PATTERN_CALLS)
    best = Window.partitionBy("label", "number").orderBy("hash", "call_id")
    cited = shared.filter(F.col("quote").isNotNull()).withColumn("best", F.row_number().over(best)).filter(
        F.col("best") <= MAX_CITATIONS)
    cited = cited.groupBy("label", "number").agg(F.array_sort(F.collect_list(F.struct("hash", "call_id", "quote"))).alias(
        "citations"))
    none = F.array().cast(dict(cited.dtypes)["citations"])
    return found.join(cited, ["label", "number"], "left").withColumn("citations", F.coalesce("citations", none)).join(
        of, "label").filter(F.col("of") >= 2).orderBy(F.desc("n"), "label", "number")



def grounded_citations(citations: DataFrame, calls: DataFrame, windows: DataFrame) -> DataFrame:
    """Each citation (answer, call_id): does the call exist, and does its day lie in the windows
    its answer states ([before_start, after_end))?"""
    known = calls.select("call_id", "day")
    return citations.join(known, "call_id", "left").join(windows, "answer", "left").select(
        "answer", "call_id", F.col("day").isNotNull().alias("exists"),
        F.coalesce((F.col("day") >= F.col("before_start")) & (F.col("day") < F.col("after_end")),
                   F.lit(False)).alias("inside"))


def grounded_answers(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """answer, grounded: an answer stands when it carries SQL, names no agent, and all of its
    citations are calls inside its windows (at least one when it claims a change point)."""
    cited = checked.groupBy("answer").agg(
        F.count("*").alias("cited"), F.count_if("inside").alias("real"))
    rows = answers.join(cited, "answer", "left")
    n, real = F.coalesce("cited", F.lit(0)), F.coalesce("real", F.lit(0))
    return rows.select(
        "answer", n.alias("cited"), real.alias("real"),
        ((F.length(F.coalesce("sql", F.lit(""))) > 0) & ~F.coalesce("shown", F.lit("")).rlike(AGENT_ID)
         & (n == real) & ((real > 0) | ~F.col("claims_point"))).alias("grounded"))


# ── answer keys ───────────────────────────────────────────────────────────────

def event_truth(events: DataFrame, calls: DataFrame, window_days: int, span: DataFrame) -> DataFrame:
    """Per event (id, day, category or NULL): both windows' volume, mean score and responses.

    An event reaches 2*window_days+... days at most, so it is laid out by day and joined by
    equality to calls already summed by day and category.
    """
    from metricway.operators.change import fit_windows

    daily = calls.groupBy("day", "category").agg(
        F.count("*").alias("calls"), F.count("score").alias("responses"), F.sum("score").alias("score_sum"))
    windows = fit_windows(events, span, window_days)
    days = windows.select("id", F.col("category").alias("only"), F.col("day").alias("point"), F.explode(
        F.sequence("before_start", F.date_sub("after_end", 1))).alias("day"))
    joined = days.join(daily, "day").filter(F.col("only").isNull() | (F.col("only") == F.col("category")))
    after = F.col("day") >= F.col("point")

    def both(name: str) -> list[Column]:
        return [F.coalesce(F.sum(F.when(~after, F.col(name))), F.lit(0)).alias(f"{name}_before"),
                F.coalesce(F.sum(F.when(after, F.col(name))), F.lit(0)).alias(f"{name}_after")]

    sums = joined.groupBy("id").agg(*both("calls"), *both("responses"), *both("score_sum"))
    return sums.select(
        "id", "calls_before", "calls_after", "responses_before", "responses_after",
        *(F.round(F.col(f"score_sum_{s}") / F.nullif(F.col(f"responses_{s}"), F.lit(0)), 4).alias(f"score_{s}")
          for s in ("before", "after")))

"""Deterministic assignment: ranks and buckets by hash, quotas, renumbering, phases, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricway.session import cut_lineage

PREFIX = 3  # hex digits: 4096 buckets a group


def sha_unit(text: Column) -> Column:
    """A number in [0, 1) from the SHA-256 of a text: 13 hex digits stay exact in a double."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)


def hash_bucket(text: Column, shares: dict[str, float]) -> Column:
    """The name whose share of [0, 1) holds the text's number; the last name takes the rest."""
    unit, total, names = sha_unit(text), 0.0, list(shares)
    out = F.lit(None).cast("string")
    steps = []
    for name in names:
        total += shares[name]
        steps.append((total, name))
    out = F.lit(names[-1])
    for edge, name in reversed(steps):
        out = F.when(unit < edge, name).otherwise(out)
    return out


def rank_by_hash(df: DataFrame, by: list[str], hashed: str, tie: str, name: str = "place") -> DataFrame:
    """Adds the place of each row in its group by hash, 1 first.

    A group is cut by the first digits of the hash: the buckets' counts give each bucket's
    offset and only a bucket is sorted at a time, so a group of a third of all rows is spread
    over thousands of tasks.
    """
    cut = df.withColumn("_bucket", F.substring(hashed, 1, PREFIX))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")).select(
        *by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(hashed, tie)
    return cut.join(offsets, [*by, "_bucket"]).withColumn(
        name, F.col("_offset") + F.row_number().over(inside)).drop("_bucket", "_offset")


def largest_remainder(groups: DataFrame, key: str, weight: str, total: Column, by: list[str] | None = None) -> DataFrame:
    """Adds quota: whole numbers in proportion to `weight` that sum to `total`; ties by key.

    Exact: shares are kept as whole-number quotients and remainders. One row a group.
    """
    by = by or []
    w = F.col(weight).cast("decimal(38,0)")
    every = Window.partitionBy(*by)
    sums = groups.withColumn("_all", F.sum(w).over(every)).withColumn("_want", total.cast("decimal(38,0)"))
    share = F.col("_want") * w
    parts = sums.withColumn("_floor", F.floor(share / F.col("_all")).cast("long")).withColumn(
        "_rest", (share - F.col("_floor").cast("decimal(38,0)") * F.col("_all")))
    left = F.col("_want") - F.sum("_floor").over(every)
    order = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_rest"), key))
    return parts.withColumn("quota", F.col("_floor") + F.when(order <= left, 1).otherwise(0)).drop(
        "_all", "_want", "_floor", "_rest")


def renumber(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense numbers 1..n in the given total order.

    Rows are range-partitioned and sorted, then pinned by a checkpoint, so the partition sizes
    counted in one pass are the partitions numbered in the next. No task holds more than a range.
    """
    pinned = cut_lineage(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = pinned.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return pinned.withColumn("_part", part).join(offsets, "_part").withColumn(
        name, F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_part", "_offset")


def call_order_hash(member: Column, category: Column, at: Column) -> Column:
    """The tie-break of calls that start at the same moment."""
    return F.sha2(F.concat_ws("|", member.cast("string"), category, at), 256)


def phases(events: DataFrame, data_end: Column) -> DataFrame:
    """(id, index, start, end) from rows (id, day, weeks ARRAY<INT>): consecutive half-open
    windows, a NULL length and every end clipped to the end of the data."""
    laid = events.select("id", "day", F.posexplode("weeks").alias("index", "weeks"))
    upto = Window.partitionBy("id").orderBy("index")
    open_end = F.coalesce(F.col("weeks") * 7, F.lit(100_000))
    spans = laid.withColumn("_to", F.sum(open_end).over(upto)).withColumn("_from", F.col("_to") - open_end)
    return spans.select("id", "index", F.least(F.date_add("day", F.col("_from").cast("int")), data_end).alias("start"),
                        F.least(F.date_add("day", F.col("_to").cast("int")), data_end).alias("end"))


def effective_price(day: Column, changed: Column, old: float, new: float) -> Column:
    """The new price from the day of the change on; the old one before it or without a change."""
    return F.when(day >= changed, new).otherwise(old)


def clamped_shift(score: Column, drop: Column, low: int = 1, high: int = 5) -> Column:
    """A score lowered by what is asked, kept on the scale: (score, asked, applied)."""
    moved = F.greatest(F.lit(low), F.least(F.lit(high), score - drop))
    return F.struct(moved.alias("score"), drop.alias("asked"), (score - moved).alias("applied"))

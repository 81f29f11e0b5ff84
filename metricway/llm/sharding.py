"""Histogram sort: shards of near-equal bytes from exact counts below refined key boundaries.

Rows are ordered by a key of two longs. Each round counts, in one aggregation over the narrow keys,
the exact weight below candidate boundaries; only intervals that still hold an unmet splitter are
refined, by a further digit of the key. When all splitters meet the tolerance the rows are
exchanged once, by leaf: the shard boundaries together with boundaries of near-equal row counts, so
that a hot key or many tiny rows never meet in one task.

Defined cases: a null text has no bytes and its own key; equal texts have equal first keys and stay
in one shard unless keeping them together would miss the tolerance, then they are cut by the second
key; rows equal in both keys stay together; an empty table gives an empty result; columns of the
input are kept, and helper columns carry a prefix of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricway.llm.common import small, written

DIGIT = 12  # bits of the key that one round refines by; half as many where many intervals are open
MANY = 64
WORD = 64
LOWEST = -(1 << 63)
P = "__shard_"

Boundary = tuple[int, int]


def _ordered(key: Column) -> Column:
    """A long whose unsigned order is the signed order of `key`."""
    return key.bitwiseXOR(F.lit(LOWEST))


def _prefix(key: Column, bits: int) -> Column:
    """The first `bits` bits of the key, in key order."""
    return F.shiftrightunsigned(_ordered(key), WORD - bits) if bits < WORD else _ordered(key)


def _signed(value: int) -> int:
    return value - (1 << WORD) if value >= 1 << (WORD - 1) else value


def _boundary(prefix: int, bits: int) -> int:
    """The lowest key with that prefix."""
    return _signed(((prefix & ((1 << bits) - 1)) << (WORD - bits)) ^ (1 << (WORD - 1)))


def find_splitters(keys: DataFrame, first: str, second: str, weight: str, parts: int,
                   tolerance: float, whole: float | None = None) -> list[Boundary]:
    """parts - 1 boundaries whose exact weight below is within tolerance * (total / parts).

    whole: a run of equal first keys is kept uncut when one of its ends is within this share instead.
    Where a single key is heavier than the tolerance, the nearer of its ends is taken. A round
    brings max(64, parts) * 64 counts or 64 * 2 ** DIGIT to the driver, whatever the number of rows.
    """
    total = keys.agg(F.sum(weight)).first()[0] or 0
    if not total or parts < 2:
        return []
    mean = total / parts
    slack, run_slack = mean * tolerance, mean * (tolerance if whole is None else whole)
    done: dict[int, Boundary] = {}
    open_: dict[tuple, list[int]] = {(): list(range(1, parts))}  # place: the unmet targets inside
    below = {(): 0}
    # A place is () at first, (prefix, bits) inside the first key, (key, prefix, bits) inside the second.
    while open_:
        found: dict[tuple, list] = {}
        for inner in (False, True):
            places = [p for p in open_ if (len(p) == 3) is inner]
            if not places:
                continue
            levels: dict[int, list[tuple]] = {}
            for place in places:
                levels.setdefault(place[-1] if place else 0, []).append(place)
            for bits, members in levels.items():
                step = min(bits + (DIGIT if len(members) <= MANY else DIGIT // 2), WORD)
                rows = keys
                key = second if inner else first
                if inner:
                    rows = rows.filter(F.col(first).isin(sorted({p[0] for p in members})))
                if bits:
                    rows = rows.filter(_prefix(F.col(key), bits).isin(sorted({_signed(p[-2]) for p in members})))
                by = [F.col(first).alias("run")] if inner else []
                counted = rows.groupBy(*by, _prefix(F.col(key), step).alias("digit")).agg(
                    F.sum(weight).alias("w"), F.min(key).alias("low"), F.max(key).alias("high"))
                for row in counted.collect():
                    digit = row["digit"] & ((1 << WORD) - 1)
                    outer = digit >> (step - bits)
                    place = (row["run"], outer, bits) if inner else ((outer, bits) if bits else ())
                    if place in open_:
                        found.setdefault(place, []).append((digit, step, row["w"], row["low"], row["high"]))
        following: dict[tuple, list[int]] = {}
        for place, targets in open_.items():
            start, inner = below[place], len(place) == 3
            cells = sorted(found[place])
            for t in targets:
                want, under = mean * t, start
                for digit, step, w, low, high in cells:
                    if under + w >= want:
                        break
                    under += w
                left = (place[0], low) if inner else (low, LOWEST)
                right = (place[0], _after(high)) if inner else (_after(high), LOWEST)
                gap_left, gap_right = want - under, under + w - want
                near = min(gap_left, gap_right)
                alone = low == high
                allowed = slack if not alone else (math.inf if inner else run_slack)
                if near <= allowed:
                    done[t] = left if gap_left <= gap_right else right
                    continue
                deeper = (low, 0, 0) if alone else ((place[0], digit, step) if inner else (digit, step))
                following.setdefault(deeper, []).append(t)
                below[deeper] = under
        open_ = following
    return [done[t] for t in sorted(done)]


def _after(key: int) -> int:
    return min(key + 1, (1 << 63) - 1)


def _leaves(first: Column, splitters: list[Boundary], spark) -> tuple[DataFrame, Column]:
    """For each first digit of the key: how many splitters lie below it, and those inside it."""
    inside: dict[int, list[Boundary]] = {}
    for s in splitters:
        inside.setdefault(((s[0] ^ LOWEST) & ((1 << WORD) - 1)) >> (WORD - DIGIT), []).append(s)
    rows, base = [], 0
    for digit in range(1 << DIGIT):
        own = inside.get(digit, [])
        rows.append((digit, base, [{"a": a, "b": b} for a, b in own]))
        base += len(own)
    schema = f"{P}digit long, {P}base int, {P}cuts array<struct<a: bigint, b: bigint>>"
    return spark.createDataFrame(rows, schema), _prefix(first, DIGIT)


def histogram_sort(df: DataFrame, first: str, second: str, size: str, shards: int,
                   tolerance: float = 0.005, whole: float = 0.02, leaves: int | None = None) -> DataFrame:
    """The rows with `shard` (0 to shards - 1, near-equal sums of `size`) and `slot` (gapless from 0).

    leaves: how many tasks of near-equal rows share the exchange; by default one for every million
    rows, but 8 a shard at least.
    """
    spark = df.sparkSession
    keys = written(df.select(F.col(first).alias("first"), F.col(second).alias("second"),
                             F.col(size).cast("long").alias("size"), F.lit(1).cast("long").alias("one")))
    rows = keys.count()
    leaves = leaves or max(8 * shards, rows // 1_000_000)
    cuts = find_splitters(keys, "first", "second", "size", shards, tolerance, whole)
    fine = find_splitters(keys, "first", "second", "one", min(leaves, max(rows, 1)), 0.25)
    merged = sorted({*cuts, *fine})
    shard_of = [sum(c <= s for c in cuts) for s in [(LOWEST, LOWEST), *merged]]
    digits, digit = _leaves(F.col(first), merged, spark)
    own = [F.col(f"`{c}`") for c in df.columns]
    key = F.struct(F.col(first).alias("a"), F.col(second).alias("b"))
    placed = (df.withColumn(f"{P}digit", digit)
              .join(F.broadcast(digits), f"{P}digit")  # 2 ** DIGIT rows, whatever the input
              .withColumn(f"{P}leaf", F.col(f"{P}base") + F.size(F.filter(f"{P}cuts", lambda c: c <= key))))
    counted = keys.withColumn(f"{P}digit", _prefix(F.col("first"), DIGIT)).join(F.broadcast(digits), f"{P}digit")
    counted = counted.withColumn(f"{P}leaf", F.col(f"{P}base") + F.size(F.filter(
        f"{P}cuts", lambda c: c <= F.struct(F.col("first").alias("a"), F.col("second").alias("b")))))
    counts = {r[0]: r[1] for r in counted.groupBy(f"{P}leaf").count().collect()}  # a row for each leaf
    offsets, seen = [], {}
    for leaf, shard in enumerate(shard_of):
        offsets.append((leaf, shard, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + counts.get(leaf, 0)
    table = spark.createDataFrame(offsets, f"{P}leaf int, shard int, {P}offset long")
    order = Window.partitionBy(f"{P}leaf").orderBy(first, second, size)
    return (placed.withColumn(f"{P}place", F.row_number().over(order).cast("long"))
            .join(small(table, len(offsets)), f"{P}leaf")
            .select(*own, "shard", (F.col(f"{P}offset") + F.col(f"{P}place") - 1).alias("slot")))

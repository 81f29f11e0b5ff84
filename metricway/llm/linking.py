"""From buckets of candidates to linked components, without the pairs inside a group.

First every member of a bucket is measured against the bucket's hub; buckets take their hubs in one of a few orders, so that a
group that meets in many buckets is measured against several of its members. Links merge members to components. What could still
join two components is a pair of one bucket in different components: members outside the bucket's largest component are then
measured against the others, a few first and all that are left at last, until nothing joins. The distances are metrics: if
a pair's distances to the hub differ by more than a link allows, the pair is no link and is not formed. Pairs inside a
component are never formed, no pair is measured twice, and no pair that could be a link goes unmeasured.

What members carry besides their size can say how far apart two are at least (`Least`): such pairs are not formed either, and members
that no other of a small bucket comes near leave it before anything is measured.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricway.llm.common import released, written
from metricway.llm.components import components

ORDERS = 5
TURNS = ((0, 32), (32, 1024), (1024, 1 << 31))  # members of a bucket outside its largest component, by their place
SLACK = 1e-9
SEARCHED = 256  # members of a bucket that are all compared before the bucket is kept; a larger one is kept whole

#: (a, b) pairs to (a, b, distance, linked)
Measure = Callable[[DataFrame], DataFrame]
#: a lower bound of the distance of two members, by what gives the columns of each
Least = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def by_size(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    return 1 - F.least(a("size"), b("size")) / F.greatest(a("size"), b("size"), F.lit(1))


def _mask(key: str) -> Column:
    """One of ORDERS orders of the ids: by their difference to a fixed number, bit by bit."""
    return F.xxhash64(F.pmod(key, F.lit(ORDERS)))


def buckets(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, id, size, hub): written members of all buckets with two or more. keyed: (id, key); sizes: (id, size).

    The keys are exchanged once, for the count and for the members of what is met twice.
    """
    dealt = keyed.select("key", "id").repartition("key")
    shared = dealt.join(_heads(dealt), "key").select("key", "id", "hub")
    return written(shared.join(sizes, "id").select("key", "id", "size", "hub"))


def _heads(rows: DataFrame) -> DataFrame:
    """(key, met, hub) of the buckets with two or more."""
    heads = rows.groupBy("key").agg(F.count("*").alias("met"), F.min(F.col("id").bitwiseXOR(_mask("key"))).alias("least"))
    return heads.filter("met > 1").select("key", "met", F.col("least").bitwiseXOR(_mask("key")).alias("hub"))


def near(keyed: DataFrame, sizes: DataFrame, least: Least, similarity: float) -> DataFrame:
    """The written members of `buckets` that another of their bucket could be linked to, with all columns of `sizes`.

    A member of a bucket of up to SEARCHED is held against the others until one is near enough; larger buckets stay whole.
    """
    dealt = keyed.select("key", "id").repartition("key")
    shared = written(dealt.join(_heads(dealt), "key").select("key", "id", "met"))
    others = [c for c in sizes.columns if c != "id"]
    rows = shared.join(sizes, "id").select("key", "id", "met", *others)  # in one order on both sides, so that they are one exchange
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    close = (b("met") > SEARCHED) | (least(a, b) <= 1 - similarity + SLACK)
    kept = written(rows.alias("a").join(rows.alias("b"), (a("key") == b("key")) & (a("id") != b("id")) & close, "left_semi"))
    released(shared)
    members = written(kept.drop("met").join(_heads(kept).drop("met"), "key"))
    released(kept)
    return members


def linked(members: DataFrame, measure: Measure, similarity: float, least: Least = by_size) -> DataFrame:
    """(node, component) of all ids that are linked to another.

    members: (key, id, size, hub) and what else `least` reads. Sizes of a link differ by the similarity at most. The members stay.
    """
    far = 1 - similarity + SLACK
    carried = [c for c in members.columns if c not in ("key", "id", "hub")]
    hubs = members.filter("id = hub").select("hub", *(F.col(c).alias(f"{c}_h") for c in carried)).distinct()
    ends = [F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")]
    spokes = members.filter("id <> hub").select("hub", "id", *carried).distinct().join(hubs, "hub")
    spokes = spokes.select("hub", "id", *ends, least(F.col, lambda c: F.col(f"{c}_h")).alias("bound"))
    first = written(measure(spokes.filter(F.col("bound") <= far).select("a", "b").distinct()))
    found = written(components(first.filter("linked").select("a", "b")))
    # Distances to the hub, exact where measured; else a lower bound.
    apart = spokes.join(first.select("a", "b", "distance"), ["a", "b"], "left")
    apart = apart.select("hub", "id", "distance", F.coalesce("distance", "bound").alias("bound"))
    own = members.filter("id = hub").select("hub", "id", F.lit(0.0).alias("distance"), F.lit(0.0).alias("bound")).distinct()
    members = written(members.join(apart.unionByName(own), ["hub", "id"]).select("key", "id", *carried, "distance", "bound"))
    tried, measures = first.select("a", "b"), [first]
    while True:
        placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(
            "component", F.coalesce("component", "id"))
        parts = placed.groupBy("key", "component").agg(F.count("*").alias("met"))
        main = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("met", "component")).alias("most"))
        main = main.filter("parts > 1").select("key", F.col("most.component").alias("main"))
        open_ = written(placed.join(main, "key"))
        strays = open_.filter("component <> main").withColumn(
            "turn", F.row_number().over(Window.partitionBy("key").orderBy("id")))
        sides = ("id", *carried, "distance", "bound", "component")
        strays = written(strays.select("key", *(F.col(c).alias(f"{c}_a") for c in sides), "turn"))
        most = strays.agg(F.max("turn")).first()[0] or 0
        others = open_.select("key", *(F.col(c).alias(f"{c}_b") for c in sides))
        possible = ((F.col("component_a") != F.col("component_b"))
                    & (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b"))
                    & F.coalesce(F.col("bound_a") - F.col("distance_b") <= far, F.lit(True))
                    & F.coalesce(F.col("bound_b") - F.col("distance_a") <= far, F.lit(True)))
        if least is not by_size:
            possible = possible & (least(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b")) <= far)
        for low, high in TURNS:
            if most <= low:
                released(members, open_, strays, *measures)
                return found
            some = strays.filter((F.col("turn") > low) & (F.col("turn") <= high)).drop("turn")
            met = some.join(others, (some["key"] == others["key"]) & possible).select(
                F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
            measured = written(measure(met.join(tried, ["a", "b"], "left_anti")))
            tried, measures = tried.unionByName(measured.select("a", "b")), [*measures, measured]
            links = measured.filter("linked").select("a", "b")
            if links.head() is not None:
                break
        else:
            released(members, open_, strays, *measures)
            return found
        grown = written(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)))
        released(open_, strays, found)
        found = grown

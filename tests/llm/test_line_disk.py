"""What line dedup leaves on disk, and what it reads: exchanges and tables go when used, lines that cannot be linked are not read."""

import glob
import os
import random
import time

import pytest

pytest.importorskip("metricway.llm")

from pyspark.sql import functions as F  # noqa: E402

from metricway.llm import lines, linking  # noqa: E402
from metricway.session import shared_folder, written  # noqa: E402


def tables(spark):
    return set(glob.glob(f"{shared_folder(spark).removeprefix('file://')}/metricway-*"))


def exchanged(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}


def test_the_exchanges_of_a_written_table_go_with_it(spark):
    before = exchanged(spark)
    out = written(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count())
    end = time.time() + 10
    while exchanged(spark) - before and time.time() < end:  # files are removed in the background
        time.sleep(0.1)
    assert not exchanged(spark) - before and out.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_no_table_of_bands_profiles_or_texts_stays(spark):
    rows = [(i, f"one and the same line in every text {'!' * (i % 3)}\nown line {chr(97 + i) * 40}") for i in range(9)]
    before = tables(spark)
    out = lines.dropped(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    left = [spark.read.parquet(t).columns for t in tables(spark) - before if glob.glob(f"{t}/*.parquet")]
    assert left and not {"low", "profile", "profile_a", "shingles", "hub", "distance"} & {c for t in left for c in t}
    assert out.count() == 8 and all(os.path.isdir(t) for t in before)


def test_profiles_never_overstate_a_distance(spark):
    rng = random.Random(5)
    texts = []
    for n in (3, 20, 60, 300, 900):
        line = [rng.choice("abcdefgh /?日😀") for _ in range(n)]
        for changes in (0, 1, n // 40, n // 12, n // 4):
            own = list(line)
            for _ in range(changes):
                own[rng.randrange(n)] = rng.choice("xyz")
            texts.append("".join(own))
    rows = lines.sketched(spark.createDataFrame(list(enumerate(texts)), "id long, line string")).withColumnRenamed("n", "size")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    found = rows.alias("a").join(rows.alias("b"), a("id") < b("id")).select(a("id"), b("id"), lines.apart(a, b)).collect()
    sets = [{t[i: i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    assert all(least <= 1 - len(sets[i] & sets[j]) / len(sets[i] | sets[j]) + 1e-9 for i, j, least in found)
    assert sum(least > 0.2 for _, _, least in found) > 100  # most pairs are told apart without their texts


def test_members_far_from_all_others_leave_a_bucket(spark):
    """By a bound of their sizes; a bucket of more than SEARCHED is kept whole."""
    many = linking.SEARCHED + 1
    sizes = {0: 100, 1: 90, 2: 10, 3: 1000, 4: 50, **{i: 2 ** (i % 30) for i in range(10, 10 + many)}}
    keyed = [(i, 1) for i in range(4)] + [(3, 2), (4, 2)] + [(i, 3) for i in range(10, 10 + many)]
    members = linking.near(spark.createDataFrame(keyed, "id long, key long"), spark.createDataFrame(list(sizes.items()), "id long, size int"),
                           linking.by_size, 0.8)
    found = {(r.key, r.id): r.hub for r in members.collect()}
    assert set(found) == {(1, 0), (1, 1), *((3, i) for i in range(10, 10 + many))} and found[1, 0] in (0, 1)

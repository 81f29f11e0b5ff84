"""Fuzzy line dedup against brute force over the character strings from every code point on."""

import random

import pytest

pytest.importorskip("metricway.llm")

from metricway.llm import lines  # noqa: E402


def every(line):
    return {line[i: i + lines.SHINGLE] for i in range(max(1, len(line) - lines.SHINGLE + 1))}


def brute(rows):
    """(doc, place) of lines that go, to the place that stays, in the order of the ids."""
    own = sorted((i, p, x) for i, t in rows for p, x in enumerate(t.split("\n")) if x.strip())
    sets, parent = [every(o[2]) for o in own], list(range(len(own)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((o[0], o[1], *own[find(k)][:2]) for k, o in enumerate(own) if find(k) != k)


def gone(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    return sorted((r.doc_id, r.place, r.kept_doc, r.kept_place) for r in lines.dropped(df).collect())


def test_lines_that_differ_behind_a_common_beginning_stay(spark):
    pairs = [("https://example.org/a/1", "https://example.org/b/2?x"), ("see https://example.org/page1", "see https://example.org/other"),
             ("international", "internationalisation"), ("0123456789ab" + "3f9c2e71" * 4, "0123456789ab" + "d58a06b4" * 4)]
    assert gone(spark, [(i, "\n".join(p)) for i, p in enumerate(pairs)]) == []


def test_a_replaced_character_leaves_a_duplicate(spark):
    """In a line of 50 characters at least 41 of 51 five-character strings stay the same."""
    line = "the quick brown fox jumped over the lazy dogs by 9"
    rows = [(0, line)] + [(i + 1, f"{line[:i]}~{line[i + 1:]}") for i in range(0, 50, 7)]
    assert len(line) == 50 and [r[0] for r in gone(spark, rows)] == [r[0] for r in rows[1:]]


def test_shingles_of_all_code_points(spark):
    texts = ["x", "abcd", "abcde", "日本語の文章がここにあります", "a😀b😀c😀d😀e😀f😀g😀h", "one  and\tthe same line"]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    found = df.select("line", lines.shingles(df["line"]).alias("own")).collect()
    assert all(set(r.own) == every(r.line) for r in found)


def test_against_brute_force_at_every_code_point(spark):
    rng = random.Random(11)
    letters = "abcdefghijklmnop /.?日😀"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 220))) for _ in range(40)]
    base += [f"https://example.org/{rng.choice('abc')}/{rng.randrange(99)}?{'q' * rng.randint(0, 9)}" for _ in range(20)]
    rows = []
    for i in range(120):
        own = []
        for _ in range(rng.randint(1, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(letters)
            own.append("".join(line))
        rows.append((i, "\n".join(own)))
    expected = brute(rows)
    assert expected and gone(spark, rows) == expected


def test_another_split_of_the_scan_changes_nothing(spark, folder):
    """The partitions of a scan depend on the cores there are when it is planned."""
    rows = [(i, f"own line {chr(97 + i) * 40}\none and the same line here") for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id").write.parquet(f"{folder}/docs")
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "8")
        out = lines.deduplicated(spark.read.parquet(f"{folder}/docs"))
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        got = {r.doc_id: r.text for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == {i: t if i == 0 else t.split("\n")[0] for i, t in rows}


def test_a_band_is_forty_bits_and_the_occurrences_carry_none(spark):
    """Up to FEW shingles each have a band; a longer line has one a range; keys do not travel with every occurrence."""
    short, long = "abcdefghijklmnop", "".join(chr(97 + i * i % 26) + str(i) for i in range(200))
    df = spark.createDataFrame([(1, f"{short}\n{long}\nab"), (2, long)], "doc_id long, text string")
    occurrences, rows = lines.signed(df)
    assert occurrences.columns == ["doc_id", "row", "place", "line_key", "line_check"] and occurrences.count() == 4
    found = {r.n: (r.low, r.high) for r in rows.collect()}
    assert set(found) == {1, len(every(short)), len(every(long))}
    assert all(len(low) == len(high) == (n if n <= lines.FEW else len(low)) <= lines.FEW for n, (low, high) in found.items())
    assert len(found[len(every(long))][0]) <= 1 << lines.RANGE_BITS

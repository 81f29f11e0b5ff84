"""Fuzzy line dedup: rules for odd inputs; test_line_shingles.py has the brute force."""

import hashlib

import pytest

pytest.importorskip("metricway.llm")

from metricway.llm import lines  # noqa: E402

def test_rebuilt_texts(spark, folder):
    rows = [(2, "one and the same line here\n\nown words of two"), (1, "one and the same line here\nx"), (3, None), (4, ""),
            (5, "日本語の文章がここにあります\nx\ny"), (6, "日本語の文章がここにあります"), (7, " \n\t"), (8, "x\nx")]
    spark.createDataFrame([(i, t, 0, "p") for i, t in rows], "doc_id long, text string, n_chars long, line string"
                          ).coalesce(1).write.parquet(f"{folder}/docs")
    out = {r.doc_id: r for r in lines.deduplicated(spark.read.parquet(f"{folder}/docs")).collect()}
    assert {i: r.text for i, r in out.items()} == {
        1: "one and the same line here\nx", 2: "\nown words of two", 3: None, 4: "", 5: "日本語の文章がここにあります\ny",
        6: "", 7: " \n\t", 8: ""}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.line == "p" for r in out.values())


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "same words in a line")] * 3, "doc_id long, text string").coalesce(1)
    assert lines.dropped(df).count() == 2
    assert lines.dropped(df.limit(0)).count() == 0


def test_a_band_with_several_groups_is_searched_through(spark):
    sets = {i: [f"g{i % 40}s{k}" for k in range(20)] for i in range(80)}
    members = spark.createDataFrame([(9, i, 20, 0) for i in sets], "key long, id long, size int, hub long")
    frame = spark.createDataFrame(list(sets.items()), "id long, shingles array<string>")
    found = {r.node: r.component for r in lines.linked(members, frame).collect()}
    assert found == {i: i % 40 for i in sets}


def test_null_ids_long_texts_and_a_clashing_column(spark, folder):
    """Documents without an id are documents like others; a text of many words; a column named as an inner one."""
    long = "\n".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(2000)) + "\n" + "word " * 20_000
    rows = [(None, "the same line in two documents here", "x"), (None, "the same line in two documents here!", "y"), (7, long, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, gone string").coalesce(1).write.parquet(f"{folder}/docs")
    out = {r.gone: r.text for r in lines.deduplicated(spark.read.parquet(f"{folder}/docs")).collect()}
    assert sorted(map(len, (out["x"], out["y"]))) in ([0, 35], [0, 36]) and set(out) == {"x", "y", "z"}
    assert out["z"] and set(out["z"].split("\n")) <= set(long.split("\n"))

"""The pipeline's stages: each decision against a plain version of its rule, and columns from stage to stage."""

import pytest

pytest.importorskip("metricway.llm")

import corpus_pipeline as pipeline  # noqa: E402
from metricway.llm import language, packing, toxicity  # noqa: E402
from metricway.llm.common import table  # noqa: E402
from test_bagminhash import brute_classes  # noqa: E402
from test_line_shingles import brute  # noqa: E402
from test_packing import checked  # noqa: E402


def stored(df, folder, name):
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def test_stages(spark, sf, folder):
    docs = stored(table(spark, sf, "documents").limit(120).coalesce(1), folder, "docs")
    rows = {r.doc_id: r for r in docs.collect()}
    clean = stored(pipeline.clean(spark, docs, sf), folder, "clean")
    model = toxicity.fit(docs, table(spark, sf, "labels"), language.fold("doc_id", 5) != 0)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(
        i for i, r in rows.items() if model.score(r.text, {}) < 0.5)

    lined = stored(pipeline.distinct_lines(spark, clean, sf), folder, "lined")
    before = sorted((r.doc_id, r.text) for r in clean.collect())
    gone = {(d, p) for d, p, _, _ in brute(before)}
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in before}
    after = lined.collect()
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)

    single = stored(pipeline.distinct_documents(spark, lined, sf), folder, "single")
    given = sorted((r.doc_id, r.text) for r in after)
    classes = brute_classes(given)
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))

    mixed = stored(pipeline.mixture(spark, single, sf), folder, "mixed")
    for stage in (clean, lined, single, mixed):
        assert stage.columns == pipeline.COLUMNS and stage.count() > 0
    kept = {r.doc_id: r.text for r in mixed.collect()}
    assert kept.items() <= {r.doc_id: r.text for r in single.collect()}.items()
    windows = pipeline.packed(spark, mixed, sf).collect()
    assert checked(windows, kept) and all(r.length <= packing.CAPACITY for r in windows)


def test_stages_are_named_and_ordered():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]

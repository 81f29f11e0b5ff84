"""Packing: ids against the named tokenizer file, pieces and sequences against their laws."""

import random
import zlib

import pytest

pytest.importorskip("metricway.llm")

from metricway.llm import packing  # noqa: E402


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(reference_ids, "t"):
        reference_ids.t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return reference_ids.t.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def checked(rows, texts):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids, at = reference_ids(text), 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r.start):
            part = b"".join(i.to_bytes(4, "little") for i in ids[r.start: r.start + r.length])
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    return len(by_sequence)


def test_query_against_the_tokenizer(spark, sf):
    from metricway.llm import queries

    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.packed_windows(spark, sf).collect()
    used = sum(r.length for r in rows)
    assert used / (checked(rows, texts) * packing.CAPACITY) > 0.98


def test_odd_texts(spark):
    odd = [None, "", " ", "  a", "a  b \n c", "x\n y\n\nz", "tab\t tab", "don't <|endoftext|> stop", "é" * 3000,
           " lead", "trail ", "日本語 テキスト", "a b c  d", "1 2  3", "### *** " * 400]
    texts = dict(enumerate(odd))
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, sequence_id string")
    checked(packing.pack(df).collect(), texts)
    assert packing.pack(df.limit(0)).count() == 0


def test_repeated_rows_are_packed_each_time(spark):
    df = spark.createDataFrame([(1, "a b c")] * 500, "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert len(rows) == 500 and len({(r.sequence_id, r.offset) for r in rows}) == 500


@pytest.mark.parametrize("seed", range(6))
def test_differencing(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 300) for _ in range(rng.randint(0, 200))]
    ways = rng.randint(1, 20)
    groups = packing.differenced(sizes, ways)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    full = packing.packed(sizes, 1024)
    loads = [sum(sizes[i] for i in g) for g in full]
    assert sorted(i for g in full for i in g) == list(range(len(sizes))) and max(loads, default=0) <= 1024


def test_differencing_beats_greedy_on_the_known_case():
    groups = packing.differenced([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in groups) == [14, 16]

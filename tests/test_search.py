import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricway.functions import where as W
from metricway.operators import ann, embed, impact
from metricway.operators import quotes as quotes_of
from metricway.operators import search as S
from metricway.sources.bindings import Tables

PHRASES = ["card declined", "fee refund", "mortgage rate", "app login", "branch hours"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"CALL-{i:05d}", f"Call {i}. {PHRASES[i % 5]}. Reference token zq{i:03d}.", PHRASES[i % 5].split()[0],
             ("resolved", "escalated", "callback")[i % 3], f"2026-0{1 + i % 9}-{1 + i % 28:02d}T10:00:00",
             None if i % 11 == 0 else ("North", "South")[i % 2], i % 5 + 1 if i % 4 else None) for i in range(50)]
    return spark.createDataFrame(rows, "call_id string, text string, category string, outcome string, date string, "
                                       "home_branch string, csat_score int").cache()


@pytest.fixture(scope="module")
def corpus(docs):
    return docs.join(embed.hashed_bag_of_words(docs, "call_id"), "call_id").cache()


def queries_of(spark, texts):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, query string")
    return q.join(embed.hashed_bag_of_words(q, "query_id", "query").withColumnRenamed("vector", "query_vector"), "query_id")


def test_exact_text_scores_one_and_filters_come_first(spark, docs, corpus):
    text = docs.filter("call_id = 'CALL-00007'").first().text
    hits = S.nearest(corpus, queries_of(spark, [text]), 5, "call_id").orderBy("rank").collect()
    assert hits[0].call_id == "CALL-00007" and hits[0].score == pytest.approx(1.0, abs=1e-6)
    narrow = S.nearest(corpus, queries_of(spark, [text]), 5, "call_id", where={"category": "branch"})
    assert narrow.count() == 5
    one = S.search_one(corpus, corpus.filter("call_id = 'CALL-00007'").first().vector, 3, "call_id").collect()
    assert [r.call_id for r in one][0] == "CALL-00007"


def test_ties_go_to_the_lower_id_even_in_a_crowd_of_copies(spark):
    rows = [(f"d{i:04d}", [1.0, 0.0] if i % 3 == 0 else [0.0, float(i)]) for i in range(600)]
    corpus = spark.createDataFrame(rows, "doc_id string, vector array<float>").repartition(5)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    hits = [r.doc_id for r in S.nearest(corpus, q, 7).orderBy("rank").collect()]
    assert hits == [f"d{i:04d}" for i in range(0, 21, 3)]


def test_many_queries_go_in_blocks(spark, corpus, monkeypatch):
    texts = [f"{p} {i}" for i, p in enumerate(PHRASES * 4)]
    whole = sorted(map(tuple, S.nearest(corpus, queries_of(spark, texts), 3, "call_id").collect()))
    monkeypatch.setattr(S, "QUERY_BLOCK", 6)
    assert sorted(map(tuple, S.nearest(corpus, queries_of(spark, texts), 3, "call_id").collect())) == whole


def test_bm25_against_brute_force_and_a_stored_index(spark, docs, folder):
    texts = {r.call_id: re.findall("[a-z0-9]+", r.text.lower()) for r in docs.collect()}
    query = "fee refund zq006"
    mean = sum(map(len, texts.values())) / len(texts)
    want = {}
    for call, words in texts.items():
        tf, score = Counter(words), 0.0
        for term in set(query.split()):
            df = sum(term in t for t in texts.values())
            if tf[term]:
                score += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf[term] * 2.2 / (
                    tf[term] + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if score:
            want[call] = score
    q = spark.createDataFrame([(1, query)], "query_id int, query string")
    index = S.TextIndex.over(docs, "call_id")
    for each in (index, index.write(folder, buckets=4)):
        got = {r.call_id: r.bm25 for r in S.bm25(each, q).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)
    top = S.text_search(index, q, 4).orderBy("rank").collect()
    assert top[0].score == 1.0 and top[0].call_id == max(want, key=want.get)


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1, 0.9), (1, "y", 2, 0.8)], "query_id int, doc_id string, rank int, score double")
    b = spark.createDataFrame([(1, "x", 1, 1.0), (1, "z", 2, 0.5)], "query_id int, doc_id string, rank int, score double")
    fused = {r.doc_id: r.score for r in S.fuse_ranks(a, b, 5).collect()}
    assert fused["x"] == 1.0 and fused["y"] == fused["z"] == pytest.approx(61 / 62 / 2)
    blended = [r.doc_id for r in S.blend_scores(a, b, 5).orderBy("rank").collect()]
    assert blended == ["x", "y", "z"]


def test_cells_exact_when_all_are_probed_and_stored(spark, folder):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(400)]
    corpus = spark.createDataFrame(rows, "doc_id int, vector array<float>")
    q = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(5)], "query_id int, query_vector array<double>")
    exact = sorted(map(tuple, S.nearest(corpus, q, 6).collect()))
    index = ann.CellIndex.build(corpus, cells=12).write(folder)
    assert sorted(map(tuple, index.search(q, 6, probes=12).collect())) == exact
    few = index.search(q, 6, probes=3)
    recall = ann.ann_recall(few, S.nearest(corpus, q, 6), corpus.agg(F.count("*").alias("n")), 6)
    assert 0.3 < recall.agg(F.avg("recall")).first()[0] <= 1.0


@pytest.mark.parametrize("where, n", [
    (None, 50), ({"category": "card"}, 10), ({"category": {"in": []}}, 0), ({"home_branch": None}, 5),
    ({"date": {"gte": "2026-01-01", "lte": "2026-01-01"}}, 1), ({"csat_score": {"gte": 4}}, 14), ({"category": "x' OR 1=1"}, 0)])
def test_where(docs, where, n):
    assert W.count(docs, where).first().n == n


@pytest.mark.parametrize("where", [
    {"text": "x"}, {"category": {}}, {"category": {"gte": "a"}}, {"category": {"like": "a"}}, {"category": {"in": "a"}},
    {"date": {"gte": 5}}, {"date": {"gte": "2026-02-30"}}, {"csat_score": 6}, {"csat_score": True}, {"csat_score": {"gte": None}}])
def test_bad_where(where):
    with pytest.raises(ValueError):
        W.checked(where)


def test_unstored_field_is_refused(docs):
    with pytest.raises(ValueError):
        W.filtered(docs.drop("csat_score"), {"csat_score": 5})
    with pytest.raises(ValueError):
        W.score_range(4, 2)


def test_quote_pairs_against_brute_force(spark, sf):
    t = Tables(spark, sf)
    docs = {r.doc_id: " ".join(r.text.split()) for r in t["documents"].collect()}
    quotes = [(i, " ".join(x.split())) for i, x in [
        (0, docs[3][5:60]), (1, docs[4][:12]), (2, docs[5][7:30]), (3, "thisisnotawordatall"), (4, docs[6][2:16]), (5, docs[7][10:290])]]
    quotes += [(6, docs[8][3:900]), (7, docs[9][4:9]), (8, "e"), (9, "e t"), (10, docs[3].split(" ")[1][:3]), (11, "the of"), (12, "zz qq")]
    quotes += [(20 + i, " ".join(docs[10 + i].split(" ")[3:3 + i % 6 + 1])[i % 3:]) for i in range(30)]
    quotes = [(i, q.strip()) for i, q in quotes]
    want = sorted((i, d) for i, q in quotes if q for d, x in docs.items() if q in x)
    given = spark.createDataFrame(quotes, "item_id int, quote string")
    assert sorted(map(tuple, quotes_of.quote_pairs(given, t["documents"].select("doc_id", "text")).collect())) == want


def test_copies_and_jitter(spark):
    docs = spark.createDataFrame([("a", "t", [3.0, 4.0])], "call_id string, text string, vector array<float>")
    rows = {r.call_id: r.vector for r in embed.jittered(embed.scale_up(docs, 3)).collect()}
    again = {r.call_id: r.vector for r in embed.jittered(embed.scale_up(docs, 3)).collect()}
    assert set(rows) == {"a", "a~r001", "a~r002"} and rows["a"] == [3.0, 4.0] and rows == again
    assert rows["a~r001"] != rows["a~r002"]
    assert np.linalg.norm(rows["a~r001"]) == pytest.approx(1.0, abs=1e-6)
    assert np.dot(rows["a~r001"], [0.6, 0.8]) > 0.99
    with pytest.raises(ValueError):
        embed.scale_up(docs, 0)


def test_model_guard(spark):
    store = spark.createDataFrame([("a", "old"), ("b", "new")], "call_id string, embedding_model string")
    with pytest.raises(ValueError):
        embed.require_one_model(store, store.filter("call_id = 'b'"), "new")
    embed.require_one_model(store, store, "new")


def brute_bm25(texts, query):
    words = {d: re.findall("[a-z0-9]+", (t or "").lower()) for d, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for doc, own in words.items():
        tf, score = Counter(own), 0.0
        for term in set(re.findall("[a-z0-9]+", query.lower())):
            df = sum(term in set(w) for w in words.values())
            if tf[term]:
                score += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf[term] * 2.2 / (tf[term] + 1.2 * (0.25 + 0.75 * len(own) / mean))
        if score:
            out[doc] = round(score, 9)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("direct", [0, 1000])
def test_impact_index_against_brute_force(spark, folder, direct, monkeypatch):
    """Also with blocks skipped by their bounds, with a filter, and with a null and an empty text."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(rng.choice(words, rng.integers(1, 40), p=np.arange(1, 121) / 7260)) for i in range(300)} | {300: None, 301: ""}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    asked = {1: "w3 w5 w5 W9", 2: "w119", 3: "nothing known", 4: " ".join(words[:50]), 5: "w0"}
    q = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    index = impact.ImpactIndex.build(docs, folder, buckets=4, block_docs=16)
    assert index.blocks > 10 and index.docs == 302
    seen = []
    spy = impact.ImpactIndex._scored
    def scored(self, *args):
        seen.append(args[-1])
        return spy(self, *args)
    monkeypatch.setattr(impact.ImpactIndex, "_scored", scored)
    for k in (1, 7):
        got = {}
        for r in index.search(q, k, direct=direct).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
        for i, text in asked.items():
            want = brute_bm25(texts, text)[:k]
            mine = sorted(got.get(i, []))
            assert [d for _, d, _ in mine] == [d for d, _ in want]
            assert [s for _, _, s in mine] == pytest.approx([s for _, s in want])
    if direct == 0:  # of the rare word's blocks only those that can still reach its best are looked at
        rest, reach = seen[1].filter("asked IS NOT NULL").count(), index.blocks * 4
        assert 0 < rest < reach
    allowed = docs.filter("doc_id % 3 = 0").select("doc_id")
    got = [r.doc_id for r in index.search(q.filter("query_id = 4"), 5, allowed=allowed, direct=direct).orderBy("rank").collect()]
    assert got == [d for d, _ in brute_bm25(texts, asked[4]) if d % 3 == 0][:5]


def test_null_texts_score_alike_on_the_fly_and_stored(spark, folder):
    docs = spark.createDataFrame([("a", "fee refund"), ("b", None), ("c", "fee"), ("d", "")], "call_id string, text string")
    q = spark.createDataFrame([(1, "fee")], "query_id int, query string")
    index = S.TextIndex.over(docs, "call_id")
    fly, stored = (sorted((r.call_id, round(r.bm25, 9)) for r in S.bm25(i, q).collect()) for i in (index, index.write(f"{folder}/t", 2)))
    built = impact.ImpactIndex.build(docs, f"{folder}/i", "call_id").search(q, 5)
    assert fly == stored == sorted((r.call_id, round(r.score, 9)) for r in built.collect())


def test_vectors_that_cannot_be_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0, 0.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [0.6, 0.8])]
    corpus = spark.createDataFrame(rows, "doc_id int, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0, 1.0]), (4, [None, 1.0])], "query_id int, query_vector array<double>")
    got = sorted((r.query_id, r.doc_id, r.score) for r in S.nearest(corpus, q, 9).collect())
    assert got == [(1, 1, 1.0), (1, 5, 0.0), (1, 6, 0.6), (3, 3, 0.0)]
    assert S.nearest(corpus, q.filter("query_vector IS NULL"), 3).count() == 0
    cells = ann.CellIndex.build(corpus.filter("doc_id <> 3"), cells=2)
    assert sorted((r.query_id, r.doc_id, r.score) for r in cells.search(q.filter("query_id < 3"), 9, probes=2).collect()) == got[:3]


def test_a_text_without_words_has_a_zero_vector(spark):
    docs = spark.createDataFrame([(1, "fee fee"), (2, ""), (3, None), (4, "!?")], "doc_id int, text string")
    rows = {r.doc_id: r.vector for r in embed.hashed_bag_of_words(docs).collect()}
    assert len(rows) == 4 and sum(rows[1]) == 1.0 and all(rows[i] == [0.0] * 64 for i in (2, 3, 4))


def test_impact_index_is_written_by_the_tasks_that_read_the_texts(spark, folder):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3}" if i % 5 else None) for i in range(500)], "doc_id long, text string")
    ran = spark._jsparkSession.sharedState().statusStore().executionsList
    before = ran().size()
    index = impact.ImpactIndex.build(docs, folder, buckets=4, block_docs=16)
    executions = ran()
    plans = [executions.apply(i).physicalPlanDescription() for i in range(before, executions.size())]
    laid = [p for p in plans if "MapInArrow" in p and "InsertIntoHadoopFs" in p]
    assert len(laid) == 1 and "Exchange" not in laid[0]
    places = index.places().collect()
    assert sorted(p.doc_id for p in places) == list(range(500))
    assert max(Counter(p.block for p in places).values()) <= 16 and len({p.block for p in places}) == index.blocks

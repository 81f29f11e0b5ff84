"""Search: vector, BM25, hybrid, filters, approximate cells."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from metricway.functions import where as W
from metricway.operators import ann, embed, impact, search as S
from metricway.session import shared_folder, written
from registry.base import check, rounded, tables

K = 10


def doc_store(spark, sf):
    """Documents with the filterable fields; the score is NULL where there is no label."""
    t = tables(spark, sf)
    score = t["labels"].select("doc_id", (F.col("quality") * 3 + F.col("toxic") + 1).alias("csat_score"))
    i = F.col("doc_id")
    return t["documents"].join(score, "doc_id", "left").select(
        "doc_id", "text", F.concat(F.lit("CALL-"), F.lpad(i.cast("string"), 12, "0")).alias("call_id"),
        F.col("lang").alias("category"), F.col("source").alias("outcome"),
        F.concat(F.lit("2026-03-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("T15:00:00")).alias("date"),
        F.when(i % 11 != 0, F.element_at(F.array(*map(F.lit, ("Westside", "Downtown", "Northgate", "O'Hare"))),
                                         (i % 4 + 1).cast("int"))).alias("home_branch"), "csat_score")


STORE_SQL = """store AS (SELECT d.doc_id, text, 'CALL-' || lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS call_id, lang AS category,
    source AS outcome, '2026-03-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T15:00:00' AS date,
    CASE WHEN d.doc_id % 11 <> 0 THEN ['Westside', 'Downtown', 'Northgate', 'O''Hare'][d.doc_id % 4 + 1] END AS home_branch,
    quality * 3 + toxic + 1 AS csat_score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

# Name -> (filter, the same in SQL).
FILTERS = {
    "none": (None, "true"),
    "category": ({"category": "en"}, "category = 'en'"),
    "two_outcomes": ({"outcome": {"in": ["src1", "src2"]}}, "outcome IN ('src1', 'src2')"),
    "empty_list": ({"category": {"in": []}}, "false"),
    "branch": ({"home_branch": "O'Hare"}, "home_branch = 'O''Hare'"),
    "no_branch": ({"home_branch": None}, "home_branch IS NULL"),
    "one_day": ({"date": {"gte": "2026-03-05", "lte": "2026-03-05"}}, "date LIKE '2026-03-05%'"),
    "before_day": ({"date": {"lt": "2026-03-05"}}, "date < '2026-03-05'"),
    "moment": ({"date": {"lte": "2026-03-05T15:00:00"}}, "date <= '2026-03-05T15:00:00'"),
    "id": ({"call_id": "CALL-000000000007"}, "doc_id = 7"),
    "scores": (W.score_range(2, 4), "csat_score BETWEEN 2 AND 4"),
    "no_score": ({"csat_score": None}, "csat_score IS NULL"),
    "several": ({"category": {"in": ["en", "fr"]}, "date": {"gte": "2026-03-10"}, "csat_score": {"gte": 4}},
                "category IN ('en', 'fr') AND date >= '2026-03-10' AND csat_score >= 4"),
    "injection": ({"category": "en' OR '1'='1"}, "category = 'en'' OR ''1''=''1'"),
}


def where_counts(spark, sf):
    store = doc_store(spark, sf)
    counts = [F.count_if(W.predicate(w)).alias(n) for n, (w, _) in FILTERS.items()]
    return store.agg(*counts)


def vectors(spark, sf):
    return tables(spark, sf)["embeddings"].select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("category"))


def label_queries(spark, sf):
    """One query per label: the mean of its vectors. Relevant is what carries the label."""
    means = tables(spark, sf)["embeddings"].select("label", F.posexplode("embedding").alias("i", "x")).groupBy(
        "label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(
        F.struct("i", "x"))), lambda r: r["x"]).alias("query_vector"))


LABEL_QUERIES_SQL = """q AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM (
    SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


def nearest_sql(keep="true", k=K):
    return f"""SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank
        FROM (SELECT q.query_id, e.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 9) AS score
              FROM q CROSS JOIN embeddings e WHERE {keep}) QUALIFY rank <= {k}"""


def by_label(where=None, k=K):
    def run(spark, sf):
        return S.nearest(vectors(spark, sf), label_queries(spark, sf), k, where=where)
    return run


def shown(query, digits=6):
    return lambda spark, sf: rounded(query(spark, sf), digits)


def one_query(spark, sf):
    """The nearest of the vectors' own overall mean."""
    mean = tables(spark, sf)["embeddings"].select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(
        F.avg(F.col("x").cast("double")).alias("x")).orderBy("i").collect()  # one row a dimension
    return S.search_one(vectors(spark, sf), [r.x for r in mean], K, where={"category": {"in": ["1", "2", "3", "4"]}}
                        ).select("doc_id", "category", "score")


def looked_up(spark, sf):
    t = tables(spark, sf)
    return S.lookup(t["documents"].select("doc_id", "lang", "n_chars"), 42)


def items(spark, sf):
    return tables(spark, sf)["benchmark"].select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_INDEXES: dict = {}


def text_index(spark, sf):
    """The stored index of the documents, built once a session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = f"{shared_folder(spark)}/impact-{uuid.uuid4().hex}"
        impact.ImpactIndex.build(tables(spark, sf)["documents"], _INDEXES[key])
    return impact.ImpactIndex(spark, _INDEXES[key])


def text_hits(spark, sf, k=K, allowed=None):
    return impact.text_search(text_index(spark, sf), items(spark, sf), k, allowed=allowed)


def allowed_docs(spark, sf):
    return W.filtered(doc_store(spark, sf), {"category": {"in": ["en", "de"]}, "csat_score": {"gte": 4}})


BM25_SQL = """t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
    n AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t),
    qt AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term
           FROM benchmark),
    p AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM t)
          WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
    d AS (SELECT term, ln(1 + (any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, n GROUP BY 1),
    raw AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 9) AS bm
            FROM qt JOIN p USING (term) JOIN d USING (term), n GROUP BY 1, 2)"""


def text_sql(name="fts", k=K, keep="true"):
    return f"""{name} AS (SELECT query_id, doc_id, bm / max(bm) OVER (PARTITION BY query_id) AS score, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm DESC, doc_id) AS INT) AS rank FROM raw WHERE {keep}
        QUALIFY rank <= {k}))"""


def item_vectors(spark, sf):
    """A query's vector is the stored vector of the same number."""
    v = tables(spark, sf)["embeddings"].select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return items(spark, sf).join(v, "query_id")


def both_lists(spark, sf, k=K * 2):
    return S.nearest(vectors(spark, sf), item_vectors(spark, sf), k), text_hits(spark, sf, k)


def hybrid(spark, sf):
    return S.fuse_ranks(*both_lists(spark, sf), K)


def weighted(spark, sf):
    return S.blend_scores(*both_lists(spark, sf), K)


def pair_sql(score):
    vec = nearest_sql(k=K * 2)
    return f"""WITH q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
        vec AS ({vec}), {BM25_SQL}, {text_sql(k=K * 2)}
        SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank
        FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, round({score}, 9) AS score
              FROM vec a FULL OUTER JOIN fts b ON a.query_id = b.query_id AND a.doc_id = b.doc_id) QUALIFY rank <= {K}"""


def statement(spark, sf):
    """How many of each language's documents the BM25 hits rest on."""
    store = doc_store(spark, sf).select("doc_id", "category")
    hits = text_hits(spark, sf).join(store, "doc_id")
    return S.sample_statement(hits, store)


def surveyed_statement(spark, sf):
    """The same for hits among documents with a survey score of 4 or more: totals count only those."""
    store = doc_store(spark, sf).select("doc_id", "category", "csat_score")
    where = W.score_range(4, 5)
    hits = text_hits(spark, sf, allowed=W.filtered(store, where)).join(store, "doc_id")
    return S.sample_statement(hits, store, where=where)


def cells_checked(spark, sf):
    """What can be said for certain of an approximate search: full lists, true scores, and the recall that was asked for."""
    corpus, queries = vectors(spark, sf), label_queries(spark, sf)
    index = ann.CellIndex.build(corpus)
    hits = written(index.search(queries, K, probes=max(1, len(index.centres) * 9 // 10)))
    true = ann.refined(hits, corpus, queries, K).select("query_id", "doc_id", F.col("score").alias("true"), F.col("rank").alias("true_rank"))
    same = hits.join(true, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.count("*").alias("hits"), F.bool_and(F.coalesce((F.abs(F.col("score") - F.col("true")) < 1e-6), F.lit(False))).alias("true_scores"))
    recall = ann.ann_recall(hits, S.nearest(corpus, queries, K), corpus.agg(F.count("*").alias("n")), K)
    return same.join(recall, "query_id").select("query_id", "hits", "true_scores", (F.col("recall") >= 0.9).alias("recall_reached"))


def hydrated(spark, sf):
    store = doc_store(spark, sf).withColumn("metadata", F.create_map(
        F.lit("category"), F.col("category"), F.lit("outcome"), F.col("outcome")))
    hits = S.hydrated(text_hits(spark, sf), store)
    meta = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]))), ";")
    return hits.select("query_id", "doc_id", "rank", meta.alias("metadata"))


def cells(spark, sf):
    index = ann.CellIndex.build(vectors(spark, sf))
    return index.search(label_queries(spark, sf), K, probes=6)


def cell_recall(spark, sf):
    """Every label query through a quarter of the cells: the share of the true nearest it finds."""
    corpus, queries = vectors(spark, sf), label_queries(spark, sf)
    exact = S.nearest(corpus, queries, K)
    index = ann.CellIndex.build(corpus)
    coarse = index.search(queries, K * 5, probes=max(1, len(index.centres) // 4))
    hits = ann.refined(coarse, corpus, queries, K)
    return rounded(ann.ann_recall(hits, exact, corpus.agg(F.count("*").alias("n")), K))


def all_cells_recall(spark, sf):
    """Probing every cell is exact: recall 1 for each query."""
    corpus, queries = vectors(spark, sf), label_queries(spark, sf)
    index = ann.CellIndex.build(corpus)
    hits = index.search(queries, K, probes=len(index.centres))
    return rounded(ann.ann_recall(hits, S.nearest(corpus, queries, K), corpus.agg(F.count("*").alias("n")), K))


def refined_same(spark, sf):
    """Fifty candidates a query, scored again: the same as the exact ten."""
    corpus, queries = vectors(spark, sf), label_queries(spark, sf)
    return ann.refined(S.nearest(corpus, queries, K * 5), corpus, queries, K)


def bag_of_words(spark, sf):
    """The hashed embedding of every document, as sums that any engine can repeat."""
    v = embed.hashed_bag_of_words(tables(spark, sf)["documents"])
    return rounded(v.select("doc_id", F.posexplode("vector").alias("bucket", "x")).filter("x > 0").groupBy("bucket").agg(
        F.count("*").alias("docs"), F.sum(F.col("x").cast("double")).alias("mass")), 3)


QUERIES = {
    "search_vector_topk": (shown(by_label()), f"WITH {LABEL_QUERIES_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({nearest_sql()})"),
    "search_vector_filtered": (
        shown(by_label({"category": {"in": ["2", "5", "7"]}})),
        f"WITH {LABEL_QUERIES_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({nearest_sql('label IN (2, 5, 7)')})"),
    "search_vector_one": (shown(one_query), f"""WITH q AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, avg(x) AS x FROM (
            SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1))
        SELECT vec_id AS doc_id, CAST(label AS VARCHAR) AS category, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score
        FROM embeddings, q WHERE label BETWEEN 1 AND 4 ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 9) DESC, vec_id LIMIT 10"""),
    "search_lookup": (looked_up, "SELECT doc_id, lang, n_chars, 1.0::DOUBLE AS score FROM documents WHERE doc_id = 42"),
    "search_bm25": (shown(text_hits), f"WITH {BM25_SQL}, {text_sql()} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM fts"),
    "search_bm25_filtered": (
        shown(lambda spark, sf: text_hits(spark, sf, allowed=allowed_docs(spark, sf))),
        f"""WITH {STORE_SQL}, {BM25_SQL}, {text_sql(keep="doc_id IN (SELECT doc_id FROM store WHERE category IN ('en', 'de') AND csat_score >= 4)")}
        SELECT query_id, doc_id, round(score, 6) AS score, rank FROM fts"""),
    "search_hybrid_rrf": (shown(hybrid), pair_sql("(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0)) * 61 / 2")),
    "search_weighted_blend": (shown(weighted), pair_sql("0.5 * coalesce(a.score, 0) + 0.5 * coalesce(b.score, 0)")),
    "search_sample_statement": (statement, f"""WITH {BM25_SQL}, {text_sql()}
        SELECT query_id, lang AS category, count(*) AS got, (SELECT count(*) FROM documents x WHERE x.lang = d.lang) AS total,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, lang) AS INT) AS place
        FROM fts JOIN documents d USING (doc_id) GROUP BY query_id, lang"""),
    "search_surveyed_statement": (surveyed_statement, f"""WITH {STORE_SQL}, {BM25_SQL},
            {text_sql(keep="doc_id IN (SELECT doc_id FROM store WHERE csat_score BETWEEN 4 AND 5)")}
        SELECT query_id, lang AS category, count(*) AS got, (SELECT count(*) FROM store x WHERE x.category = d.lang AND csat_score BETWEEN 4 AND 5) AS total,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, lang) AS INT) AS place
        FROM fts JOIN documents d USING (doc_id) GROUP BY query_id, lang"""),
    "search_cells_checked": (cells_checked, f"""WITH {LABEL_QUERIES_SQL}
        SELECT query_id, least(10, (SELECT count(*) FROM embeddings)) AS hits, true AS true_scores, true AS recall_reached FROM q"""),
    "search_hydrated": (hydrated, f"""WITH {STORE_SQL}, {BM25_SQL}, {text_sql()}
        SELECT query_id, doc_id, rank, 'category=' || category || CASE WHEN csat_score IS NULL THEN '' ELSE ';csat_score=' || csat_score END
            || ';outcome=' || outcome AS metadata FROM fts JOIN store USING (doc_id)"""),
    "search_where_counts": (where_counts, f"WITH {STORE_SQL} SELECT "
                            + ", ".join(f"count(*) FILTER ({sql}) AS {n}" for n, (_, sql) in FILTERS.items()) + " FROM store"),
    "search_filtered_store": (
        lambda spark, sf: W.filtered(doc_store(spark, sf), FILTERS["several"][0]).select("doc_id", "category", "csat_score"),
        f"WITH {STORE_SQL} SELECT doc_id, category, csat_score FROM store WHERE {FILTERS['several'][1]}"),
    "search_cells": (shown(cells), None),
    "search_cell_recall": (cell_recall, None),
    "search_all_cells_recall": (all_cells_recall, "SELECT DISTINCT label AS query_id, 1.0::DOUBLE AS recall FROM embeddings"),
    "search_refined": (shown(refined_same), f"WITH {LABEL_QUERIES_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({nearest_sql()})"),
    "search_bag_of_words": (bag_of_words, """
        WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM documents),
        c AS (SELECT doc_id, ('0x' || substr(md5(word), 31, 2))::INT % 64 AS bucket, count(*) AS n FROM w GROUP BY 1, 2),
        v AS (SELECT doc_id, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT AS x FROM c)
        SELECT CAST(bucket AS INT) AS bucket, count(*) AS docs, round(sum(x::DOUBLE), 3) AS mass FROM v GROUP BY 1"""),
}

"""Top-k search over embedded documents: vector, BM25, hybrid; filters come first.

Vector search multiplies Arrow batches of the corpus with a block of queries and keeps k rows
per query in each task, so what is shuffled does not grow with the corpus. BM25 works on
postings of the queried terms only.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from metricway.functions.where import filtered
from metricway.session import shared_folder, sized, spread, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

# Fusion constant, BM25 parameters, default blend, token pattern.
RRF_K = 60
K1, B = 1.2, 0.75
ALPHA = 0.5
TOKEN, NOT_A_TOKEN = "[a-z0-9]+", "[^a-z0-9]+"
QUERY_BLOCK = 2048  # queries sent to the tasks at a time: bounds what is broadcast
SCORE_DIGITS = 9  # scores equal to this many digits are ties, settled by id


# ── vectors ───────────────────────────────────────────────────────────────────

def query_parts(queries: DataFrame, query: str) -> Iterator[DataFrame]:
    """The queries in parts of about QUERY_BLOCK at most."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for i in range(blocks):
        yield queries.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == i) if blocks > 1 else queries


def query_blocks(queries: DataFrame, query: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """The queries as (ids, unit rows), at most about QUERY_BLOCK at a time and of one length; without a vector there is nothing to find."""
    for part in query_parts(queries.select(query, vector).filter(usable(F.col(vector))), query):
        by_length: dict[int, list] = {}
        for r in part.orderBy(query).collect():  # one bounded block
            by_length.setdefault(len(r[1]), []).append(r)
        for rows in by_length.values():
            yield [r[0] for r in rows], _unit(np.array([r[1] for r in rows], dtype=np.float64))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull())


def together(parts: list[DataFrame]) -> DataFrame:
    """Results of blocks of queries as one frame. Several are written one after the other, so that no plan holds them all."""
    if len(parts) == 1:
        return parts[0]
    folder = f"{shared_folder(parts[0].sparkSession)}/metricway-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(folder)
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(folder)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _keep_best(scores: np.ndarray, k: int) -> np.ndarray:
    """A mask of the k best rows of each column; ties go to the upper row."""
    n = scores.shape[0]
    if n <= k:
        return np.isfinite(scores)
    kth = np.partition(scores, n - k, axis=0)[n - k]
    above = scores > kth
    level = (scores == kth) & np.isfinite(scores)
    return above | (level & (np.cumsum(level, axis=0) <= k - above.sum(axis=0)))


def best_rows(held: tuple | None, part: tuple, k: int) -> tuple:
    """(queries, docs, scores) of both, the k best of each query: by score, then id."""
    q, d, s = (np.concatenate(x) for x in zip(held, part)) if held is not None else part
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    first = np.searchsorted(q, q)  # where the row's query begins
    keep = np.arange(len(q)) - first < k
    return q[keep], d[keep], s[keep]


def matrix_of(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column whose lists have one length."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def nearest(corpus: DataFrame, queries: DataFrame, k: int, doc: str = "doc_id", vector: str = "vector",
            query: str = "query_id", query_vector: str = "query_vector", where: dict | None = None) -> DataFrame:
    """query, doc, score, rank: the k best by cosine among the rows that pass the filter.

    A row without a vector, with a null in it or of another length than the query's is never a hit; a query without a vector has none.
    """
    rows = filtered(corpus, where).select(doc, vector).filter(usable(F.col(vector)))
    found = []
    for ids, matrix in query_blocks(queries, query, query_vector):
        def scores(batch: pa.RecordBatch, q: np.ndarray) -> Iterator[tuple]:
            names = batch.column(doc).to_pandas().to_numpy()
            order = np.argsort(names, kind="stable")
            values = np.round(matrix_of(batch.column(vector))[order] @ q.T, SCORE_DIGITS)
            row, col = np.nonzero(_keep_best(values, k))
            yield col, names[order][row], values[row, col]
        part = rows.filter(F.size(vector) == matrix.shape[1])
        found.append(ranked(best_of_tasks(part, queries, ids, matrix, scores, k, doc, query), k, query, doc))
    if not found:
        kinds = [f"{query} {dict(queries.dtypes)[query]}", f"{doc} {dict(corpus.dtypes)[doc]}"]
        return corpus.sparkSession.createDataFrame([], f"{', '.join(kinds)}, score double, rank int")
    return together(found)


def best_of_tasks(rows: DataFrame, queries: DataFrame, ids: list, shared: object, scores: Callable, k: int, doc: str, query: str) -> DataFrame:
    """query, doc, score: the k best of each query in each task. scores(batch, shared) gives (query numbers, docs, scores)."""
    spark, query_type, doc_type = rows.sparkSession, queries.schema[query].dataType, rows.schema[doc].dataType
    schema = pa.schema([(query, to_arrow_type(query_type)), (doc, to_arrow_type(doc_type)), ("score", pa.float64())])
    sent = spark.sparkContext.broadcast((ids, shared))  # a bounded block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, given = sent.value
        held = None
        for batch in batches:
            if batch.num_rows:
                for part in scores(batch, given):
                    held = best_rows(held, part, k)
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in held[0]], schema.field(0).type),
                                              pa.array(held[1], schema.field(1).type), pa.array(held[2], pa.float64())], schema=schema)

    return rows.mapInArrow(run, StructType([StructField(query, query_type), StructField(doc, doc_type), StructField("score", DoubleType())]))


def shortened(score: Column) -> Column:
    """A score of 0 or more at SCORE_DIGITS digits, without the decimal arithmetic of round()."""
    return F.floor(score * 10.0 ** SCORE_DIGITS + 0.5) / 10.0 ** SCORE_DIGITS


def ranked(hits: DataFrame, k: int, query: str, doc: str) -> DataFrame:
    """Adds rank by score then id, and keeps the first k of each query."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine to one query as a plain expression."""
    unit = _unit(np.array([query], dtype=np.float64))[0].tolist()
    q = F.array(*map(F.lit, unit))
    zero = F.lit(0.0)

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, v: s + v)

    return F.coalesce(F.try_divide(dot(vector, q), F.sqrt(dot(vector, vector))), F.lit(0.0))


def search_one(corpus: DataFrame, query: list[float], k: int, doc: str = "doc_id", vector: str = "vector",
               where: dict | None = None) -> DataFrame:
    """The k nearest of one query: a filter, an expression, and Spark's own top-k."""
    return filtered(corpus, where).filter(F.col(vector).isNotNull()).select("*", F.round(cosine(F.col(vector), query), SCORE_DIGITS).alias(
        "score")).orderBy(F.desc("score"), doc).limit(k)


def lookup(corpus: DataFrame, value, doc: str = "doc_id") -> DataFrame:
    """The row with that id, score 1; never semantic. The filter reaches the scan."""
    return corpus.filter(F.col(doc) == F.lit(value)).limit(1).withColumn("score", F.lit(1.0))


# ── BM25 ──────────────────────────────────────────────────────────────────────

def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_A_TOKEN), lambda t: t != "")


class TextIndex:
    """Word counts of documents, made on the fly or read from a folder.

    Counts are rows (term, doc, length, tf); the row with an empty term stands for the document
    itself, so one pass over the texts gives the postings and the lengths.
    """

    def __init__(self, doc: str = "doc_id"):
        self.doc = doc
        self._docs: DataFrame | None = None
        self._stored: DataFrame | None = None
        self._lengths: DataFrame | None = None
        self._buckets = 0

    @classmethod
    def over(cls, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> "TextIndex":
        index = cls(doc)
        index._docs = docs.select(doc, F.coalesce(F.col(text), F.lit("")).alias("text"))  # a null text has no words
        return index

    def _counts(self, terms: DataFrame | None = None) -> DataFrame:
        """Counted inside each task first: a word said a thousand times in a text is one row."""
        said = spread(self._docs).select(self.doc, tokens(F.col("text")).alias("t"))
        # The outer form keeps the optimizer from splitting every text twice to test for emptiness.
        rows = said.select(self.doc, F.size("t").alias("length"), F.explode_outer(
            F.concat(F.array(F.lit("")), "t")).alias("term"))
        if terms is not None:
            rows = rows.join(sized(terms.unionByName(terms.select(F.lit("").alias("term")).limit(1))), "term")
        return rows.groupBy("term", self.doc, "length").agg(F.count("*").alias("tf"))

    def counts_of(self, terms: DataFrame) -> DataFrame:
        """The counts of the given distinct terms, and every document's own row.

        They are read several times (totals, holders, scores), so the texts are counted once and
        the small result is written down.
        """
        if self._stored is None:
            return written(self._counts(terms))
        wanted = terms.withColumn("bucket", _term_bucket(self._buckets))
        own = self._lengths.select(F.lit("").alias("term"), self.doc, "length", F.lit(1).cast("long").alias("tf"))
        return self._stored.join(wanted, ["bucket", "term"]).select("term", self.doc, "length", "tf").unionByName(own)

    def write(self, folder: str, buckets: int = 64) -> "TextIndex":
        """Store the counts by term bucket, so a search reads only its own terms' folders."""
        counts = self._counts().withColumn("bucket", _term_bucket(buckets))
        part = F.xxhash64(self.doc)  # a hot term is cut by document
        counts.filter("term <> ''").repartitionByRange("bucket", "term", part).sortWithinPartitions("bucket", "term").write.mode(
            "overwrite").partitionBy("bucket").parquet(f"{folder}/counts")
        lengths = self._docs.select(self.doc, F.regexp_count(F.lower("text"), F.lit(TOKEN)).alias("length"))
        lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
        return TextIndex.read(self._docs.sparkSession, folder, buckets, self.doc)

    @classmethod
    def read(cls, spark, folder: str, buckets: int = 64, doc: str = "doc_id") -> "TextIndex":
        index = cls(doc)
        index._stored = spark.read.parquet(f"{folder}/counts")
        index._lengths = spark.read.parquet(f"{folder}/lengths")
        index._buckets = buckets
        return index


def _term_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def bm25(index: TextIndex, queries: DataFrame, query: str = "query_id", text: str = "query") -> DataFrame:
    """query, doc, bm25 for every document that shares a term with the query.

    Counts are brought together by document before they are scored, so the pairs of queries and
    documents are summed where they are made and never shuffled.
    """
    wanted = queries.select(query, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    counts = index.counts_of(wanted.select("term").distinct())
    totals = counts.filter("term = ''").agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    docs, mean = totals.select("docs").scalar(), totals.select("mean").scalar()
    holders = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = wanted.join(holders, "term").select(query, "term", idf.alias("idf"))
    tf = F.col("tf")
    part = (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / mean))).alias("part")
    scored = counts.repartition(index.doc).select("term", index.doc, part).join(sized(weights), "term")
    return scored.groupBy(query, index.doc).agg(F.sum(F.col("idf") * F.col("part")).alias("bm25"))


def text_search(index: TextIndex, queries: DataFrame, k: int, query: str = "query_id", text: str = "query",
                allowed: DataFrame | None = None) -> DataFrame:
    """The k best by BM25; the top hit of a query scores 1 and the rest are relative to it.

    `allowed` (ids that pass a filter) narrows the hits before the top k is taken.
    """
    hits = bm25(index, queries, query, text)
    if allowed is not None:
        hits = hits.join(allowed.select(index.doc), index.doc, "left_semi")
    top = ranked(hits.withColumn("score", shortened(F.col("bm25"))), k, query, index.doc)
    best = F.max("score").over(Window.partitionBy(query))  # k rows a query
    return top.withColumn("score", F.when(best > 0, F.col("score") / best).otherwise(0.0)).drop("bm25")


# ── hybrid ────────────────────────────────────────────────────────────────────

def fuse_ranks(a: DataFrame, b: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of two ranked lists, 1 for a document first in both."""
    both = a.select(query, doc, F.col("rank").alias("ra")).join(
        b.select(query, doc, F.col("rank").alias("rb")), [query, doc], "full_outer")
    gain = sum((F.coalesce(F.lit(1.0) / (RRF_K + F.col(r)), F.lit(0.0)) for r in ("ra", "rb")), F.lit(0.0))
    return ranked(both.select(query, doc, shortened(gain / (2.0 / (RRF_K + 1))).alias("score")), k, query, doc)


def blend_scores(vector_hits: DataFrame, text_hits: DataFrame, k: int, alpha: float = ALPHA,
                 query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """alpha x vector score + (1 - alpha) x text score; a missing side counts 0."""
    both = vector_hits.select(query, doc, F.col("score").alias("sv")).join(
        text_hits.select(query, doc, F.col("score").alias("st")), [query, doc], "full_outer")
    score = alpha * F.coalesce("sv", F.lit(0.0)) + (1 - alpha) * F.coalesce("st", F.lit(0.0))
    return ranked(both.select(query, doc, F.round(score, SCORE_DIGITS).alias("score")), k, query, doc)


# ── around the hits ───────────────────────────────────────────────────────────

def hydrated(hits: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Hits with their stored metadata; survey columns join it only where there is a survey."""
    meta = F.col("metadata")
    for name in ("csat_score", "surveyed_at"):
        if name in docs.columns:
            extra = F.when(F.col(name).isNotNull(), F.create_map(F.lit(name), F.col(name).cast("string"))).otherwise(
                F.create_map().cast("map<string,string>"))
            meta = F.map_concat(meta, extra)
    return hits.join(docs.withColumn("metadata", meta).select(doc, "metadata"), doc)


def sample_statement(hits: DataFrame, corpus: DataFrame, query: str = "query_id", where: dict | None = None) -> DataFrame:
    """query, category, got, total, place: "got of total calls in category", most hits first.

    Totals are of what could have been hit: with the search's own filter, such as a survey score, they count only what passes it.
    """
    totals = filtered(corpus, where).groupBy(F.col("category").alias("_of")).agg(F.count("*").alias("total"))
    got = hits.groupBy(query, "category").agg(F.count("*").alias("got"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("got"), F.col("category").cast("string")))
    return got.join(totals, F.col("category").eqNullSafe(F.col("_of")), "left").select(
        query, "category", "got", "total", place.alias("place"))

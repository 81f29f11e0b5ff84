"""Partitioned approximate search: k-means cells, probe the nearest few, score exactly.

A query meets the rows of its cells alone: each task joins its rows to a block of queries on the cell, one matrix product for each
cell and the queries that probe it. Rows are stored sorted by cell, so a cell that nobody probes is not read, and they stay where
they are; a crowded cell lies in several tasks.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricway.functions.where import filtered
from metricway.operators.search import (SCORE_DIGITS, _keep_best, _unit, best_of_tasks, matrix_of, nearest, query_blocks, ranked,
                                        together, usable)

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

# Cells probed; recall slack.
DEFAULT_PROBES = 20
ROW_GROUP = 8 << 20  # bytes
RECALL_SLACK = 1e-5


class CellIndex:
    """Rows with the k-means cell of their unit vector, and the cells' centres."""

    def __init__(self, rows: DataFrame, centres: np.ndarray, doc: str, vector: str):
        self.rows, self.centres, self.doc, self.vector = rows, centres, doc, vector

    @classmethod
    def build(cls, corpus: DataFrame, doc: str = "doc_id", vector: str = "vector", cells: int | None = None,
              seed: int = 42, iterations: int = 8, train_rows: int | None = None) -> "CellIndex":
        """sqrt(n) cells, fitted on all rows, or on about train_rows of them if asked; every row is assigned and searched."""
        corpus = corpus.filter(usable(F.col(vector)))
        n = corpus.count()
        cells = cells or max(1, round(math.sqrt(n)))
        raw = corpus.withColumn("_raw", array_to_vector(F.col(vector)))
        unit = Normalizer(inputCol="_raw", outputCol="_unit", p=2.0).transform(raw).drop("_raw")
        train = unit.select("_unit")
        if train_rows and train_rows < n:
            train = train.sample(train_rows / n, seed)
        model = KMeans(k=cells, seed=seed, maxIter=iterations, featuresCol="_unit", predictionCol="cell",
                       initMode="random").fit(train)
        rows = model.transform(unit).drop("_unit")
        return cls(rows, np.array(model.clusterCenters()), doc, vector)

    def write(self, folder: str) -> "CellIndex":
        """Store the rows sorted by cell: the row groups' ranges let a probe skip the others. Ranges
        are cut by (cell, hash), so a crowded cell is written by several tasks."""
        at = F.xxhash64(self.doc)
        self.rows.repartitionByRange("cell", at).sortWithinPartitions("cell").write.mode("overwrite").option(
            "parquet.block.size", str(ROW_GROUP)).parquet(f"{folder}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "cell int, centre array<double>"
                              ).write.mode("overwrite").parquet(f"{folder}/centres")
        return CellIndex.read(spark, folder, self.doc, self.vector)

    @classmethod
    def read(cls, spark, folder: str, doc: str = "doc_id", vector: str = "vector") -> "CellIndex":
        centres = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()  # sqrt(n) rows
        return cls(spark.read.parquet(f"{folder}/rows"), np.array([r.centre for r in centres]), doc, vector)

    def search(self, queries: DataFrame, k: int, probes: int = DEFAULT_PROBES, query: str = "query_id",
               query_vector: str = "query_vector", where: dict | None = None) -> DataFrame:
        """Like `nearest`, over the rows of each query's `probes` nearest cells."""
        found = []
        centres = _unit(self.centres)
        doc, vector = self.doc, self.vector
        for ids, matrix in query_blocks(queries, query, query_vector):
            near = np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :probes]  # of a bounded block
            asked: dict[int, list[int]] = {}
            for i, cells in enumerate(near):
                for c in cells:
                    asked.setdefault(int(c), []).append(i)
            rows = filtered(self.rows, where).filter(F.size(vector) == matrix.shape[1]).select(doc, vector, "cell")
            if len(asked) < len(self.centres):
                rows = rows.filter(F.col("cell").isin(sorted(asked)))

            def scores(batch: pa.RecordBatch, shared: tuple) -> Iterator[tuple]:
                wanted, q = shared
                names, cells = batch.column(doc).to_pandas().to_numpy(), batch.column("cell").to_numpy()
                order = np.lexsort((names, cells))
                names, cells, values = names[order], cells[order], matrix_of(batch.column(vector))[order]
                starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
                parts = []
                for low, high in zip(starts, [*starts[1:], len(cells)]):
                    own = np.array(wanted.get(int(cells[low]), []), dtype=np.int64)
                    if len(own):
                        met = np.round(values[low:high] @ q[own].T, SCORE_DIGITS)
                        row, col = np.nonzero(_keep_best(met, k))
                        parts.append((own[col], names[low:high][row], met[row, col]))
                if parts:
                    yield tuple(np.concatenate(x) for x in zip(*parts))

            hits = best_of_tasks(rows, queries, ids, (asked, matrix), scores, k, doc, query)
            found.append(ranked(hits, k, query, doc))
        return together(found) if found else nearest(self.rows, queries, k, doc, vector, query, query_vector)


def refined(candidates: DataFrame, corpus: DataFrame, queries: DataFrame, k: int, doc: str = "doc_id",
            vector: str = "vector", query: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """The candidates of a coarse search scored again exactly, the best k kept."""
    rows = candidates.select(query, doc).join(corpus.select(doc, vector), doc).join(
        queries.select(query, query_vector), query)

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                           lambda s, x: s + x)

    norms = F.sqrt(dot(vector, vector) * dot(query_vector, query_vector))
    score = F.coalesce(F.try_divide(dot(vector, query_vector), norms), F.lit(0.0))  # a zero vector is like nothing
    return ranked(rows.select(query, doc, F.round(score, SCORE_DIGITS).alias("score")), k, query, doc)


def ann_recall(hits: DataFrame, exact: DataFrame, allowed: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """query, recall: hits whose true cosine reaches the exact k-th best, over min(k, rows allowed).

    `hits` and `exact` carry true cosines as score; `allowed` is one row, n.
    """
    kth = exact.filter(F.col("rank") <= k).groupBy(query).agg(F.min("score").alias("kth"))
    good = kth.join(hits.filter(F.col("rank") <= k), query, "left").groupBy(query).agg(
        F.count_if(F.col("score") >= F.col("kth") - RECALL_SLACK).alias("good"))
    base = F.least(F.lit(k), allowed.select("n").scalar())
    return good.select(query, (F.least("good", F.lit(k)) / base).alias("recall"))

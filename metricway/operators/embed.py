"""Embeddings: the slot for a model, reuse of stored vectors, and a hashed test embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricway.operators.search import tokens

# Dimension of the hashed embedding, noise size of replicas, replica id mark.
HASH_DIM = 64
JITTER = 0.05
REPLICA_MARK = "~r"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def hashed_bag_of_words(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, vector: word counts by the MD5 of each word modulo 64, to unit length; a text without a word has a zero vector."""
    words = docs.select(doc, F.explode_outer(tokens(F.coalesce(F.col(text), F.lit("")))).alias("word"))
    bucket = F.conv(F.substring(F.md5("word"), 31, 2), 16, 10).cast("int") % HASH_DIM  # 64 divides 256
    counts = words.groupBy(doc, bucket.alias("bucket")).agg(F.count("word").cast("double").alias("n"))
    slots = counts.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.when(
        F.col("bucket").isNotNull(), F.struct("bucket", "n")))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(HASH_DIM - 1)), lambda i: (
        F.coalesce(F.try_element_at("m", i) / F.nullif(F.col("norm"), F.lit(0.0)), F.lit(0.0))).cast("float"))
    return slots.select(doc, vector.alias("vector"))


def embedder(model: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A model taking a list of texts, as an Arrow-batched column function."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype=np.float32) for v in model(texts.tolist())])
    return embed


def embed_new(docs: DataFrame, store: DataFrame, model_name: str, embed: Callable[[Column], Column]) -> DataFrame:
    """docs (call_id, text) with vector and provenance. A stored vector is taken only when id,
    text hash and model all agree; each remaining distinct text is embedded once."""
    hashed = docs.withColumn("content_hash", content_hash(F.col("text"))).withColumn(
        "embedding_model", F.lit(model_name))
    on = ["call_id", "content_hash", "embedding_model"]
    known = store.select(*on, "vector").filter("vector IS NOT NULL").dropDuplicates(on)
    kept = hashed.join(known, on)
    rest = hashed.join(known, on, "left_anti")
    fresh = rest.dropDuplicates(["content_hash"]).select("content_hash", embed(F.col("text")).alias("vector"))
    columns = [*docs.columns, "content_hash", "embedding_model", "vector"]
    return kept.select(*columns).withColumn("reused", F.lit(True)).unionByName(
        rest.join(fresh, "content_hash").select(*columns).withColumn("reused", F.lit(False)))


def other_model_rows(store: DataFrame, batch: DataFrame, model_name: str) -> DataFrame:
    """Stored rows of another or unknown model that the batch would leave behind: must be empty
    before a model may change."""
    other = store.filter(F.col("embedding_model").isNull() | (F.col("embedding_model") != model_name))
    return other.select("call_id", "embedding_model").join(batch.select("call_id"), "call_id", "left_anti")


def require_one_model(store: DataFrame, batch: DataFrame, model_name: str) -> None:
    left = other_model_rows(store, batch, model_name).limit(5).collect()
    if left:
        raise ValueError(f"rows of another model would stay: {[r.call_id for r in left]}")


# ── scaled-up corpora for benchmarks ──────────────────────────────────────────

def replica_id(name: Column, replica: Column) -> Column:
    return F.when(replica == 0, name).otherwise(F.format_string(f"%s{REPLICA_MARK}%03d", name, replica))


def scale_up(docs: DataFrame, copies: int, doc: str = "call_id") -> DataFrame:
    """`copies` of each document under new ids; `replica` 0 is the document itself."""
    if copies < 1:
        raise ValueError("at least one copy")
    return docs.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn(
        "source_id", F.col(doc).cast("string")).withColumn(doc, replica_id(F.col(doc).cast("string"), F.col("replica")))


def scaled_relevant(relevant: Column, copies: int) -> Column:
    """A relevant list extended by all copies, copy by copy."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)),
                                 lambda r: F.transform(relevant, lambda c: replica_id(c, r))))


def jittered(docs: DataFrame, vector: str = "vector", text: str = "text", replica: str = "replica",
             eps: float = JITTER) -> DataFrame:
    """Copies get seeded noise of size eps and unit length again; copy 0 stays as it is.

    The seed is the SHA-256 of (copy number, text): the same on every run and executor.
    """
    seed = F.sha2(F.concat(F.col(replica).cast("string"), F.lit("\u0000"), F.col(text)), 256)

    @F.pandas_udf("array<float>")
    def shake(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, numbers, seeds in batches:
            out = []
            for v, n, s in zip(vectors, numbers, seeds):
                v = np.asarray(v, dtype=np.float64)
                if n:
                    v = v / (np.linalg.norm(v) or 1.0)
                    v = v + eps * np.random.default_rng(int(s[:16], 16)).standard_normal(len(v)) / np.sqrt(len(v))
                    v = v / np.linalg.norm(v)
                out.append(v.astype(np.float32))
            yield pd.Series(out)

    return docs.withColumn(vector, shake(F.col(vector), F.col(replica), seed))

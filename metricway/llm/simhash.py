"""SimHash: weighted term hashes vote on 64 signed bits; permuted block tables find near fingerprints.

A term is a word with the word after it, so that order counts and common words alone do not make texts
alike; its weight is its length in code points and it votes once for every occurrence. Two bits share one
sum (32 bits each), so a text costs 32 sums, all in one aggregation that combines map-side. A bit is set if over
half of the weight votes for it.

Search: the 64 bits are cut in radius + EXTRA blocks. Two fingerprints within the radius agree in at
least EXTRA whole blocks, so a table for each choice of EXTRA blocks, keyed by their bits, meets every such
pair; what meets is checked by its exact distance. Equal fingerprints are counted before, so copies meet as one.

Defined cases: a null or wordless text has fingerprint 0; equal texts have equal fingerprints; rows
equal in id and text are one document; of rows with one id and different texts, the lowest text is what
the document before is continued with; the document after the last is the first, which may be itself;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metricway.llm.common import written
from metricway.llm.rules import words_of

BITS = 64
HALF = 32
PAIR = (1 << HALF) | 1
EXTRA = 3


def terms(text: Column) -> Column:
    """(h, w) of every pair of following words; the last word stands alone."""
    words = words_of(text)
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(
        F.xxhash64(a, b).alias("h"), (F.length(a) + F.coalesce(F.length(b), F.lit(0))).cast("long").alias("w")))


def fingerprints(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, fingerprint long): one row for each distinct keys, over all the terms of their texts."""
    votes = rows.select(*keys, F.explode_outer(terms(F.col(text))).alias("t")).select(
        *keys, F.coalesce("t.h", F.lit(0)).alias("h"), F.coalesce("t.w", F.lit(0)).alias("w"))
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(PAIR)) * F.col("w")).alias(f"s{j}")
             for j in range(HALF)]
    sums = votes.groupBy(*keys).agg(F.sum("w").alias("all"), *lanes)
    bits = F.lit(0).cast("long")
    for j in range(HALF):
        low = F.col(f"s{j}").bitwiseAND(F.lit((1 << HALF) - 1))
        high = F.shiftrightunsigned(f"s{j}", HALF)
        for place, count in ((j, low), (j + HALF, high)):
            one = 1 << place if place < BITS - 1 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(2 * count > F.col("all"), F.lit(one)).otherwise(F.lit(0)).cast("long"))
    return sums.select(*keys, bits.alias("fingerprint"))


def hexed(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def blocks(count: int) -> list[int]:
    """Masks of near-equal blocks that cover the 64 bits."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [sum(1 << j for j in range(a, b)) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def keyed(fps: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint in the table of every choice of blocks: (table, key, ...)."""
    masks = [_signed(sum(c)) for c in combinations(blocks(radius + EXTRA), EXTRA)]
    pairs = F.array(*(F.struct(F.lit(i).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key"))
                      for i, m in enumerate(masks)))
    return fps.select("*", F.explode(pairs).alias("k")).select("k.table", "k.key", *fps.columns)


def within(queries: DataFrame, corpus: DataFrame, radius: int) -> DataFrame:
    """(query, fingerprint, distance) for all distinct fingerprints of the corpus within the radius of one of queries."""
    asked = keyed(queries.select("fingerprint").distinct(), radius).withColumnRenamed("fingerprint", "query")
    stored = keyed(corpus.select("fingerprint").distinct(), radius)
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    return (asked.join(stored, ["table", "key"]).filter(distance <= radius)
            .select("query", "fingerprint", distance.alias("distance")).distinct())


def following(ids: DataFrame, key: str) -> DataFrame:
    """The rows of unique keys with `next_<key>` and `before_<key>` in ascending order, the last followed by the first.

    Keys are dealt in ranges and written; inside a range a window looks ahead, and only the ends of the ranges,
    a row for each task, meet on the driver.
    """
    spark = ids.sparkSession
    ranged = written(ids.repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    ends = sorted(ranged.groupBy("part").agg(F.min(key), F.max(key)).collect())
    rows = [(p[0], ends[(i + 1) % len(ends)][1], ends[i - 1][2]) for i, p in enumerate(ends)]
    edges = spark.createDataFrame(rows, "part int, first_after long, last_before long")
    order = Window.partitionBy("part").orderBy(key)
    own = [F.col(f"`{c}`") for c in ids.columns]
    return (ranged.join(F.broadcast(edges), "part")  # a row for each task
            .select(*own, F.coalesce(F.lead(key).over(order), "first_after").alias(f"next_{key}"),
                    F.coalesce(F.lag(key).over(order), "last_before").alias(f"before_{key}")))


def edited(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, next_id, n_chars, text, edited): the last quarter replaced by the next document's first code points.

    Texts are exchanged once, by id. The join of ids with their neighbours and texts is read twice: whole,
    and cut to what the document before it needs; only those heads move again.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = written(rows.groupBy("doc_id").agg(F.max(F.length("text")).alias("chars")))
    near = written(following(sizes.select("doc_id"), "doc_id"))
    known = near.join(sizes.select(F.col("doc_id").alias("before_doc_id"), F.col("chars").alias("before_chars")),
                      "before_doc_id")
    known = written(known.select("doc_id", "next_doc_id", "before_doc_id",
                                 F.expr("before_chars DIV 4").cast("int").alias("wanted")))
    placed = rows.join(known, "doc_id")
    heads = placed.groupBy(F.col("before_doc_id").alias("doc_id")).agg(
        F.min(F.substring("text", F.lit(1), F.col("wanted"))).alias("head"))
    n = F.length("text")
    cut = F.expr("length(text) DIV 4").cast("int")
    return placed.join(heads, "doc_id").select(
        "doc_id", F.col("next_doc_id").alias("next_id"), n.cast("long").alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring("head", F.lit(1), cut)).alias("edited"))

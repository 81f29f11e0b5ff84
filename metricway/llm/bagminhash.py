"""Near-duplicate texts by BagMinHash: signatures of weighted Jaccard, bands, exact check of multiset overlap.

A text is the multiset of its shingles of five words. Every shingle is a Poisson process over time and weight: weights are
discretised to whole copies and grouped in octaves [0, 1), [1, 2), [2, 4), [4, 8) ... Each octave is one process at the
rate of its width, whose points carry a register and a place in the octave; points at or above the text's weight are
thinned out. So a shingle of weight w costs log w processes, at least half the points count, and texts share exactly
the points below the lesser weight: a register's first point agrees with the probability of the weighted Jaccard. A process
is followed only while its time is below the text's highest register.

Texts that agree in a band of registers meet in a bucket and are linked by the exact overlap of their multisets, as `linking`
says: a group of copies costs its size, and no pair of a bucket that could join two components goes unmeasured.

Defined cases: null and empty texts and texts without a word have no shingle and are alike only when equal; a text of
under five words is one shingle; equal texts are one node whatever their number; rows with equal ids are rows of their own; a
class is named by its least id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricway.llm import linking
from metricway.llm.common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5  # a pair at 0.8 is missed with probability (1 - 0.8 ** 5) ** 25 = 5e-5
BLOCK = 200_000  # shingles whose processes are followed together
KEPT_WORDS = 300_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to (distinct shingle hashes in order, their weights)."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        own, known = WORD.findall(text or ""), self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        ids = list(map(known.get, own))
        if None in ids:
            for i, h in enumerate(ids):
                if h is None:
                    ids[i] = known[own[i]] = xxhash.xxh64_intdigest(own[i])
        h = np.array(ids, dtype=np.uint64)
        if not len(h):
            return h, np.zeros(0, np.int64)
        size = min(WORDS, len(h))
        rolled = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + h[i: len(h) - size + 1 + i])
        return np.unique(rolled, return_counts=True)


def signatures(hashes: np.ndarray, weights: np.ndarray, text: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """(texts, registers) times of first points; text: to which text each shingle belongs. No shingle: infinity."""
    first = np.full((texts, registers), np.inf)
    flat = first.reshape(-1)
    octave, low = 0, 0
    processes = []
    while True:
        width = 1 if octave == 0 else 1 << (octave - 1)
        in_reach = weights > low
        if not in_reach.any():
            break
        at = np.flatnonzero(in_reach)
        processes.append((text[at], mixed(hashes[at] + np.uint64((octave + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)),
                          np.full(len(at), width, np.int64), weights[at] - low))
        low, octave = low + width, octave + 1
    if not processes:
        return first
    owner, state, width, reach = (np.concatenate(x) for x in zip(*processes))
    time = np.zeros(len(owner))
    while len(owner):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        draw = mixed(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / width
        alive = time < first.max(axis=1)[owner]
        owner, state, width, reach, time, draw = (x[alive] for x in (owner, state, width, reach, time, draw))
        draw = mixed(draw)
        place = ((draw >> np.uint64(32)) * width.astype(np.uint64)) >> np.uint64(32)
        counts = place.astype(np.int64) < reach
        register = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(registers)) >> np.uint64(32)
        np.minimum.at(flat, owner[counts] * registers + register[counts].astype(np.int64), time[counts])
    return first


def bands_of(first: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys as signed longs."""
    bits = first.view(np.uint64).reshape(len(first), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(first), BANDS)).copy()
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return key.view(np.int64)


def signed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, text_key, text_check, weight, bands): written rows, one for each of the documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", *keys("text"), F.col("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            weights, bands = [], []
            own: list[tuple[np.ndarray, np.ndarray]] = []

            def flush():
                if not own:
                    return
                hashes, times = np.concatenate([o[0] for o in own]), np.concatenate([o[1] for o in own])
                text = np.repeat(np.arange(len(own)), [len(o[0]) for o in own])
                found = bands_of(signatures(hashes, times, text, len(own), BANDS * ROWS))
                bands.extend(list(f) if len(o[0]) else [] for f, o in zip(found, own))
                weights.extend(int(o[1].sum()) for o in own)
                own.clear()

            size = 0
            for body in batch.column(3).to_pylist():
                own.append(shingler(body))
                size += len(own[-1][0])
                if size >= BLOCK:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64()),
                                              pa.array(bands, pa.list_(pa.int64()))],
                                             ["doc_id", "text_key", "text_check", "weight", "bands"])

    out = rows.mapInArrow(sign, "doc_id long, text_key long, text_check long, weight long, bands array<long>")
    return written(out.withColumn("row", F.monotonically_increasing_id()))


def keys(text: str) -> list[Column]:
    """What tells texts apart: two hashes and the length in 128 bits."""
    return [F.xxhash64(text).alias("text_key"),
            F.coalesce(F.crc32(F.col(text).cast("binary")) * F.lit(1 << 31) + F.pmod(F.octet_length(text), F.lit((1 << 31) - 1)),
                       F.lit(-1)).cast("long").alias("text_check")]


def buckets(nodes: DataFrame) -> DataFrame:
    """The members of all bands that two texts share."""
    return linking.buckets(nodes.select(F.col("row").alias("id"), F.explode("bands").alias("key")),
                           nodes.select(F.col("row").alias("id"), F.col("weight").alias("size")))


def overlaps(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, distance, linked) of pairs by the exact overlap of their multisets. texts: (row, text)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, one = Shingler(), None, None
        for batch in batches:
            distances, linked = [], []
            for a, body_a, body_b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if a != last:
                    last, one = a, shingler(body_a)
                other = shingler(body_b)
                _, i, j = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
                common = int(np.minimum(one[1][i], other[1][j]).sum())
                whole = int(one[1].sum()) + int(other[1].sum()) - common
                distances.append(1 - common / max(whole, 1))
                linked.append(common >= similarity * whole)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(distances, pa.float64()), pa.array(linked, pa.bool_())],
                                             ["a", "b", "distance", "linked"])

    with_b = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, distance double, linked boolean")


def linked(members: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of all rows that a band and the exact overlap link to another."""
    return linking.linked(members, lambda pairs: overlaps(pairs, texts, similarity), similarity)


def placed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(row, doc_id, text_key, text_check, component): written, a row for each of the documents."""
    rows = signed(docs, id_col, text)
    same = ["text_key", "text_check"]
    nodes = written(rows.groupBy(*same).agg(F.min(F.struct("row", "doc_id", "weight", "bands")).alias("v"))
                    .select(*same, "v.row", F.col("v.doc_id").alias("node_doc"), "v.weight", "v.bands"))
    members = buckets(nodes)
    wanted = members.select(F.col("id").alias("row")).distinct().join(nodes.select("row", "node_doc", *same), "row")
    texts = docs.select(F.col(id_col).cast("long").alias("node_doc"), F.col(text).alias("text")).select(
        "node_doc", *keys("text"), "text")
    match = reduce(and_, (texts[c].eqNullSafe(wanted[c]) for c in ("node_doc", *same)))  # ids may be null
    texts = written(texts.join(wanted, match).select("row", "text").dropDuplicates(["row"]))
    found = linked(members, texts, similarity)
    named = nodes.select(*same, F.col("row").alias("node")).join(found, "node", "left").select(
        *same, F.coalesce("component", "node").alias("component"))
    return written(rows.select("row", "doc_id", *same).join(named, same).select("row", "doc_id", *same, "component"))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size, kept) for every row: classes of texts linked by overlap, and the one row to keep.

    Kept is the row of the least id; of rows with that id, the first.
    """
    rows = placed(docs, id_col, text, similarity)
    heads = rows.groupBy("component").agg(
        F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("class_size"))
    return rows.join(heads, "component").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, one of each class: that of the least id, once even where rows repeat."""
    rows = placed(docs, id_col, text, similarity)
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_key", "text_check")).alias("v")).select(
        F.col("v.doc_id").alias("_doc"), F.col("v.text_key").alias("_key"), F.col("v.text_check").alias("_check"))
    key, check = keys(text)
    own = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.select(*own, F.col(id_col).cast("long").alias("_doc"), key.alias("_key"), check.alias("_check"))
    return kept.join(first, (kept["_doc"].eqNullSafe(first["_doc"])) & kept["_key"].eqNullSafe(first["_key"])
                     & kept["_check"].eqNullSafe(first["_check"]), "left_semi").dropDuplicates(
                         ["_doc", "_key", "_check"]).select(*docs.columns)

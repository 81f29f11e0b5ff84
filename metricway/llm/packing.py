"""Packing: documents cut into pieces, pieces joined to windows by multiway differencing.

Every document becomes token ids and an end id. Whole windows are cut off its front; the rest is cut into
halves, quarters and so on of a window, down to `least`. Pieces are dealt by a hash into bins of about `windows` windows; in a bin, Karmarkar-Karp
differencing keeps partial partitions of sorted loads and merges the two of largest spread with opposing orders, so
that heavy loads meet light ones, until one partition is left. If its largest load is over the capacity, the bin
gets one window more and is packed again. The number of bins grows with the tokens, so a task holds a
bounded number of pieces and no window meets the driver.

Ids come from the byte-pair ranks of the public vocabulary, which give the ids of the named tokenizer file; chunks of
a text between single spaces and line feeds are encoded once and kept in a bounded table of each task.

Defined cases: a null or empty text is its end id alone; repeated rows are packed as often as they occur; ties are
settled by document, start and checksum; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricway.llm.common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

CAPACITY = 1024
LEAST = 64
WINDOWS = 64
END_ID = 0
KEPT_CHUNKS = 400_000
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"


def vocabulary(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to little-endian 32-bit ids, by ranks and pattern of the public byte-level vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={SPECIAL: len(ranks)})
        self.bare: dict[str, bytes] = {}  # words at the start of a line
        self.spaced: dict[str, bytes] = {}  # words behind a space
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        ids = self.encoding.encode(text, allowed_special="all") if SPECIAL in text else self.encoding.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def words(self, known: dict[str, bytes], chunks: list[str], before: str) -> list[bytes] | None:
        """Ids of chunks that each stand behind `before`; None if one has white space at an end or a special token."""
        out = list(map(known.get, chunks))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    chunk = chunks[i]
                    if not chunk or chunk[0].isspace() or chunk[-1].isspace() or SPECIAL in chunk:
                        return None
                    out[i] = self.whole(before + chunk)
                    if len(chunk) <= 32:
                        if len(known) >= KEPT_CHUNKS:
                            known.clear()
                        known[chunk] = out[i]
        return out

    def __call__(self, text: str) -> bytes:
        """The pattern starts a token at a single space or line feed between two other characters; so the
        chunks between these are encoded alone and looked up. Other texts are encoded whole."""
        lines = []
        for line in text.split("\n"):
            chunks = line.split(" ")
            first = self.words(self.bare, chunks[:1], "")
            rest = self.words(self.spaced, chunks[1:], " ") if first else None
            if rest is None:
                return self.whole(text)
            lines.append(first[0] + b"".join(rest))
        return self.newline.join(lines)


def cuts(tokens: int, capacity: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then halves, quarters and so on of a window while
    they fit, down to `least`; what is left is the last piece. Such sizes add up to whole windows."""
    out, at, size = [], 0, capacity
    while tokens - at:
        if size < least:
            size = tokens - at
        if tokens - at >= size:
            out.append((at, size))
            at += size
        else:
            size //= 2
    return out


def pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, least: int = LEAST, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids binary]) of all pieces, cut while the text is read."""
    path = path or vocabulary()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(body or "") + end
                n = len(ids) // 4
                for start, length in cuts(n, capacity, least):
                    part = ids[4 * start: 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(part), n, *([part] if keep_ids else ())))
            columns = list(zip(*rows)) or [()] * (5 + keep_ids)
            types = [pa.int64()] * 5 + [pa.binary()] * keep_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names[: len(types)])

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(cut, schema)


def differenced(sizes: list[int], ways: int) -> list[list[int]]:
    """Indices of the sizes in `ways` groups, by Karmarkar-Karp multiway differencing.

    A partial partition is its loads in falling order, less the smallest, with the groups behind them.
    """
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [size] + [0] * (ways - 1), [[i]] + [[] for _ in range(ways - 1)]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, a_groups = heapq.heappop(heap)
        _, _, b, b_groups = heapq.heappop(heap)
        loads = [x + y for x, y in zip(a, reversed(b))]
        groups = [x + y for x, y in zip(a_groups, reversed(b_groups))]
        order = sorted(range(ways), key=lambda k: -loads[k])
        least = loads[order[-1]]
        heapq.heappush(heap, (-(loads[order[0]] - least), tick, [loads[k] - least for k in order],
                              [groups[k] for k in order]))
        tick += 1
    return heap[0][3] if heap else []


def packed(sizes: list[int], capacity: int) -> list[list[int]]:
    """The groups of the fewest windows that differencing fills without exceeding the capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differenced(sizes, ways)
        if max((sum(sizes[i] for i in g) for g in groups), default=0) <= capacity:
            return [g for g in groups if g]
        ways += 1


def windows(parts: DataFrame, capacity: int = CAPACITY, per_bin: int = WINDOWS) -> DataFrame:
    """The pieces with `sequence_id` and `offset` (gapless from 0 in each sequence).

    parts: written rows of `pieces`; they are read twice. A piece of a whole window is a sequence of its own.
    """
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    total = parts.filter(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    bins = max(1, round(total / (per_bin * capacity)))
    own = ", ".join(f"{c} long" for c in columns)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        sizes = frame["length"].tolist()
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        for number, group in enumerate(packed(sizes, capacity)):
            at = 0
            for i in sorted(group):
                sequence[i], offset[i] = number, at
                at += sizes[i]
        return frame[columns].assign(sequence_id=[(int(frame["bin"].iloc[0]) << 32) + s for s in sequence], offset=offset)

    loose = parts.filter(F.col("length") < capacity).withColumn("bin", bin_of(bins))
    loose = loose.select(*columns, "bin").groupBy("bin").applyInPandas(pack, f"{own}, sequence_id long, offset long")
    # Whole windows: negative numbers of their task and row, which no bin has.
    full = parts.filter(F.col("length") == capacity).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(loose)


def bin_of(bins: int) -> Column:
    """A bin for each piece; its place in the written rows is hashed too, so that repeated rows are spread."""
    return F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(bins)).cast("long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, least: int = LEAST) -> DataFrame:
    """Texts to packed pieces: encoded once, written, and joined to windows."""
    return windows(written(pieces(docs, path, capacity=capacity, least=least)), capacity)

"""Periodic runs of words, by a suffix automaton whose last occurrences are recoloured by link-cut access.

A run is a stretch with smallest period q, at least max(12, 2 q) words long, that no neighbour extends. The suffixes of the words up to
i are a path of the automaton's link tree; each node carries the end of its last occurrence. Accessing the path in a link-cut tree
(splay trees over preferred paths, one colour each) meets it in pieces of one colour: a piece whose longest word string has `length`
words and was last seen ending at p means a square of period i - p if i - p <= length, and that period is the smallest. Recolouring the
path with i is what the access leaves behind. Each square is extended to its run once.

Every word of a run lies in six following words that occur twice in the text: of a run of period q the first length - q >= 6 words come
again q later. Words outside such six are in no run, so each task first counts hashes of six words over its whole texts, and automata are
built over the stretches that are left; they are compared word by word. Texts are rows of their own: nothing is shuffled.

Defined cases: a null or wordless text has no runs and an empty collapsed text; texts of any length, repeated rows and ties give each row
its own result; an empty table gives no rows; columns of the input are kept, and a clash with `runs` or `collapsed` is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

LEAST = 12
GRAM = LEAST // 2
BYTES = 4_000_000  # of texts taken together by a task


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix links, lengths, state of each prefix); state 0 is the root."""
    following: list[dict] = [{}]
    link, length, states, last = [-1], [0], [], 0
    for c in word:
        cur = len(link)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = cur
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(link)
                following.append(following[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        states.append(cur)
        last = cur
    return link, length, states


class LinkCut:
    """Access of a rooted tree in pieces of one colour. Node 0 is no node; parents of roots are 0."""

    def __init__(self, parent: list[int]):
        self.up = [max(p, 0) for p in parent]
        self.left, self.right = [0] * len(parent), [0] * len(parent)
        self.colour = [-1] * len(parent)  # of a preferred path, held at the root of its splay tree

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        colour = -1
        while True:
            p = up[x]
            if not p:
                break
            if left[p] == x:
                on_left = True
            elif right[p] == x:
                on_left = False
            else:
                break
            g = up[p]
            if g and left[g] == p:
                side = 1
            elif g and right[g] == p:
                side = 2
            else:
                side, colour = 0, self.colour[p]
            if side and on_left == (side == 1):  # same direction: the parent first
                if side == 1:
                    c = left[g] = right[p]
                    right[p] = g
                else:
                    c = right[g] = left[p]
                    left[p] = g
                if c:
                    up[c] = g
                h = up[g]
                up[p], up[g] = h, p
                if h and left[h] == g:
                    left[h] = p
                elif h and right[h] == g:
                    right[h] = p
                else:
                    colour = self.colour[g]
                g, side = h, -1
            if on_left:
                c = left[p] = right[x]
                right[x] = p
            else:
                c = right[p] = left[x]
                left[x] = p
            if c:
                up[c] = p
            up[x] = g
            up[p] = x
            if g:
                if left[g] == p:
                    left[g] = x
                elif right[g] == p:
                    right[g] = x
        self.colour[x] = colour

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """(deepest node, last colour) of each piece of the path from x to the root; the path then has the colour."""
        up, right, colours, out, below = self.up, self.right, self.colour, [], 0
        top = x
        while x:
            self._splay(x)
            was = colours[x]
            if was >= 0:
                out.append((x, was))
            r = right[x]
            if r:
                colours[r] = was
            right[x] = below
            below = top = x
            x = up[x]
        colours[top] = colour
        return out


def squares(word: list[int]) -> Iterator[tuple[int, int]]:
    """(last place, smallest period) of the squares that end at each place; at least one for each place and period of a run."""
    link, length, states = automaton(word)
    tree = LinkCut(link)
    for i, state in enumerate(states):
        for node, seen in tree.access(state, i):
            if i - seen <= length[node]:
                yield i, i - seen


def runs_of(words: list, low: int, high: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with squares in words[low:high], extended over all words."""
    ids: dict = {}
    part = [ids.setdefault(w, len(ids)) for w in words[low:high]]
    reached: dict[int, int] = {}  # by period, the last place of its last run
    out = []
    for i, q in squares(part):
        i += low
        if i <= reached.get(q, -1):
            continue
        first, last = i - 2 * q + 1, i
        while first > 0 and words[first - 1] == words[first - 1 + q]:
            first -= 1
        while last + 1 < len(words) and words[last + 1] == words[last + 1 - q]:
            last += 1
        reached[q] = last
        if last - first + 1 >= max(LEAST, 2 * q):
            out.append((first, last - first + 1, q))
    return out


def repeated_stretches(texts: list[list]) -> list[list[tuple[int, int]]]:
    """For each text the stretches (low, high) of words in GRAM following words whose hashes occur twice in it."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total, ends = int(sizes.sum()), np.cumsum(sizes)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if total < GRAM:
        return out
    with np.errstate(over="ignore"):
        # Hashes of this process only: equal words are equal, and a chance match only costs an automaton.
        ids = np.fromiter((hash(w) for t in texts for w in t), np.int64, total).view(np.uint64)
        text_of = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
        n = total - GRAM + 1
        grams = text_of[:n] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(GRAM):
            grams = grams * np.uint64(0xD1342543DE82EF95) + ids[k: k + n]
        grams ^= grams >> np.uint64(29)
    inside = text_of[:n] == text_of[GRAM - 1: GRAM - 1 + n]
    places = np.flatnonzero(inside)
    order = np.argsort(grams[places], kind="stable")
    ranked = grams[places][order]
    again = np.zeros(len(ranked), bool)
    same = ranked[1:] == ranked[:-1]
    again[1:] |= same
    again[:-1] |= same
    starts = np.sort(places[order[again]])
    if not len(starts):
        return out
    # Stretches of starts at most GRAM apart; texts part them too.
    owner = text_of[starts].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(starts) > GRAM) | (np.diff(owner) != 0))))
    lows, highs = starts[new], starts[np.concatenate((new[1:] - 1, [len(starts) - 1]))] + GRAM
    for low, high, t in zip(lows.tolist(), highs.tolist(), owner[new].tolist()):
        if high - low >= LEAST:
            base = int(ends[t] - sizes[t])
            out[t].append((low - base, high - base))
    return out


def _collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words outside the repetitions of every run."""
    if not runs:
        return words
    change = [0] * (len(words) + 1)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    out, depth = [], 0
    for word, step in zip(words, change):
        depth += step
        if not depth:
            out.append(word)
    return out


def found_in(texts: list[str | None]) -> tuple[list, list]:
    """(runs by start and period, collapsed text) of each text."""
    split = [(t or "").encode().split() for t in texts]  # of bytes: parts at \x20 and \x09-\x0D alone
    runs, collapsed = [], []
    for words, stretches in zip(split, repeated_stretches(split)):
        own = sorted({r for low, high in stretches for r in runs_of(words, low, high)}, key=lambda r: (r[0], r[2]))
        runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
        collapsed.append(b" ".join(_collapsed(words, own)).decode())
    return runs, collapsed


RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def with_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with `runs` and `collapsed`: the words outside all runs' repetitions, joined by one space. The text itself goes."""
    if {"runs", "collapsed"} & set(df.columns):
        raise ValueError("columns named runs or collapsed are taken")
    kept = [c for c in df.columns if c != text]
    schema = StructType([*(df.schema[c] for c in kept), *df.sparkSession.createDataFrame(
        [], f"runs {RUN}, collapsed string").schema])
    arrow = to_arrow_schema(schema)

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Slices of about BYTES bytes, so that a batch of long texts is not split all at once."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = sizes[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, before + BYTES, "right")))
            yield batch.slice(low, high - low)
            low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in parts(batch):
                runs, collapsed = found_in(piece.column(text).to_pylist())
                own = [piece.column(c).cast(arrow.field(c).type) for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(runs, arrow.field("runs").type), pa.array(collapsed, pa.string())], schema=arrow)

    return df.mapInArrow(run, schema)

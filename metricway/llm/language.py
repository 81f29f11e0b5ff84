"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations.

A language is a probability for every piece of a public vocabulary. A word's probability is the sum over all ways
to cut it into pieces, by a forward pass; a text's is the product over its words (runs of letters, in lower
case, with the vocabulary's mark of a word's start). Letters that are no piece are spelt in the vocabulary's byte
pieces, so every text has a probability. Piece probabilities are fitted by expectation-maximisation: expected
counts of a word's pieces come from a forward and a backward pass, weighted by how often the word occurs in the
language. Words are dealt by hash; only counts by language and piece, bounded by the vocabulary, meet.

Training reads at most `rows` rows of each fit, chosen by a hash of the text's id among those allowed: every row while
there are fewer. All texts are scored whole.

Defined cases: a null text or one without a letter is `und` with score 0; ties go to the first language in order;
with no labelled row every text is `und`; repeated rows are scored each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricway.llm.common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

VOCABULARY = "piece_bpe_32k.model"
START = "▁"
ROWS_PER_LANGUAGE = 3_000
ROUNDS = 3
SMOOTH = 0.05
BLOCK = 4_096
SLICE = 2_000_000
LONG = 20  # letters; far from where a product of probabilities is rounded to 0
KEPT_PREFIXES = 400_000
UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def pieces_of(path: str) -> tuple[list[str], dict[int, int]]:
    """All pieces of the vocabulary, and the places of its byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, by_byte = [], {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            by_byte[int(model.id_to_piece(i)[1:-1], 16)] = len(pieces)
            pieces.append(model.id_to_piece(i))
        elif not (model.is_control(i) or model.is_unknown(i)):
            pieces.append(model.id_to_piece(i))
    return pieces, by_byte


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


class Lattice:
    """Forward and backward passes over blocks of words for all languages at once."""

    def __init__(self, path: str):
        pieces, self.by_byte = pieces_of(path)
        self.size = len(pieces)
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))

    def arcs(self, word: str) -> list[tuple[int, int, list[int]]]:
        """(from, to, pieces) of every piece inside the marked word; a letter that is no piece is its bytes."""
        marked, out, index = START + word, [], self.index
        n = len(marked)
        for a in range(n):
            single = index.get(marked[a])
            out.append((a, a + 1, [single] if single is not None else
                        [self.by_byte[b] for b in marked[a].encode() if b in self.by_byte]))
            for b in range(a + 2, min(n, a + self.longest) + 1):
                piece = index.get(marked[a:b])
                if piece is not None:
                    out.append((a, b, [piece]))
        return out

    def batch(self, block: list[str]):
        """Arcs of the words, side by side and ordered by where they end: (word, from, to, place, pieces)."""
        rows, spelt = [], []
        for w, word in enumerate(block):
            for a, b, ids in self.arcs(word):
                rows.append((w, a, b, ids[0] if len(ids) == 1 else -1 - len(spelt)))
                if len(ids) != 1:
                    spelt.append(ids)
        return np.array(rows, dtype=np.int64).reshape(-1, 4), spelt

    def weights(self, arcs: np.ndarray, spelt: list[list[int]], model: np.ndarray) -> np.ndarray:
        """(arcs, languages) logarithms of the pieces' probabilities."""
        own = arcs[:, 3]
        out = model[:, np.maximum(own, 0)].T.copy()
        for i in np.flatnonzero(own < 0):
            out[i] = model[:, spelt[-1 - own[i]]].sum(axis=1)
        return out

    @staticmethod
    def _sweep(arcs: np.ndarray, logs: np.ndarray, shape: tuple[int, int], forward: bool):
        """An empty grid of places, and the arcs in the order of the place they reach."""
        word, start, stop = arcs[:, 0], arcs[:, 1], arcs[:, 2]
        reach, taken = (stop, start) if forward else (start, stop)
        table = np.full((*shape, logs.shape[1]), -np.inf)
        order = np.argsort(reach, kind="stable")
        bounds = np.searchsorted(reach[order], np.arange(shape[1] + 1))
        return table, word, taken, order, bounds

    def forward(self, arcs, logs, lengths: np.ndarray) -> np.ndarray:
        """(words, places, languages)"""
        shape = (len(lengths), int(lengths.max()) + 1)
        table, word, taken, order, bounds = self._sweep(arcs, logs, shape, True)
        table[:, 0] = 0.0
        for place in range(1, shape[1]):
            own = order[bounds[place]: bounds[place + 1]]
            if len(own):
                values = table[word[own], taken[own]] + logs[own]
                self._gather(table[:, place], word[own], values)
        return table

    def backward(self, arcs, logs, lengths: np.ndarray) -> np.ndarray:
        shape = (len(lengths), int(lengths.max()) + 1)
        table, word, taken, order, bounds = self._sweep(arcs, logs, shape, False)
        table[np.arange(len(lengths)), lengths] = 0.0
        for place in range(shape[1] - 2, -1, -1):
            own = order[bounds[place]: bounds[place + 1]]
            if len(own):
                values = table[word[own], taken[own]] + logs[own]
                self._gather(table[:, place], word[own], values, keep=True)
        return table

    @staticmethod
    def _gather(out: np.ndarray, word: np.ndarray, values: np.ndarray, keep: bool = False) -> None:
        """out[w] = log of the sum of exp over the values of word w, added to what out holds if `keep`."""
        order = np.argsort(word, kind="stable")
        word, values = word[order], values[order]
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        top = np.maximum.reduceat(values, starts, axis=0)
        counts = np.diff(np.r_[starts, len(word)])
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            sums = np.log(np.add.reduceat(np.exp(values - np.repeat(safe, counts, axis=0)), starts, axis=0)) + safe
        at = word[starts]
        out[at] = np.logaddexp(out[at], sums) if keep else sums

    def score(self, block: list[str], model: np.ndarray) -> np.ndarray:
        """(words, languages) logarithms of the words' probabilities."""
        arcs, spelt = self.batch(block)
        lengths = np.array([len(w) + 1 for w in block])
        table = self.forward(arcs, self.weights(arcs, spelt, model), lengths)
        return table[np.arange(len(block)), lengths]

    def expected(self, block: list[str], times: np.ndarray, model: np.ndarray) -> np.ndarray:
        """(languages, pieces) expected counts; times: (words, languages) occurrences."""
        arcs, spelt = self.batch(block)
        logs = self.weights(arcs, spelt, model)
        lengths = np.array([len(w) + 1 for w in block])
        ahead, behind = self.forward(arcs, logs, lengths), self.backward(arcs, logs, lengths)
        word = arcs[:, 0]
        whole = ahead[word, lengths[word]]
        share = np.exp(ahead[word, arcs[:, 1]] + logs + behind[word, arcs[:, 2]] - whole) * times[word]
        out = np.zeros((model.shape[0], self.size))
        single = arcs[:, 3] >= 0
        for k in range(model.shape[0]):
            out[k] += np.bincount(arcs[single, 3], share[single, k], self.size)
        for i in np.flatnonzero(~single):
            for piece in spelt[-1 - arcs[i, 3]]:
                out[:, piece] += share[i]
        return out


class Prefixes:
    """The forward pass over words that share prefixes: the sums over all segmentations of a prefix are kept.

    New prefixes of a batch are summed together, by length. Sums are plain probabilities, so words of over LONG letters
    go to the lattice, which adds logarithms.
    """

    def __init__(self, lattice: Lattice, model: np.ndarray):
        self.lattice, self.model = lattice, model
        # Endings of pieces that are none themselves have -1: where no piece has an ending, no longer one need be looked up.
        self.index = {p[k:]: -1 for p in lattice.index for k in range(1, len(p))} | lattice.index
        self.table = np.exp(model).T.copy()
        self.clear()

    def clear(self) -> None:
        self.place = {"": 0}
        self.sums = np.ones((1, self.model.shape[0]))
        self.long: dict[str, np.ndarray] = {}

    def letter(self, c: str) -> int:
        """A row for a letter that is no piece: the product over its byte pieces."""
        ids = [self.lattice.by_byte[b] for b in c.encode() if b in self.lattice.by_byte]
        self.table = np.vstack([self.table, np.exp(self.model[:, ids].sum(axis=1))])
        self.index[c] = len(self.table) - 1
        return self.index[c]

    def learn(self, block: list[str]) -> None:
        """Sums for all prefixes of the words."""
        if len(self.place) + len(self.long) > KEPT_PREFIXES:
            self.clear()
        place, index, fresh = self.place, self.index, {}
        for word in block:
            if len(word) > LONG:
                if word not in self.long:
                    self.long[word] = self.lattice.score([word], self.model)[0]
                continue
            marked = START + word
            for n in range(len(marked), 0, -1):
                prefix = marked[:n]
                if prefix in place:
                    break
                place[prefix] = len(place)
                fresh.setdefault(n, []).append(prefix)
        if len(place) > len(self.sums):  # grown by half, so that what is kept is not copied for every batch
            grown = np.zeros((max(len(place), len(self.sums) * 3 // 2), self.sums.shape[1]))
            grown[: len(self.sums)] = self.sums
            self.sums = grown
        for n in sorted(fresh):
            starts, before, piece = [], [], []
            for prefix in fresh[n]:
                starts.append(len(piece))
                last = index.get(prefix[-1], -1)
                piece.append(self.letter(prefix[-1]) if last < 0 else last)
                before.append(place[prefix[:-1]])
                for k in range(2, min(n, self.lattice.longest) + 1):
                    own = index.get(prefix[n - k:])
                    if own is None:
                        break
                    if own >= 0:
                        piece.append(own)
                        before.append(place[prefix[: n - k]])
            self.sums[[place[p] for p in fresh[n]]] = np.add.reduceat(self.sums[before] * self.table[piece], starts, axis=0)

    def score(self, block: list[str]) -> np.ndarray:
        """(words, languages) logarithms of the probabilities of words that were learnt."""
        place = self.place
        with np.errstate(divide="ignore"):
            out = np.log(self.sums[[place.get(START + w, 0) for w in block]])
        if self.long:
            for i, w in enumerate(block):
                if len(w) > LONG:
                    out[i] = self.long[w]
        return np.maximum(out, -1e4)


def sampled(rows: DataFrame, bound: int, id_col: str = "doc_id") -> DataFrame:
    """About `bound` rows by a hash of their id, or all if there are fewer."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def sampled_by(rows: DataFrame, group: str, bound: int, hashed: str) -> DataFrame:
    """About `bound` rows of each group by a hash of a column, or all of a group with fewer. Each group keeps the rows of its least
    hash at least, so none is lost."""
    rows = rows.withColumn("_hash", F.pmod(F.xxhash64(F.col(hashed), F.lit("sample")), F.lit(1_000_000_000)))
    sizes = written(rows.groupBy(group).agg(F.count("*").alias("_n"), F.min("_hash").alias("_least")))
    chosen = (F.col("_hash") * F.col("_n") < F.lit(1_000_000_000 * bound)) | (F.col("_hash") == F.col("_least"))
    return rows.join(sizes, group).filter(chosen).drop("_n", "_hash", "_least")


def fit(labelled: DataFrame, path: str, text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE,
        rounds: int = ROUNDS, id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """(languages in order, (languages, pieces) log probabilities) from rows of text and non-null language.

    Languages are those of all labelled rows; of each about `rows` rows are learnt from, by a hash of the id.
    """
    spark = labelled.sparkSession
    known = sampled_by(labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(id_col, lang, text), lang, rows, id_col)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(words(body)).items():
                    seen[(own, word)] += n
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    counts = known.select(lang, text).mapInArrow(split, "lang string, word string, n long")
    counts = written(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return [], np.zeros((0, 0))
    place = {x: i for i, x in enumerate(langs)}
    size = Lattice(path).size
    model = np.full((len(langs), size), -np.log(size))
    tasks = max(1, spark.sparkContext.defaultParallelism)
    dealt = written(counts.repartition(tasks, "word"))
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model.astype(np.float32))  # languages times the fixed vocabulary

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, probabilities, total = Lattice(path), now.value.astype(np.float64), None
            for batch in batches:
                found: dict[str, np.ndarray] = {}
                for own, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    found.setdefault(word, np.zeros(len(langs)))[place[own]] += n
                order = sorted(found, key=len)
                for i in range(0, len(order), BLOCK):
                    block = order[i: i + BLOCK]
                    part = lattice.expected(block, np.array([found[w] for w in block]), probabilities)
                    total = part if total is None else total + part
            if total is not None:
                own, piece = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(piece), pa.array(total[own, piece])],
                                                 ["own", "piece", "n"])

        sums = dealt.mapInArrow(count, "own long, piece long, n double").groupBy("own", "piece").agg(F.sum("n").alias("n"))
        expected = np.full((len(langs), size), SMOOTH)
        for own, piece, n in sums.collect():
            expected[own, piece] += n
        model = np.log(expected / expected.sum(axis=1, keepdims=True))
        now.unpersist()
    return langs, model


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SLICE bytes of text, one row at least: bounds what is counted at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, "right")))
        yield batch.slice(low, high - low)
        low = high


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, path: str, text: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """The kept columns with `lang_pred` and `score`: the language's share of the likelihood a word, in 0 to 1."""
    keep = keep or ["doc_id"]
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", lang_pred string, score double"
    shipped = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Prefixes(Lattice(path), shipped.value.astype(np.float64)) if langs else None
        for batch in (part for whole in batches for part in slices(whole, len(keep))):
            counted = [Counter(words(body)) for body in batch.column(len(keep)).to_pylist()]
            if known:
                known.learn(list(set().union(*counted)))
            preds, scores = [], []
            for seen in counted:
                if not seen or not langs:
                    preds.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                times = np.fromiter(seen.values(), float, len(seen))
                total = times @ known.score(list(seen))
                best = int(np.argmax(total))
                preds.append(langs[best])
                scores.append(float(1 / np.exp((total - total[best]) / max(1.0, np.sqrt(times.sum()))).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                [*keep, "lang_pred", "score"])

    return rows.mapInArrow(score, schema)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))

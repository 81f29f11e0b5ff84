"""Which quotes stand verbatim in which texts: an index of the rarest anchors, and one pass over the texts.

The words inside a quote, all but its first and last, are whole words of any text that holds it. A quote of five words or more has
runs of three inner words, one of three or four words has inner words: these are its anchors. One pass over the texts keeps the (anchor, text) pairs
of anchors that some quote has; how many texts hold an anchor is counted on those pairs, each quote keeps only the anchor that fewest
hold, and what meets it is compared in full. A quote of one or two words has no word of its own: it is looked up in the
vocabulary of the texts first (words that hold it, or that end and start as it does), by a piece of a few letters, and then stands for those words.

Quotes and texts are compared with white space squeezed; a quote without a letter is in no text; null texts hold nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricway.functions.text import squeeze
from metricway.session import sized, spread, written

LONG = 5  # words from which three inner words are an anchor
PIECE = 4  # letters by which short quotes meet the vocabulary


def _words(text: str) -> Column:
    return F.split(text, " ")


def _threes(words: Column) -> Column:
    """Hashes of three following words."""
    size = F.size(words)
    after = [F.slice(words, k, F.greatest(size - k + 1, F.lit(0))) for k in (2, 3)]
    return F.transform(F.filter(F.arrays_zip(words.alias("a"), after[0].alias("b"), after[1].alias("c")), lambda s: s["c"].isNotNull()),
                       lambda s: F.xxhash64(s["a"], s["b"], s["c"]))


def _inner(words: Column) -> Column:
    return F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))


def _rarest(anchors: DataFrame, met: DataFrame) -> DataFrame:
    """item_id, key: of each quote the anchor that fewest texts hold; a quote with an anchor that no text holds falls away."""
    held = met.groupBy("key").agg(F.count("*").alias("texts"))
    ranked = anchors.join(held, "key", "left").groupBy("item_id").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "key")).alias("best"))
    return ranked.filter("best.texts > 0").select("item_id", "best.key")


def _word_pieces(word: Column, sizes: list[int]) -> Column:
    """All pieces of a word of the given lengths."""
    cut = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1))), lambda i: F.substr(word, i, F.lit(n)))
           for n in sizes]
    return F.array_distinct(F.concat(*cut))


def _short_pairs(short: DataFrame, body: DataFrame) -> DataFrame:
    """(item_id, doc_id) candidates of quotes of one or two words, by the vocabulary."""
    parts = _words("quote")
    last = F.element_at(parts, -1)
    two = F.size(parts) == 2
    by_end = two & (F.length(parts[0]) >= F.length(last))  # the longer part is the rarer
    asked = short.select("item_id", F.when(by_end, parts[0]).otherwise(last).alias("part"),
                         F.when(by_end, "ends").when(two, "starts").otherwise("holds").alias("how"))
    n = F.least(F.length("part"), F.lit(PIECE))
    asked = asked.withColumn("piece", F.when(F.col("how") == "ends", F.right("part", n)).otherwise(F.left("part", n)))
    sizes = sorted(r[0] for r in asked.select(n).distinct().collect())  # PIECE numbers at most
    said = body.select("doc_id", F.explode(F.array_distinct(_words("t"))).alias("word")).filter("word <> ''")
    vocabulary = said.select("word").distinct()
    fits = (F.when(F.col("how") == "ends", F.endswith("word", "part")).when(F.col("how") == "starts", F.startswith("word", "part"))
            .otherwise(F.contains("word", "part")))
    words = vocabulary.select("word", F.explode(_word_pieces(F.col("word"), sizes)).alias("piece")).join(
        sized(asked), "piece").filter(fits).select("item_id", "word").distinct()
    return said.join(sized(written(words)), "word").select("item_id", "doc_id").distinct()


def quote_pairs(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the quote, of any length but 0, stands in the text."""
    ready = written(quotes.select("item_id", squeeze(F.col("quote")).alias("quote")).filter("quote <> ''"))
    body = spread(docs.select("doc_id", "text")).select("doc_id", squeeze(F.coalesce("text", F.lit(""))).alias("t"))
    inner = _inner(_words("quote"))
    size = F.size(_words("quote"))
    anchors = ready.select("item_id", F.explode(F.array_distinct(F.when(size >= LONG, _threes(inner)).when(
        size >= 3, F.transform(inner, lambda w: F.xxhash64(w))))).alias("key"))
    kinds = {r[0] for r in ready.select(F.when(size >= LONG, 3).when(size >= 3, 2).otherwise(1)).distinct().collect()}
    pairs = None
    if kinds & {2, 3}:
        split = body.select("doc_id", _words("t").alias("w"))
        keys = ([_threes(F.col("w"))] if 3 in kinds else []) + ([F.transform("w", lambda w: F.xxhash64(w))] if 2 in kinds else [])
        grams = split.select("doc_id", F.explode(F.array_distinct(F.concat(*keys))).alias("key"))
        met = written(grams.join(sized(anchors.select("key").distinct()), "key", "left_semi").select("key", "doc_id"))
        pairs = met.join(_rarest(anchors, met), "key").select("item_id", "doc_id")
    if 1 in kinds:
        short = _short_pairs(ready.filter(size < 3), body)
        pairs = short if pairs is None else pairs.unionByName(short)
    if pairs is None:
        return ready.join(body, F.lit(False)).select("item_id", "doc_id")
    return (pairs.join(ready, "item_id").join(body, "doc_id").filter(F.contains("t", "quote")).select("item_id", "doc_id"))

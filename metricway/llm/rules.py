"""Quality rules with thresholds that adapt to each language and source.

Every measure of a document becomes a whole number; its sketch is a histogram whose bins keep the
first SIGNIFICANT bits of the number (relative error at most 2 ** -(SIGNIFICANT - 1)). Such sketches merge by
adding counts, give the same result in any order, and are summed map-side, so a hot source costs
no more than a small one. Limits are Tukey fences around the middle half of a group; groups with few
documents take the merged sketch of their language, and languages with few that of the corpus. Documents
are joined with the limits of their group.

Defined cases: a null or wordless text has zero in every measure and fails the base rule; null languages
and sources are groups of their own; an empty table gives an empty result; columns of the input are kept,
and a clash with a measure's name is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricway.llm.common import written

SIGNIFICANT = 6
SCALE = 10_000
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
REPEAT_PERCENT = 50

#: measure: (numerator, denominator, fence width in quartile ranges, least width, lower side too)
MEASURES = {
    "symbol_share": ("n_symbols", "word_chars", 3, SCALE // 50, False),
    "word_length": ("word_chars", "n_words", 6, SCALE, True),
    "dup_line_share": ("n_dup_lines", "n_lines", 3, SCALE // 2, False),
}
MIN_GROUP = 200
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def _following(array: Column, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the base measures and `base_failed`, all from the whole text.

    n_repeat_words compares three-word windows by 64-bit hashes. Each step is a projection of its own and no
    function of an array refers to another array, so that nothing is evaluated once for every word.
    """
    own = [F.col(f"`{c}`") for c in df.columns]
    out = df.select(*own, words_of(F.col(text)).alias("_words"), F.filter(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(WORD)).alias("_lines"))
    out = out.select(
        *own, F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(F.array_join("_words", ""), "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    kept = [*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    out = out.select(*kept, F.slice(F.zip_with(
        F.zip_with("_hashes", _following(F.col("_hashes"), 1), lambda a, b: F.xxhash64(a, b)),
        _following(F.col("_hashes"), 2), lambda a, b: F.xxhash64(a, b)),
        1, F.greatest(F.size("_hashes") - 2, F.lit(0))).alias("_windows"))
    # The rest only for texts in which a window occurs again; else the arrays are null.
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.select(*kept, F.when(again, F.array_sort(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_placed"))
    out = out.select(*kept, F.filter(
        F.zip_with("_placed", _following(F.col("_placed"), 1),
                   lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
        lambda pair: pair.isNotNull()).alias("_pairs"))
    out = out.select(*kept, F.array_sort(F.array_distinct(F.flatten("_pairs"))).alias("_starts"))
    out = out.select(*kept, F.coalesce(F.aggregate(
        F.zip_with("_starts", _following(F.col("_starts"), 1),
                   lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"), lambda total, x: total + x), F.lit(0)).cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def share(measure: str) -> Column:
    over, under = MEASURES[measure][:2]
    return F.when(F.col(under) > 0, F.expr(f"{SCALE} * {over} DIV {under}")).otherwise(F.lit(0)).cast("long")


def bin_of(value: Column) -> Column:
    """The number with all but its first SIGNIFICANT bits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - SIGNIFICANT, F.lit(0))
    unit = F.pow(F.lit(2.0), drop).cast("long")
    return value - F.pmod(value, unit)


def sketches(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, measure, bin, n) over the rows that pass the base rule."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bin_of(share(m)).alias("bin"))
                                 for m in MEASURES))).alias("v")
    return (rows.filter(~F.col("base_failed"))
            .select(F.col(lang).alias("lang"), F.col(source).alias("source"), values)
            .groupBy("lang", "source", F.col("v.measure").alias("measure"), F.col("v.bin").alias("bin"))
            .agg(F.count("*").alias("n")))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """A row for each group: n_docs, and q1 and q3 of every measure."""
    group = Window.partitionBy(*by, "measure")
    cumulated = (sketch.withColumn("below", F.sum("n").over(
                     group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
                 .withColumn("all", F.sum("n").over(group)))
    parts = []
    for m in MEASURES:
        mine = F.col("measure") == m
        parts += [F.min(F.when(mine & (4 * F.col("below") >= F.col("all")), F.col("bin"))).alias(f"{m}_q1"),
                  F.min(F.when(mine & (4 * F.col("below") >= 3 * F.col("all")), F.col("bin"))).alias(f"{m}_q3")]
    return cumulated.groupBy(*by).agg(F.max("all").alias("n_docs"), *parts)


def limits(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high) for every group of the sketch.

    A group with under min_group documents uses its language's merged sketch, and a language with under
    min_group documents that of the corpus.
    """
    fine = quartiles(sketch, "lang", "source").alias("g")
    mid = quartiles(merged(sketch, "lang"), "lang").alias("m")
    whole = quartiles(merged(sketch).withColumn("every", F.lit(1)), "every").alias("w")
    both = (fine.join(mid, F.col("g.lang").eqNullSafe(F.col("m.lang")))
            .withColumn("every", F.lit(1)).join(F.broadcast(whole), "every"))  # one row
    def pick(name):
        return (F.when(F.col("g.n_docs") >= min_group, F.col(f"g.{name}"))
                .when(F.col("m.n_docs") >= min_group, F.col(f"m.{name}")).otherwise(F.col(f"w.{name}")))
    out = [F.col("g.lang").alias("lang"), F.col("g.source").alias("source")]
    for m, (_, _, width, least, lower) in MEASURES.items():
        q1, q3 = pick(f"{m}_q1"), pick(f"{m}_q3")
        out.append((q3 + width * (q3 - q1) + least).alias(f"{m}_high"))
        out.append((q1 - width * (q3 - q1) - least if lower else F.lit(0).cast("long")).alias(f"{m}_low"))
    return both.select(*out)


def adaptive_filter(rows: DataFrame, lang: str = "lang", source: str = "source",
                    min_group: int = MIN_GROUP) -> DataFrame:
    """Rows of `measured`, which are read twice, with `kept`: base rule passed and every measure inside the
    limits of the row's language and source.

    The limits are written first: Spark then knows their size and broadcasts them only if they are small;
    else it joins by shuffle and splits a hot source.
    """
    bounds = written(limits(sketches(rows, lang, source), min_group)).alias("b")
    inside = ~F.col("base_failed")
    for m in MEASURES:
        inside = inside & F.coalesce(share(m).between(F.col(f"b.{m}_low"), F.col(f"b.{m}_high")), F.lit(True))
    own = [F.col(f"d.`{c}`") for c in rows.columns]
    match = F.col(f"d.{lang}").eqNullSafe(F.col("b.lang")) & F.col(f"d.{source}").eqNullSafe(F.col("b.source"))
    return rows.alias("d").join(bounds, match, "left").select(*own, inside.alias("kept"))

"""Mixing to target weights by iterative proportional fitting.

Tokens are counted in cells of source, language and topic. Every round scales the cells' weights to the target marginals of
one dimension after the other; a scaling is a window over the cells, and the cells are few however many the documents.
Rounds are written every few rounds and end when all marginals are met or no longer improve. A document is then kept if a
hash of its id falls below the probability of its cell: `keep` times the cell's raked weight over its share of tokens. So
that no probability exceeds 1, and no document is repeated, a weight is bounded by its cell's tokens after every round, and the
next round makes up for it in the other cells. The expected tokens of the sample have the raked proportions.

Targets are the shares of tokens tempered by an exponent (1 keeps a dimension's shares, 0 makes them equal) or a table of
weights. A value without tokens has no weight, and targets are scaled to what is there.

Defined cases: null sources and languages are values of their own; tokens are words, and a document without a word
counts in no weight but has the probability of its cell, or 1 if the cell has no token; rows with one id share their fate; an
empty table gives an empty result; all columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricway.llm.common import SMALL_ROWS, written
from metricway.llm.rules import words_of

SPACE = "\\x20\\x09-\\x0D"
DIMENSIONS = ("source", "lang", "topic")
#: exponents of the shares: sources are flattened most, topics hardly
TEMPERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
KEEP = 0.75  # share of the tokens that the sample is expected to hold
ROUNDS = 12
STEP = 4  # rounds in one plan
CLOSE = 1e-9
DIGITS = 8  # hexadecimal digits of the hash that decides

#: topic by the first pattern found; `prose` else
TOPICS = (("licence", "(?i)licen[sc]|copyright"), ("contact", "@|https?://"), ("markup", "[#*$%&|<>]{2}"))
PROSE = "prose"


def topic(text: Column) -> Column:
    out = F.lit(PROSE)
    for name, pattern in reversed(TOPICS):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))


def tempered(counted: DataFrame, tempers: dict[str, float] = TEMPERS, keep: float = KEEP) -> DataFrame:
    """The cells with <dimension>_target, its value's target share, and `bound`, the weight at which all of a cell is kept."""
    every = Window.partitionBy(F.lit(1))
    out = counted.withColumn("bound", F.col("tokens") / (F.lit(keep) * F.greatest(F.sum("tokens").over(every), F.lit(1))))
    for d in DIMENSIONS:
        own = Window.partitionBy(d)
        out = out.withColumn("_own", F.sum("tokens").over(own)).withColumn("_n", F.count("*").over(own))
        raised = F.when(F.col("_own") > 0, F.pow(F.col("_own").cast("double"), F.lit(tempers[d]))).otherwise(F.lit(0.0))
        out = out.withColumn("_raised", raised)
        out = out.withColumn(f"{d}_target", F.col("_raised") / F.sum(F.col("_raised") / F.col("_n")).over(every))
    return out.drop("_own", "_n", "_raised")


def raked(counted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Cells with tokens, <dimension>_target and `weight`, raked until all marginals are met or the rounds are over."""
    now = counted.withColumn("weight", F.col("tokens").cast("double"))
    for done in range(0, rounds, STEP):
        for _ in range(min(STEP, rounds - done)):
            for d in DIMENSIONS:
                total = F.sum("weight").over(Window.partitionBy(d))
                now = now.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"{d}_target") / total)
                                     .otherwise(F.lit(0.0)))
            now = now.withColumn("weight", F.least("weight", "bound"))
        now = written(now)
        worst = 0.0
        for d in DIMENSIONS:
            gaps = now.groupBy(d).agg((F.abs(F.sum("weight") - F.max(f"{d}_target"))).alias("gap"))
            worst = max(worst, gaps.agg(F.max("gap")).first()[0] or 0.0)
        if worst <= CLOSE:
            break
    return now


def probabilities(raked_cells: DataFrame) -> DataFrame:
    """Cells with `probability`: the weight over the weight at which all of the cell is kept."""
    return raked_cells.withColumn("probability", F.when(F.col("bound") > 0, F.col("weight") / F.col("bound"))
                                  .otherwise(F.lit(1.0)))


def drawn(id_col: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    digits = F.substring(F.md5(id_col.cast("string").cast("binary")), 1, DIGITS)
    return F.coalesce(F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** DIGITS)), F.lit(0.0))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
          tempers: dict[str, float] = TEMPERS, rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs with `topic`, `tokens`, `probability` and `chosen`.

    The few cells are written before the join, so Spark knows their size: it broadcasts them if they are
    small, else joins by shuffle and splits a hot cell.
    """
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(lang).alias("lang"),
                       topic(F.col(text)).alias("topic"), tokens(F.col(text)).alias("tokens"))
    counted = written(cells(rows.select(*DIMENSIONS, "tokens")))
    table = written(probabilities(raked(written(tempered(counted, tempers)), rounds)).select(*DIMENSIONS, "probability"))
    if table.count() <= SMALL_ROWS:
        table = F.broadcast(table)
    match = F.lit(True)
    for d in DIMENSIONS:
        match = match & F.col(f"r.{d}").eqNullSafe(F.col(f"t.{d}"))
    out = rows.alias("r").join(table.alias("t"), match, "left")
    return out.select(*(F.col(f"r.c{i}").alias(c) for i, c in enumerate(docs.columns)), F.col("r.topic").alias("topic"),
                      F.col("r.tokens").alias("tokens"), F.col("t.probability").alias("probability"),
                      (drawn(F.col("r.id")) < F.col("t.probability")).alias("chosen"))

"""Repair of conversation structure at the least cost, by a shortest path over whole numbers.

A repaired conversation has role initials `(s?(ua)+)?`. A row is kept (0), given the role user or assistant (2) or deleted (3,
which blank and repeated rows must be); an empty user or assistant row is put in anywhere for 2; a row that breaks off and stays
adds 1. Paths lead through a graph of (rows read, role before). The weight of a path is one whole number: its high digits are the
cost, its low digits of three bits the letters of the edits by place, D < I < K < R, with zeros at the end. The least number is
therefore the cheapest path, and among the cheapest the one whose letters are least in ASCII. Of two equally dear paths over the
same rows neither is the beginning of the other (they would differ by insertions, which cost), so the least number of a part can be
joined to the least of the next: rows are taken in blocks of BLOCK, each block gives the least number for every role before and after
it, and blocks are joined FAN at a time until one is left. A conversation of any length is read by many tasks; what one row holds of
it are its letters, which are the result.

Defined cases: nulls in role and text are one space; rows are taken by turn (nulls first), ties by role and text; equal rows of one
turn are repeats; a null conversation is one of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricway.llm.common import written

BLOCK, FAN = 64, 16
BITS = 3
LETTERS = " DIKR"
STATES = 4  # nothing yet, after system, after user, after assistant
#: role initial: state after it, by state before it (None: not allowed)
STEPS = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
SPACE = "\\x20\\x09-\\x0D"


def _used(weight: int, width: int) -> int:
    """How many letters a weight of `width` places has."""
    digits = weight & ((1 << BITS * width) - 1)
    return width - ((digits & -digits).bit_length() - 1) // BITS if digits else 0


def _edge(weight: int, width: int, letter: str, cost: int) -> int:
    place = width - 1 - _used(weight, width)
    return weight + (cost << BITS * width) + (LETTERS.index(letter) << BITS * place)


def _relax(best: list, state: int | None, weight: int) -> None:
    if state is not None and (best[state] is None or weight < best[state]):
        best[state] = weight


def _inserted(best: list, width: int) -> list:
    """With up to two rows put in; more are never cheapest."""
    for _ in range(2):
        more = list(best)
        for state, weight in enumerate(best):
            if weight is not None:
                for role in "ua":
                    if STEPS[role][state] is not None:
                        _relax(more, STEPS[role][state], _edge(weight, width, "I", INSERT))
        best = more
    return best


def block_weights(rows: list) -> list:
    """rows: (initial, must_go, broken). The least weight from every state to every state, STATES * STATES, of width 3 * len(rows)."""
    width, out = 3 * len(rows), []
    for first in range(STATES):
        best: list = [None] * STATES
        best[first] = 0
        for initial, must_go, broken in rows:
            following: list = [None] * STATES
            for state, weight in enumerate(_inserted(best, width)):
                if weight is None:
                    continue
                _relax(following, state, _edge(weight, width, "D", DELETE))
                if not must_go:
                    extra = BROKEN if broken else 0
                    if initial in STEPS:
                        _relax(following, STEPS[initial][state], _edge(weight, width, "K", KEEP + extra))
                    for role in "ua":
                        _relax(following, STEPS[role][state], _edge(weight, width, "R", REROLE + extra))
            best = following
        out += best
    return out


def joined(a: list, wide_a: int, b: list, wide_b: int) -> list:
    """The least weights over two neighbouring blocks, of width wide_a + wide_b."""
    width, out = wide_a + wide_b, []
    cut_a, cut_b = (1 << BITS * wide_a) - 1, (1 << BITS * wide_b) - 1
    for first in range(STATES):
        for last in range(STATES):
            least = None
            for mid in range(STATES):
                x, y = a[first * STATES + mid], b[mid * STATES + last]
                if x is None or y is None:
                    continue
                cost = (x >> BITS * wide_a) + (y >> BITS * wide_b)
                digits = ((x & cut_a) << BITS * wide_b) | ((y & cut_b) << BITS * (wide_a - _used(x, wide_a)))
                weight = (cost << BITS * width) | digits
                least = weight if least is None else min(least, weight)
            out.append(least)
    return out


def solved(weights: list, width: int) -> tuple[int, str]:
    """(cost, letters) of the whole: rows may still be put in at the end, and the last is an assistant's or there is none."""
    # Two more places for the rows put in at the end.
    best = [None if w is None else (w >> BITS * width << BITS * (width + 2)) | ((w & ((1 << BITS * width) - 1)) << BITS * 2)
            for w in weights[:STATES]]
    width += 2
    best = _inserted(best, width)
    weight = min(w for w in (best[0], best[3]) if w is not None)
    digits = format(weight & ((1 << BITS * width) - 1), f"0{BITS * width}b")
    letters = (LETTERS[int(digits[i: i + BITS], 2)] for i in range(0, len(digits), BITS))
    return weight >> BITS * width, "".join(letters).rstrip(" ")


def _packed(weights: list) -> list:
    return [None if w is None else w.to_bytes((w.bit_length() + 8) // 8, "big") for w in weights]


def _unpacked(weights: list) -> list:
    return [None if w is None else int.from_bytes(w, "big") for w in weights]


PART = "start long, block long, width long, weights array<binary>, illegal long, head string, tail string"


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


PART_ARROW = pa.schema([("start", pa.int64()), ("block", pa.int64()), ("width", pa.int64()), ("weights", pa.list_(pa.binary())),
                        ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}  # many blocks are alike; holds no more than a batch's
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            rows = tuple((r["initial"], r["must_go"], r["broken"]) for r in row["rows"])
            if rows not in known:
                known[rows] = _packed(block_weights(rows))
            initials = [r[0] for r in rows]
            out.append({"start": row["start"], "block": row["block"], "width": 3 * len(rows), "weights": known[rows],
                        "illegal": sum(x + y not in LEGAL for x, y in zip(initials, initials[1:])),
                        "head": initials[0], "tail": initials[-1]})
        known.clear()
        yield _batch(out, PART_ARROW)


def _joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            parts = row["parts"]
            weights, out = _unpacked(parts[0]["weights"]), dict(parts[0])
            for part in parts[1:]:
                weights = joined(weights, out["width"], _unpacked(part["weights"]), part["width"])
                out["width"] += part["width"]
                out["illegal"] += part["illegal"] + (out["tail"] + part["head"] not in LEGAL)
                out["tail"] = part["tail"]
            yield _batch([{**out, "start": row["start"], "block": row["block"], "weights": _packed(weights)}], PART_ARROW)


def _solutions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("start", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            cost, audit = solved(_unpacked(row["weights"]), row["width"])
            out.append({"start": row["start"], "illegal": row["illegal"], "cost": cost, "audit": audit})
        yield _batch(out, schema)


def numbered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, row), written: rows by conversation and turn with gapless numbers from 0.

    The table is cut into ranges of this order, so that a conversation with a third of all rows is several tasks.
    """
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                     F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    placed = written(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each range
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return written(placed.withColumn("part", part).join(offsets, "part").select(
        *order, (F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("row")))


def has_word(text: Column) -> Column:
    return text.rlike(f"[^{SPACE}]")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, row, start, turn, initial, fault) of numbered rows; start: the first row of the conversation.

    The fault is the first of blank, duplicate and truncated, or null.
    """
    slim = rows.select("conv_id", "row", "turn", "role", F.sha2("text", 256).alias("sha"),
                       has_word(F.col("text")).alias("worded"), F.col("text").rlike(f"[.!?][{SPACE}]*\\z").alias("ended"))
    starts = rows.groupBy(F.col("conv_id").alias("conv")).agg(F.min("row").alias("start"))
    slim = slim.join(starts, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    first = slim.groupBy("start", "role", "sha").agg(F.min("row").alias("first"))
    fault = (F.when(~F.col("worded"), "blank").when(F.col("first") < F.col("row"), "duplicate")
             .when(~F.col("ended"), "truncated"))
    return slim.join(first, ["start", "role", "sha"]).select(
        "conv_id", "row", "start", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def audits(found: DataFrame) -> DataFrame:
    """(start, illegal, cost, audit) of each conversation of `faults`."""
    row = F.struct("row", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must_go"),
                   F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("broken"))
    blocks = found.groupBy("start", F.expr(f"(row - start) DIV {BLOCK}").alias("block")).agg(
        F.array_sort(F.collect_list(row)).alias("rows"))  # BLOCK rows at most
    parts = written(blocks.mapInArrow(_blocks, PART))
    while (parts.agg(F.max("block")).first()[0] or 0) > 0:
        group = parts.groupBy("start", F.expr(f"block DIV {FAN}").alias("over")).agg(F.array_sort(F.collect_list(
            F.struct("block", "width", "weights", "illegal", "head", "tail"))).alias("parts"))  # FAN blocks at most
        parts = written(group.withColumnRenamed("over", "block").mapInArrow(_joins, PART))
    return parts.mapInArrow(_solutions, "start long, illegal long, cost long, audit string")


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with their edits to rows of the repaired conversation; only the role before is held."""
    schema = pa.schema([("start", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    start, place, before = None, 0, ""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["start"] != start:
                start, place, before = row["start"], 0, ""
            for letter in row["edits"]:
                if letter == "D":
                    continue
                role, text = {"u": "assistant"}.get(before, "user"), row["text"]
                if letter == "I":
                    text = ""
                elif letter == "K":
                    role = row["role"]
                before = role[:1]
                out.append({"start": start, "place": place, "role": role, "text": text})
                place += 1
        yield _batch(out, schema)


def repaired(rows: DataFrame, solutions: DataFrame) -> DataFrame:
    """(start, place, role, text): the rows of the repaired conversations, each in one partition by place.

    A conversation's rows pass one task as a stream.
    """
    edits = solutions.select("start", F.posexplode(F.regexp_extract_all("audit", F.lit("I*[DKR](?:I+\\z)?"), F.lit(0))))
    edits = edits.select("start", (F.col("start") + F.col("pos")).alias("row"), F.col("col").alias("edits"))
    ordered = (rows.join(edits, "row").filter("edits <> 'D'").select("start", "row", "role", "text", "edits")
               .repartition("start").sortWithinPartitions("start", "row"))
    return ordered.mapInArrow(_rewritten, "start long, place long, role string, text string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("start", pa.int64()), ("sha", pa.string())])
    start, digest = None, None
    for batch in batches:
        out = []
        for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("start", "role", "text"))):
            if key != start:
                if start is not None:
                    out.append({"start": start, "sha": digest.hexdigest()})
                start, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield _batch(out, schema)
    if start is not None:
        yield _batch([{"start": start, "sha": digest.hexdigest()}], schema)


def digests(lines: DataFrame) -> DataFrame:
    """(start, sha): SHA-256 of `role:text` lines of `repaired`, joined by newlines."""
    return lines.mapInArrow(_hashed, "start long, sha string")


def report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation of numbered rows."""
    found = written(faults(rows))
    solutions = written(audits(found))
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = found.groupBy("conv_id", "start").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        *(F.count_if(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")))
    texts = digests(repaired(rows, solutions))
    return counts.join(solutions, "start").join(texts, "start", "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

"""Fuzzy line dedup: shingle signatures of lines, bands, exact Jaccard, union-find, one line of a component stays.

A line's shingles are its character strings of SHINGLE code points, one from every code point on, so that every character is
compared; a shorter line is one shingle. Signature: the shingles' hashes in order, as a circle, fall in sixteen ranges; the
two hashes before the end of a range and the two after it are one band. Two lines at Jaccard j agree in a band with about
j ** 4, and in none with (1 - j ** 4) ** 16: 2e-4 at 0.8, 4e-8 at 0.9. Lines of up to FEW shingles have a
band at every hash and miss none: where a fifth differs at most, four common hashes follow each other somewhere. Lines that meet in a band are checked by the exact Jaccard of all their shingles, told apart by 64-bit hashes.

Equal lines are one line before anything meets; lines of a band are linked as `linking` says. All of it is DataFrame
functions. Lines travel as numbers; only those that share a band with a line they could be linked to are read again.

Whether they could be is read from their profiles: WORDS words of 64 bits, each the parities of the hashes of one range. A hash that
only one of two lines has changes one bit, so lines differ in at least as many hashes as their profiles in bits, and no link is lost.

Defined cases: a line without a word is kept as it is, and so is a null text; of a component the first line by id and
place stays; repeated rows are documents of their own, and their order is that of their place in the input; an empty
table gives an empty result; all columns are kept, and `n_chars` is counted anew where it exists.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricway.llm import linking
from metricway.llm.common import released, written

SHINGLE = 5
SIMILARITY = 0.8
RANGE_BITS = 4  # hashes fall in 2 ** RANGE_BITS ranges
FEW = 2 << RANGE_BITS  # hashes that each have a band
WORDS = 1 << RANGE_BITS - 1  # of a profile: one for every second range
SPACE = "\\x20\\x09-\\x0D"
#: a shingle is looked at, then one code point is passed over
EVERY = f"(?s)(?=(.{{{SHINGLE}}}))."


def shingles(line: Column) -> Column:
    long = F.regexp_extract_all(line, F.lit(EVERY), F.lit(1))
    return F.when(F.char_length(line) < SHINGLE, F.array(line)).otherwise(long)


def hashed(line: Column) -> Column:
    """64-bit hashes of the shingles, each once: a shingle is twenty bytes of the line at four bytes a code point, made wide once."""
    return F.array_distinct(F.transform(F.array(F.encode(line, "UTF-32")), lambda wide: F.transform(
        F.sequence(F.lit(1), F.greatest(F.octet_length(wide) - 4 * SHINGLE + 1, F.lit(1)), F.lit(4)),
        lambda i: F.xxhash64(F.substring(wide, i, F.lit(4 * SHINGLE)))))[0])


def line_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns with `place` and `line`: a row for each line of each text."""
    own = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(*own, F.posexplode(F.split(text, "\\n", -1)).alias("place", "line"))


def identity(line: Column) -> list[Column]:
    """What tells lines apart: 128 bits of two hashes and the length."""
    return [F.xxhash64(line).alias("line_key"),
            (F.crc32(line.cast("binary")) * F.lit(1 << 31) + F.pmod(F.octet_length(line), F.lit((1 << 31) - 1)))
            .cast("long").alias("line_check")]


#: where the ranges of hashes begin
BOUNDS = [(r << 64 - RANGE_BITS) - (1 << 63) for r in range(1 << RANGE_BITS)]


def sketched(parts: DataFrame) -> DataFrame:
    """The rows with, in place of `line`, n (its shingles), low and high (32 and 8 bits of the key of each band) and the profile.

    The beginnings of the ranges are sorted in among the hashes; how many hashes lie below one follows from its position. Every
    step is a projection of its own: what a step makes is made once for a line, not once for each element or position.
    """
    own = [c for c in parts.columns if c != "line"]
    hashes = parts.select(*own, F.sort_array(hashed(F.col("line"))).alias("h"))
    bounded = hashes.select(*own, "h", F.size("h").alias("n"), F.sort_array(F.concat("h", F.array(*map(F.lit, BOUNDS)))).alias("bounded"))
    below = [F.array_position("bounded", F.lit(b)).cast("int") - 1 - r for r, b in enumerate(BOUNDS)]
    # The transform keeps the step out of whole-stage code, where sixteen searches side by side are too long to be compiled.
    ranged = bounded.select(*own, "h", "n", F.transform(F.array(*below), lambda x: x).alias("below"))

    def word(r: int) -> Column:
        inside = F.slice("h", F.get("below", F.lit(r)) + 1, F.get("below", F.lit(r + 1)) - F.get("below", F.lit(r)))
        return F.aggregate(inside, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(F.call_function(
            "shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63).cast("long")).cast("int"))))

    profile = F.struct(*(word(2 * w).alias(f"w{w}") for w in range(WORDS))).alias("profile")
    circle = ranged.select(*own, "n", profile, F.when(F.col("n") <= FEW, F.transform("h", lambda _, i: i)).otherwise(
        F.array_distinct(F.transform("below", lambda x: F.pmod(x, "n")))).alias("at"), F.concat(
        F.array(F.element_at("h", -F.least(F.col("n"), F.lit(2))), F.element_at("h", -1)), "h", F.slice("h", 1, 1)).alias("c"))

    def four(i: Column) -> list[Column]:
        return [F.get("c", i + k) for k in range(4)]

    return circle.select(*own, "n", F.transform("at", lambda i: F.hash(*four(i))).alias("low"), F.transform(
        "at", lambda i: F.shiftright(reduce(Column.bitwiseXOR, four(i)), 56).cast("byte")).alias("high"), "profile")


def line_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, row, place, line_key, line_check, line) of the lines with a word of (doc_id, row, text)."""
    parts = line_rows(docs).filter(F.col("line").rlike(f"[^{SPACE}]"))
    return parts.select("doc_id", "row", "place", *identity(F.col("line")), "line")


def signed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrences, lines), both written.

    occurrences: (doc_id, row, place, line_key, line_check), row being the document's number in the column `row`, or else
    its place in the input's partitions, which holds for one scan only;
    lines: (id, line_key, line_check, n, low, high, profile) of each distinct line with a word.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    found = line_keys(docs.select(F.col(id_col).alias("doc_id"), number.alias("row"), F.col(text).alias("text")))
    occurrences = written(found.drop("line"))
    sketches = sketched(found.select("line_key", "line_check", "line"))
    lines = sketches.groupBy("line_key", "line_check").agg(F.any_value(F.struct("n", "low", "high", "profile")).alias("v"))
    return occurrences, written(lines.select("line_key", "line_check", "v.*").withColumn("id", F.monotonically_increasing_id()))


def apart(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """A lower bound of the distance of two lines: where so many hashes differ at least, no more than the others can be common."""
    differ = reduce(Column.__add__, (F.bit_count(a("profile")[f"w{w}"].bitwiseXOR(b("profile")[f"w{w}"])) for w in range(WORDS)))
    return F.greatest(linking.by_size(a, b), 2 * differ / (a("size") + b("size") + differ))


def buckets(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The members of all bands that two lines share, where a link is possible. Only keys and numbers travel; sizes and profiles are
    looked up for those that share one."""
    band = lines.select("id", F.explode(F.arrays_zip("low", "high")).alias("k"))
    key = F.shiftleft(F.col("k.high").cast("long"), 32).bitwiseOR(F.col("k.low").cast("long").bitwiseAND(F.lit((1 << 32) - 1)))
    return linking.near(band.select("id", key.alias("key")), lines.select("id", F.col("n").alias("size"), "profile"), apart, similarity)


def alike(pairs: DataFrame, sets: DataFrame, similarity: float, own: Callable[[Column], Column] = F.array_distinct) -> DataFrame:
    """(a, b, distance, linked) of pairs by the exact Jaccard of their shingles.

    sets: (id, shingles), shingles being what `own` makes the set of. Lines travel as texts and are cut after the join: hashes of
    all their shingles are eight times as long.
    """
    both = (pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("own_b")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("own_a")), "a"))
    both = both.select("a", "b", own(F.col("own_a")).alias("own_a"), own(F.col("own_b")).alias("own_b"))
    both = both.select("a", "b", (F.size("own_a") + F.size("own_b")).alias("sizes"),
                       F.size(F.array_intersect("own_a", "own_b")).alias("common"))
    whole = F.col("sizes") - F.col("common")
    return both.select("a", "b", (1 - F.col("common") / F.greatest(whole, F.lit(1))).alias("distance"),
                       (F.col("common") >= similarity * whole).alias("linked"))


def linked(members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY,
           own: Callable[[Column], Column] = F.array_distinct) -> DataFrame:
    """(node, component) of all lines that a band and the exact Jaccard link to another."""
    least = apart if "profile" in members.columns else linking.by_size
    return linking.linked(members, lambda pairs: alike(pairs, sets, similarity, own), similarity, least)


def dropped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
            row: str | None = None) -> DataFrame:
    """(doc_id, row, place, kept_doc, kept_place): every occurrence that goes, and the line that stays for it."""
    occurrences, lines = signed(docs, id_col, text, row)
    members = buckets(lines, similarity)
    same, key = ["doc_id", "row", "place"], ["line_key", "line_check"]
    first = occurrences.groupBy(*key).agg(F.min(F.struct(*same)).alias("first"), F.count("*").alias("met"))
    first = written(lines.select("id", *key).join(first, key).select("id", *key, "first", "met"))
    released(lines)
    wanted = members.select("id").distinct().join(first.select("id", *key, "first.doc_id", "first.place"), "id")
    # Lines that share a band are read again: the texts of their documents are exchanged once, by id, with the places asked for.
    places = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("place", *key, "id")).alias("asked"))
    texts = docs.select(F.col(id_col).alias("own_id"), F.col(text).alias("text"))
    again = texts.join(places, texts["own_id"].eqNullSafe(places["doc_id"]))
    # The lines of a text pass through an explode of their own: else the text would be split once for every place.
    again = again.select(F.explode(F.array(F.struct(F.split("text", "\\n", -1).alias("own"), "asked"))).alias("d"))
    again = again.select("d.own", F.explode("d.asked").alias("p"))
    again = again.select("p", F.get("own", F.col("p.place")).alias("line")).filter("line IS NOT NULL")
    line_key, check = identity(F.col("line"))
    again = again.filter((line_key == F.col("p.line_key")) & (check == F.col("p.line_check")))  # rows may share an id
    sets = written(again.select(F.col("p.id").alias("id"), F.col("line").alias("shingles")).dropDuplicates(["id"]))
    found = linked(members, sets, similarity, hashed).withColumnRenamed("node", "id")
    released(members, sets)
    joined = first.join(found, "id")
    stays = joined.drop("first").join(joined.groupBy("component").agg(F.min("first").alias("first")), "component").select(*key, "first")
    alone = first.filter("met > 1").join(found, "id", "left_anti").select(*key, "first")  # equal lines, and none like them
    stays = written(stays.unionByName(alone))
    released(first, found)
    return (occurrences.join(stays, key).filter(F.struct(*same) != F.col("first"))
            .select(*same, F.col("first.doc_id").alias("kept_doc"), F.col("first.place").alias("kept_place")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the lines that go; a document that loses every line keeps an empty text.

    The documents are written once with their row numbers: those of another scan could differ, as its partitions can.
    """
    number, lost = "_row", "gone"
    while number in docs.columns:
        number += "_"
    while lost in docs.columns:
        lost += "_"
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()))
    gone = (dropped(rows, id_col, text, similarity, number).groupBy(F.col("row").alias(number))
            .agg(F.collect_set("place").alias(lost)))  # at most the lines of one document
    kept = rows.join(gone, number, "left")
    rest = F.array_join(F.transform(F.filter(
        F.transform(F.split(text, "\\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda p: ~F.array_contains(lost, p["i"])), lambda p: p["x"]), "\n")
    out = kept.withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(rest)).drop(lost)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast("long"))
    return out.select(*docs.columns)

"""Personal data by fixed patterns, and more of it by contexts that the found data teach.

Base spans come from patterns of four kinds. They are the seeds of a graph of contexts and strings: a context is the letters before a
string with all between (`KEYS`), a string is a seed or a token with LEAST_DIGITS digits or more outside all base spans. Rounds score the
graph both ways until nothing changes, ROUNDS at most: a context's confidence in a kind is the weight of its strings of that
kind against all its seeds and a share UNKNOWN of its other strings; contexts with a confidence of CONFIDENT and a weight of SUPPORT
or more give their strings the chance that one of them is right; strings of ACCEPTED or more are found, count in the next round, and are
spans of that kind wherever they stand. Only distinct pairs of context and string count, so copies of a document teach nothing new.
Graph and scores are written tables, aggregated before they are exchanged; nothing reaches the driver but whether a round changed them.

Places are summed in chunks of CHUNK matches, so the work follows the length of a text; the patterns never go back over what they have
read, so neither long runs of digits nor long words cost more than their length.

Defined cases: a null or empty text has no spans; repeated rows get the same spans each; equal starts are ordered by kind as listed; an
empty table gives no rows; other columns are kept whatever their names, but for `base` and `spans`, which are an error; null ids are
ids like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricway.llm.common import written

#: kind: pattern. The beginnings (\G: where the match before ended) only spare starts inside a run that failed at its start.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
TOKEN = r"(?<![A-Za-z0-9_.-])[A-Za-z_.-]*+[0-9][A-Za-z0-9_.-]*+"
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
LEAST_DIGITS = 6
CHUNK, CONTEXT = 128, 64
ROUNDS, SUPPORT, CONFIDENT, ACCEPTED, UNKNOWN = 8, 4, 0.6, 0.6, 0.25
CERTAIN = 0.999

SPAN = "array<struct<start: bigint, kind: string, end: bigint>>"


def _pairs(found: str, gaps: str) -> Column:
    """A row for each match: lengths of the gap before it and of itself, and the texts around."""
    following = F.slice(gaps, 2, F.size(found))
    both = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(
        m.alias("match"), F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size"),
        F.right(g, F.lit(CONTEXT)).alias("before")))
    return F.zip_with(both, following, lambda p, g: F.struct(
        p["match"].alias("match"), p["gap"].alias("gap"), p["size"].alias("size"), p["before"].alias("before"),
        F.left(g, F.lit(CONTEXT)).alias("after")))


def _located(df: DataFrame, own: list[Column], pairs: list[str]) -> DataFrame:
    """Arrays of `_pairs` as (start, end, match, before, after), by sums inside chunks and over chunks."""
    zero = F.lit(0).cast("long")

    def chunks(p):
        numbers = F.sequence(F.lit(0), F.expr(f"int((size({p}) - 1) DIV {CHUNK})"))
        return F.transform(numbers, lambda c: F.slice(p, c * CHUNK + 1, F.lit(CHUNK)))
    step = df.select(*own, *pairs, *(chunks(p).alias(f"{p}_chunks") for p in pairs))
    step = step.select(*own, *pairs, *(f"{p}_chunks" for p in pairs), *(F.transform(f"{p}_chunks", lambda c: F.aggregate(
        c, zero, lambda total, x: total + x["gap"] + x["size"])).alias(f"{p}_totals") for p in pairs))
    step = step.select(*own, *pairs, *(f"{p}_chunks" for p in pairs), *(F.aggregate(
        f"{p}_totals", F.array(zero), lambda sums, t: F.concat(sums, F.array(F.element_at(sums, -1) + t))).alias(f"{p}_sums")
        for p in pairs))

    def starts(chunk, offset):
        walked = F.aggregate(chunk, F.struct(offset.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["size"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["gap"])).alias("out")))
        return walked["out"]
    step = step.select(*own, *pairs, *(F.flatten(F.zip_with(
        f"{p}_chunks", F.slice(f"{p}_sums", 1, F.size(f"{p}_chunks")), starts)).alias(f"{p}_starts") for p in pairs))
    return step.select(*own, *(F.zip_with(p, f"{p}_starts", lambda x, s: F.struct(
        s.alias("start"), (s + x["size"]).alias("end"), x["match"].alias("match"), x["before"].alias("before"),
        x["after"].alias("after"))).alias(p) for p in pairs))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits, of 19 at most, passes the Luhn check."""
    places = F.filter(F.split(F.reverse(number), ""), lambda d: d != "")
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 1, F.element_at(
        F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return F.when(F.length(digits(match)).between(12, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def _tagged(spans: Column, kind: str | None) -> Column:
    return F.transform(spans, lambda s: F.struct(
        F.lit(kind).cast("string").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
        s["before"].alias("before"), s["after"].alias("after")))


def _trimmed(span: Column) -> Column:
    """A token without the marks at its ends."""
    core = F.regexp_replace(span["match"], "^[._-]+", "")
    start = span["start"] + F.length(span["match"]) - F.length(core)
    core = F.regexp_replace(core, "[._-]+$", "")
    return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("match"),
                    span["before"].alias("before"), span["after"].alias("after"))


def spotted(df: DataFrame, text: str = "text") -> DataFrame:
    """(own, base, tokens) for each row: own holds the other columns, base the spans of the patterns, tokens the other candidates.

    Spans and tokens: (kind, start, end, match, before, after), places in code points.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in df.columns if c != text]
    rows = df.select((F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("own"), body.alias("text"))
    names = {**PATTERNS, "token": TOKEN}
    def tried(kind: str, found: Column) -> Column:
        needed = F.contains(F.col("text"), F.lit(NEEDS[kind])) if kind in NEEDS else F.col("text").rlike("[0-9]")
        return F.when(needed, found)
    none = F.array().cast("array<string>")
    rows = rows.select("own", *(F.coalesce(tried(k, F.regexp_extract_all("text", F.lit(p), F.lit(0))), none).alias(f"{k}_found")
                                for k, p in names.items()),
                       *(F.coalesce(tried(k, F.split("text", p, -1)), none).alias(f"{k}_gaps") for k, p in names.items()))
    rows = rows.select("own", *(_pairs(f"{k}_found", f"{k}_gaps").alias(k) for k in names))
    rows = _located(rows, [F.col("own")], list(names))

    def holding(kind):
        return F.filter(kind, lambda s: _holds(kind, s["match"]))
    base = F.concat(*(_tagged(holding(k), k) for k in KINDS))
    tokens = F.filter(F.transform("token", _trimmed), lambda s: F.length(digits(s["match"])) >= LEAST_DIGITS)
    return rows.select("own", base.alias("base"), _tagged(tokens, None).alias("tokens"))


def keys(before: Column, after: Column) -> Column:
    """The contexts of a span: the last word before it with what stands between, the last two, and the last with the next after it."""
    plain = F.regexp_replace(F.lower(before), "[0-9]", "0")
    one = F.regexp_extract(plain, r"\p{L}+[^\p{L}]*$", 0)
    two = F.regexp_extract(plain, r"\p{L}+[^\p{L}]+\p{L}+[^\p{L}]*$", 0)
    following = F.regexp_extract(F.lower(after), r"^[^\p{L}]*(\p{L}+)", 1)
    return F.array_compact(F.array(
        F.when(one != "", F.concat(F.lit("1:"), one)), F.when(two != "", F.concat(F.lit("2:"), two)),
        F.when((one != "") & (following != ""), F.concat(F.lit("3:"), one, F.lit("|"), following))))


def occurrences(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, string, keys): base spans, and tokens that no base span of the row meets. rows: (row, base, tokens)."""
    spans = rows.select("row", F.explode(F.concat("base", "tokens")).alias("s")).select(
        "row", "s.kind", "s.start", "s.end", F.md5("s.match").alias("string"), keys(F.col("s.before"), F.col("s.after")).alias("keys"))
    upto = Window.partitionBy("row").orderBy("start", F.col("kind").isNull(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.col("kind").isNull(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("kind").isNotNull()
    spans = spans.select("*", F.max(F.when(known, F.col("end"))).over(upto).alias("reached"),
                         F.min(F.when(known, F.col("start"))).over(down).alias("coming"))
    free = ~(F.coalesce(F.col("reached"), F.lit(0)) > F.col("start")) & ~(F.coalesce(F.col("coming"), F.col("end")) < F.col("end"))
    return spans.filter(known | free).select("row", "kind", "start", "end", "string", "keys")


def graph(spans: DataFrame) -> DataFrame:
    """Distinct (key, string, kind) of occurrences; kind is null for a token. A string that is also a seed is that seed only."""
    edges = spans.select(F.explode("keys").alias("key"), "string", "kind").distinct()
    seeds = edges.filter("kind IS NOT NULL").select("string").distinct()
    unknown = edges.filter("kind IS NULL").join(seeds, "string", "left_anti").select("key", "string", "kind")
    return edges.filter("kind IS NOT NULL").unionByName(unknown)


def learned(edges: DataFrame) -> DataFrame:
    """(string, kind, score) of the strings that the written graph's contexts give away."""
    unknown = edges.filter("kind IS NULL").select("key", "string")
    counts = written(edges.groupBy("key").agg(
        *(F.count_if(F.coalesce(F.col("kind") == k, F.lit(False))).alias(k) for k in KINDS),
        F.count("kind").alias("seeds"), F.count_if(F.col("kind").isNull()).alias("unknown")))
    found = unknown.filter(F.lit(False)).select("string", F.lit("").alias("kind"), F.lit(0.0).alias("score"))  # nothing yet
    before = None
    for _ in range(ROUNDS):
        weights = unknown.join(found, "string").groupBy("key").agg(
            *(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"{k}_more") for k in KINDS),
            F.count("*").alias("more"))
        table = counts.join(weights, "key", "left").na.fill(0)
        total = F.col("seeds") + F.col("more") + UNKNOWN * (F.col("unknown") - F.col("more")) + 1
        best = F.array_max(F.array(*(F.struct((F.col(k) + F.col(f"{k}_more")).alias("weight"), F.lit(k).alias("kind")) for k in KINDS)))
        sure = (table.select("key", best.alias("best"), total.alias("total"))
                .select("key", F.col("best.kind").alias("kind"), F.col("best.weight").alias("weight"),
                        (F.col("best.weight") / F.col("total")).alias("confidence"))
                .filter((F.col("weight") >= SUPPORT) & (F.col("confidence") >= CONFIDENT)))
        missed = F.log1p(-F.least(F.col("confidence"), F.lit(CERTAIN)))
        scores = unknown.join(sure, "key").groupBy("string", "kind").agg((1 - F.exp(F.sum(missed))).alias("score"))
        found = written(scores.groupBy("string").agg(F.max(F.struct(F.round("score", 9).alias("score"), "kind")).alias("b"))
                        .select("string", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))
                        .filter(F.col("score") >= ACCEPTED))
        now = found.agg(F.count("*"), F.sum(F.xxhash64("string", "kind", "score").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return found


def found(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows without the text, with `base` and `spans`: (start, kind, end) by start and kind as listed; spans holds base and
    what the contexts gave away."""
    if {"base", "spans"} & set(df.columns):
        raise ValueError("columns named base or spans are taken")
    rows = written(spotted(df, text).withColumn("row", F.monotonically_increasing_id()))
    busy = rows.filter((F.size("base") > 0) | (F.size("tokens") > 0))
    spans = written(occurrences(busy.select("row", "base", "tokens")))
    more = spans.filter("kind IS NULL").drop("kind").join(learned(written(graph(spans))), "string")
    more = more.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))  # of one text
    slim = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    kept = [F.col(f"own.`{c}`") for c in df.columns if c != text]
    out = rows.select("own", "row", slim.alias("base")).join(more, "row", "left")
    return out.select(*kept, _ordered(F.col("base")).alias("base"),
                      _ordered(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"))


def _ordered(spans: Column) -> Column:
    place = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    sortable = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(sortable, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def listed(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

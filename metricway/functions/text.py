"""Text columns: masking, ids, turns, transcripts, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Account, id and path patterns, and the turn markers.
ACCOUNT = (r"(?<![\p{Nd}$.,])(?<!CALL-)(?<!MBR-)(?<!AGT-)"
           r"(?:(?:\p{Nd}{4}[ -])+|\p{Nd}+)(\p{Nd}{4})(?![\p{Nd},]|\.\p{Nd})")
CALL_ID = r"CALL-\d{5}"
CALL_ID_ANY_CASE = r"(?i)\bcall-\d{5}\b"
STAFF_OR_MEMBER = r"\b(?:AGT|MBR)-\d+\b"
HOME_PATH = r"/(?:home|Users)/[^/\s'\"`]+/"
CALL_LINE = "Call ID"
TURN = r"(?:^|(?<=\s))(MEMBER|AGENT):"
TOOL_FAILURE = (r"TOOL ERROR \(|query_metric error:"
                r"|is already defined for this MetaData instance")
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def mask_accounts(text: Column) -> Column:
    """Every account number keeps only its last four digits; amounts and ids stay."""
    return F.regexp_replace(text, ACCOUNT, "****$1")


def call_ids(text: Column, pattern: str = CALL_ID) -> Column:
    """The distinct call ids named in a text, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def clean_label(text: Column, limit: int) -> Column:
    """A label without staff or member ids, one space between words, at most `limit` long."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), STAFF_OR_MEMBER, "")
    return F.trim(F.substring(squeeze(bare), 1, limit))


def split_turns(text: Column) -> Column:
    """`MEMBER: … AGENT: …` as an array of turns, label kept; unmarked text is one turn."""
    body = squeeze_ends(text)
    marked = F.regexp_replace(body, TURN, "\u0001$1:")
    parts = F.split(marked, "\u0001")
    turns = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), squeeze_ends)
    one_space = F.transform(turns, lambda t: F.regexp_replace(t, r"^(MEMBER|AGENT):\s*", "$1: "))
    return F.when(F.size(parts) > 1, one_space).otherwise(F.array(body))


def squeeze_ends(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def transcripts(turns: DataFrame, call: str = "conv_id", order: str = "turn",
                speaker: str = "role", text: str = "text") -> DataFrame:
    """One row per call: utterances in order, turn_count and full_text ("SPEAKER: …" by space).

    A call's turns are its document, which is one row wherever it is stored.
    """
    spoken = F.array_sort(F.collect_list(F.struct(
        F.col(order).alias("at"), F.upper(speaker).alias("speaker"), F.col(text).alias("text"))))
    return turns.groupBy(call).agg(spoken.alias("u")).select(
        call, F.transform("u", lambda r: F.struct(r["speaker"].alias("speaker"), r["text"].alias("text"))).alias(
            "utterances"),
        F.size("u").alias("turn_count"),
        F.array_join(F.transform("u", lambda r: F.concat(r["speaker"], F.lit(": "), r["text"])), " ").alias(
            "full_text"))


def transcript_view(header: dict[str, Column], seconds: Column, text: Column) -> Column:
    """Header lines, the length as m:ss ("unknown" without one), and the dialogue, all masked.

    The call's own id and its length are no account numbers, however many digits they have: they stay.
    """
    length = F.coalesce(F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"),
                                 F.lpad((seconds % 60).cast("string"), 2, "0")), F.lit("unknown"))
    names = list(header)
    lines = [F.concat(F.lit(f"{n}: "), F.coalesce(header[n].cast("string"), F.lit("None"))) for n in names]
    lines = [line if n == CALL_LINE else mask_accounts(line) for n, line in zip(names, lines)]
    lines.insert(2, F.concat(F.lit("Duration: "), length, F.lit(" (minutes:seconds)")))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\nTRANSCRIPT:\n"), mask_accounts(text))


def citation_context(df: DataFrame, turns: str, quote: str, key: str, around: int = 1) -> DataFrame:
    """The first turn holding the quote with its neighbours: key, cited, turns, position, shown, mark."""
    masked = df.select(key, F.transform(turns, mask_accounts).alias("t"), mask_accounts(F.col(quote)).alias("q"))
    placed = masked.withColumn("cited", F.array_position(
        F.transform("t", lambda x: x.contains(F.col("q"))), True))
    near = placed.filter("cited > 0").select(
        key, "cited", F.size("t").alias("of"), F.posexplode("t").alias("pos", "shown"))
    return near.filter(F.abs(F.col("pos") + 1 - F.col("cited")) <= around).select(
        key, "cited", "of", (F.col("pos") + 1).alias("position"), "shown",
        (F.col("pos") + 1 == F.col("cited")).alias("mark"))


def redact_home(text: Column) -> Column:
    return F.regexp_replace(text, HOME_PATH, "~/")


def redact_values(text: Column, secrets: list[str]) -> Column:
    """Listed values become <redacted>, the longest first so no part of one is left."""
    for value in sorted({s for s in secrets if len(s) > 3}, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(value), F.lit("<redacted>"))
    return text


def tool_error(answer: Column) -> Column:
    """The line of the first tool failure in an answer (at most 300 characters), or NULL."""
    line = F.regexp_extract(answer, rf"(?m)^(.*?(?:{TOOL_FAILURE}).*)$", 1)
    return F.when(answer.rlike(TOOL_FAILURE), F.substring(F.trim(line), 1, 300))

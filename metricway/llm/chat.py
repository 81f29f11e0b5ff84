"""Chat formatting: a machine over roles, and text segments with loss flags from a declarative template.

The template names, for each role, the text before and after a turn, and the machine's transitions. A turn
gives three segments: head, body and tail; only bodies of the roles in `loss` carry the loss flag. Control
strings inside a text are broken by a backslash after their first character, and backslashes are doubled,
so that a control string in the output is always a mark of the template and every text can be read back.

Defined cases: a null text is an empty body; turns are ordered by turn, then role and text, so ties and
repeated rows have one order; a null or unknown role is a turn of the fallback role's form with its own name,
never in the loss, and makes the order invalid; a null conversation id is a conversation of its own; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """heads: text before a turn by role ({role} for roles not listed); tail: text after each turn;
    controls: strings that no escaped text may contain; steps: allowed (role before, role), None at the start;
    ends: roles that may end a conversation; loss: roles whose texts are trained on."""

    heads: dict[str, str]
    tail: str
    controls: tuple[str, ...]
    steps: tuple[tuple[str | None, str], ...]
    ends: tuple[str, ...]
    loss: tuple[str, ...] = ("assistant",)
    other: str = "### Role {role}: "


MARKED = Template(
    heads={"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "},
    tail="</turn>\n",
    controls=("###", "</turn>"),
    steps=((None, "system"), (None, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")),
    ends=("user", "assistant"),
)


def escaped(text: Column, template: Template = MARKED) -> Column:
    """Backslashes doubled, then one put behind the first character of every control string."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in template.controls:
        first, rest = _quoted(control[0]), _quoted(control[1:])
        out = F.regexp_replace(out, f"{first}(?={rest})", _substitute(control[0]) + "\\\\")
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _quoted(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def _substitute(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def head(role: Column, template: Template = MARKED) -> Column:
    before, after = template.other.split("{role}")
    out = F.concat(F.lit(before), escaped(role, template), F.lit(after))
    for name, text in template.heads.items():
        out = F.when(role == name, F.lit(text)).otherwise(out)
    return out


def segments(df: DataFrame, template: Template = MARKED, conv: str = "conv_id", turn: str = "turn",
             role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, role, head, body, tail, loss, step_ok): a row for each turn, in order by place.

    step_ok is the machine's verdict on the step from the role before it, and for the last turn also on ending there.
    """
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                     F.col(text).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag("role").over(order)
    place = F.row_number().over(order)
    last = F.lead(F.lit(1)).over(order).isNull()
    rows = rows.select("conv_id", "role", "text", place.alias("place"), before.alias("before"), last.alias("last"))
    allowed = F.lit(False)
    for was, now in template.steps:
        start = (F.col("place") == 1) if was is None else ((F.col("place") > 1) & (F.col("before") == was))
        allowed = allowed | (start & (F.col("role") == now))
    ending = ~F.col("last") | F.col("role").isin(*template.ends)
    return rows.select(
        "conv_id", "place", "role", head(F.col("role"), template).alias("head"),
        escaped(F.col("text"), template).alias("body"), F.lit(template.tail).alias("tail"),
        F.coalesce(F.col("role").isin(*template.loss), F.lit(False)).alias("loss"),
        F.coalesce(allowed & ending, F.lit(False)).alias("step_ok"))


def formatted(df: DataFrame, template: Template = MARKED, **columns: str) -> DataFrame:
    """(conv_id, formatted, loss_spans, valid): one text for each conversation.

    loss_spans: (start, length) in code points of the text, one for each body under the loss mask, in order.
    A conversation is one text, so it is gathered in one row.
    """
    rows = segments(df, template, **columns)
    turns = F.array_sort(F.collect_list(F.struct("place", "head", "body", "tail", "loss")))
    out = rows.groupBy("conv_id").agg(turns.alias("turns"), F.min("step_ok").alias("valid"))
    out = out.select("conv_id", "valid", F.array_join(F.transform(
        "turns", lambda t: F.concat(t["head"], t["body"], t["tail"])), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(
            F.length(t["head"]).cast("long").alias("h"), F.length(t["body"]).cast("long").alias("b"),
            F.length(t["tail"]).cast("long").alias("t"), t["loss"].alias("loss"))).alias("sizes"))
    start = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans"))
    walked = F.aggregate("sizes", start, lambda acc, s: F.struct(
        (acc["at"] + s["h"] + s["b"] + s["t"]).alias("at"),
        F.when(s["loss"], F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + s["h"]).alias("start"), s["b"].alias("length"))))).otherwise(acc["spans"]).alias("spans")))
    return out.select("conv_id", "formatted", walked["spans"].alias("loss_spans"), "valid")


def read_back(df: DataFrame, template: Template = MARKED) -> DataFrame:
    """The rows of `formatted` with `turns` (role, text) parsed from the text, and `loss_texts` cut out by the spans."""
    before, after = template.other.split("{role}")
    def parsed(piece: Column) -> Column:
        role = unescaped(F.regexp_extract(
            piece, f"(?s)^{_quoted(before)}((?:(?!{_quoted(after)}).)*)", 1))
        rest = F.substr(piece, F.instr(piece, after) + len(after)) if after else piece
        out = F.struct(role.alias("role"), unescaped(rest).alias("text"))
        for name, text in template.heads.items():
            out = F.when(F.startswith(piece, F.lit(text)), F.struct(
                F.lit(name).alias("role"), unescaped(F.substr(piece, F.lit(len(text) + 1))).alias("text"))).otherwise(out)
        return out
    pieces = F.split(F.col("formatted"), _quoted(template.tail))
    own = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*own, F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parsed).alias("turns"),
                     F.transform("loss_spans", lambda s: unescaped(F.substr(
                         F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))).alias("loss_texts"))

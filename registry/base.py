"""Helpers shared by the query modules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricway.operators.star import Star
from metricway.sources.bindings import OLTP, Tables, sql_text
from registry.star_sql import STAR_SQL


def tables(spark, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def star(spark, sf_dir: str) -> Star:
    return Star(Tables(spark, sf_dir))


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, decimals as doubles: the types both engines print alike."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind.startswith("decimal"):
            column = column.cast("double")
        out.append(column.alias(name))
    return df.select(*out)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """`plain`, with every double rounded."""
    df = plain(df)
    return df.select(*(F.round(F.col(f"`{n}`"), digits).alias(n) if k == "double" else F.col(f"`{n}`")
                       for n, k in df.dtypes))


def texts(dates: str = "", times: str = "", decimals: str = "") -> str:
    """`* REPLACE (...)` doing in SQL what `plain` does in Spark."""
    parts = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates.split()]
    parts += [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in times.split()]
    parts += [f"CAST({c} AS DOUBLE) AS {c}" for c in decimals.split()]
    return "* REPLACE (" + ", ".join(parts) + ")" if parts else "*"


_KNOWN = {**{name: sql_text(name) for name in OLTP}, **STAR_SQL}
_NAME = re.compile(r"\b(" + "|".join(sorted(_KNOWN, key=len, reverse=True)) + r")\b")


def check(sql: str) -> str:
    """The SQL with a WITH clause for every operational or star table it names."""
    order: list[str] = []

    def visit(text: str, path: tuple = ()) -> None:
        for name in _NAME.findall(text):
            if name not in order and name not in path:
                visit(_KNOWN[name], (*path, name))
                order.append(name)

    visit(sql)
    if not order:
        return sql
    body = sql.strip()
    ctes = ", ".join(f"{n} AS ({_KNOWN[n].strip()})" for n in order)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"

"""Readers and writers: JSON arrays, JSON lines, CSV, result records, counted loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricway.operators.scoring import QUERY_TYPES
from metricway.sources import schemas

# The areas and keys of a results record.
AREAS = ("retrieval", "finetune", "serving", "evals", "semantics")
RECORD_KEYS = {"date": "text", "git_sha": "text", "area": "text", "run": "text", "hardware": "text", "versions": "object",
               "params": "object", "metrics": "object", "notes": "text"}


def read_json_array(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One file holding an array of objects, every value as text first, then as declared."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in schemas.declared(table)])
    return schemas.typed(spark.read.schema(text).option("multiLine", True).json(path), table)


def read_json_lines(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One object per line; the file splits over tasks."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in schemas.declared(table)])
    return schemas.typed(spark.read.schema(text).option("primitivesAsString", True).json(path), table)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object per row: NULLs written out, dates ISO, times with their offset."""
    (df.write.mode("overwrite").option("ignoreNullFields", False).option("dateFormat", "yyyy-MM-dd")
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in parallel ranges of a numeric column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def load_counted(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Replace each stored table and require that what is found is what was sent.

    The rows sent are counted while they are written; all mismatches are told together.
    """
    sent: dict[str, int] = {}
    for name, df in tables.items():
        seen = Observation(f"sent_{name}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}")
        sent[name] = seen.get["n"]
    spark = next(iter(tables.values())).sparkSession
    found = {n: spark.read.parquet(f"{folder}/{n}").count() for n in tables}
    wrong = [f"{n}: {found[n]} found, {sent[n]} sent" for n in tables if found[n] != sent[n]]
    if wrong:
        raise ValueError("; ".join(wrong))
    return sent


def best_effort(raw: DataFrame, *columns: str) -> DataFrame:
    """Each text cell as whole number, number or text: <column>_long, _double, _text; empty is NULL."""
    out = [c for c in raw.columns if c not in columns]
    for name in columns:
        cell = F.nullif(F.trim(F.col(name)), F.lit(""))
        whole, real = cell.try_cast("bigint"), cell.try_cast("double")
        whole = F.when(cell.rlike(r"^[+-]?\d+$"), whole)
        out += [whole.alias(f"{name}_long"), F.when(whole.isNull(), real).alias(f"{name}_double"),
                F.when(real.isNull(), cell).alias(f"{name}_text")]
    return raw.select(*out)


def read_result_csv(spark: SparkSession, path: str) -> DataFrame:
    """A result file: header in lower case, every cell as text; a file without rows is an error."""
    df = spark.read.option("header", True).csv(path)
    if df.isEmpty():
        raise ValueError(f"{path}: no rows")
    return df.toDF(*(c.lower() for c in df.columns))


# ── records ───────────────────────────────────────────────────────────────────

def record_errors(df: DataFrame) -> DataFrame:
    """Adds errors to result records read as (date, git_sha, …, versions MAP, params MAP, metrics MAP)."""
    def missing(name: str, kind: str):
        c = F.col(name)
        return c.isNull() if kind == "text" else c.isNull()

    absent = F.array_compact(F.array(*(F.when(missing(k, t), F.concat(F.lit("missing "), F.lit(k))) for k, t in RECORD_KEYS.items())))
    wrong = F.array_compact(F.array(
        F.when(~F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("date is not YYYY-MM-DD")),
        F.when(~F.col("area").isin(*AREAS), F.lit("unknown area")),
        *(F.when(F.trim(F.col(k)) == "", F.concat(F.lit(k), F.lit(" is empty"))) for k in ("git_sha", "run", "hardware")),
        F.when(~F.map_contains_key("versions", "python"), F.lit("versions has no python")),
        F.when(F.size("metrics") == 0, F.lit("metrics is empty"))))
    return df.withColumn("errors", F.when(F.size(absent) > 0, absent).otherwise(wrong))


def write_record(df: DataFrame, folder: str, name: str) -> str:
    """Write one valid record under its name, never over another, and point LATEST at it."""
    bad = record_errors(df).filter(F.size("errors") > 0).select("errors").limit(1).collect()
    if bad:
        raise ValueError("; ".join(bad[0].errors))
    df.write.mode("errorifexists").json(f"{folder}/{name}")
    spark = df.sparkSession
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").text(f"{folder}/LATEST")
    return f"{folder}/{name}"


def metrics_table(records: DataFrame, config: str = "config", names: str = "metric", value: str = "value",
                  columns: list[str] | None = None) -> DataFrame:
    """Long (config, metric, value) rows as one line per config; with known columns no extra pass."""
    return records.groupBy(config).pivot(names, columns).agg(F.first(value))


def query_errors(df: DataFrame) -> DataFrame:
    """Adds every schema error of labelled queries (id, type, query, derivation, relevant ARRAY)."""
    rel = F.col("relevant")
    errors = F.array_compact(F.array(
        *(F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in ("id", "type", "query", "derivation")),
        F.when(F.coalesce(~F.col("type").isin(*QUERY_TYPES), F.lit(False)), F.lit("unknown type")),
        F.when(rel.isNull(), F.lit("relevant missing")),
        F.when((F.size(rel) == 0) | (F.size(F.array_distinct(rel)) < F.size(rel)) | F.exists(rel, lambda x: x.isNull()),
               F.lit("relevant must be a non-empty list of unique ids"))))
    return df.withColumn("errors", errors)


def repeated_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def read_change_log(spark: SparkSession, path: str) -> DataFrame:
    """name, date of the logged changes in date order; entries without either are left out and a
    missing file is an empty log."""
    try:
        raw = spark.read.schema("name string, date string").option("multiLine", True).json(path)
    except Exception as error:  # noqa: BLE001 - only a missing path is an empty log
        if "PATH_NOT_FOUND" not in str(error):
            raise
        raw = spark.createDataFrame([], "name string, date string")
    return change_log(raw)


def change_log(raw: DataFrame) -> DataFrame:
    kept = raw.filter("coalesce(name, '') <> '' AND coalesce(date, '') <> ''")
    return kept.select("name", schemas.as_date(F.col("date")).alias("date")).orderBy("date", "name")

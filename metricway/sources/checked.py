"""Reading with provenance: every bad record with its file and line, all errors told together, and large arrays in parallel.

Files are read as lines by splits. A line's number is made of the numbers of lines in the splits before it, so it is exact without one task
reading a file. Records are parsed as VARIANT: what a value is can be asked before it is cast, so a wrong type is told apart from a
missing value and fails nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricway.session import written
from metricway.sources import files, schemas

# What a declared type takes of a JSON value.
TAKES = {"string": ("STRING",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
QUERY_FIELDS = {"id": "string", "type": "string", "query": "string", "derivation": "string", "relevant": "array"}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value, written: all lines of the files."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                       "value").withColumn("at", F.monotonically_increasing_id())
    rows = written(raw)
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row for each split
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return rows.join(offsets, ["file", "block"]).select(
        "file", (F.col("ahead") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def kind_of(value: Column) -> Column:
    """string, number, boolean, array, object or null, of a VARIANT value; NULL where there is none."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    out = F.when(F.is_variant_null(value), "null")
    for kind, names in TAKES.items():
        out = out.when(name.isin(*names), kind)
    return F.when(value.isNull(), F.lit(None)).otherwise(out)


def field(record: str, name: str) -> Column:
    return F.try_variant_get(record, f"$.{name}", "variant")


def read_records(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """file, line, record (VARIANT), errors: one JSON object a line; blank lines are none. fields: name and kind of what must be there."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    rows = lines.withColumn("record", F.try_parse_json("value"))
    kind = kind_of(F.col("record"))
    missing = [F.when(F.coalesce(kind_of(field("record", n)), F.lit("null")) == "null", F.lit(f"{n} missing")) for n in fields]
    wrong = [F.when((kind_of(field("record", n)) != k) & (kind_of(field("record", n)) != "null"), F.lit(f"{n} is no {k}"))
             for n, k in fields.items()]
    errors = F.when(F.coalesce(kind, F.lit("")) != "object", F.array(F.when(F.col("record").isNull(), "no JSON").otherwise("no object"))
                    ).otherwise(F.array_compact(F.array(*missing, *wrong)))
    return rows.select("file", "line", "record", "value", errors.alias("errors"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """file, line, id, type, query, derivation, relevant, errors: labelled queries with everything that is wrong with each, repeated ids included."""
    read = read_records(spark, path, QUERY_FIELDS)
    text = [F.when(kind_of(field("record", n)) == "string", F.try_variant_get("record", f"$.{n}", "string")).alias(n)
            for n in ("id", "type", "query", "derivation")]
    relevant = F.when(kind_of(field("record", "relevant")) == "array", F.try_variant_get("record", "$.relevant", "array<string>"))
    rows = files.query_errors(read.select("file", "line", *text, relevant.alias("relevant"), F.col("errors").alias("_read")))
    told = F.when(F.size("_read") > 0, F.col("_read")).otherwise(F.col("errors"))
    seen = rows.groupBy("id").agg(F.count("*").alias("_n"))
    out = rows.withColumn("errors", told).drop("_read").join(seen.filter("id IS NOT NULL AND _n > 1"), "id", "left")
    repeated = F.when(F.col("_n").isNotNull(), F.array(F.lit("id is repeated"))).otherwise(F.array().cast("array<string>"))
    return out.select("file", "line", "id", "type", "query", "derivation", "relevant", F.concat("errors", repeated).alias("errors"))


def require_clean(rows: DataFrame, show: int = 20) -> DataFrame:
    """The rows when none has an error; else an error that tells how many there are and the first, by file and line."""
    bad = rows.filter(F.size("errors") > 0)
    first = bad.orderBy("file", "line").select("file", "line", "errors").limit(show).collect()
    if first:
        told = "; ".join(f"{r.file.rsplit('/', 1)[-1]}:{r.line}: {', '.join(r.errors)}" for r in first)
        raise ValueError(f"{bad.count()} bad records: {told}")
    return rows.drop("errors")


def read_json_array(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of a file that is one array of objects, typed as declared.

    An array written with whole objects on its lines, one or several, is read by splits; one whose objects run over lines is read as one.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    bare = F.regexp_replace("value", r",$", "")
    # What begins with a bracket and parses is an array, so each text is parsed once.
    opens = bare.rlike(r"^\s*\[")
    items = F.coalesce(F.when(opens, F.try_parse_json(bare)), F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]"))),
                       F.when(opens, F.try_parse_json(F.concat(bare, F.lit("]")))), F.try_parse_json(F.concat(F.lit("["), bare)))
    rows = lines.filter(~F.col("value").isin("", "[", "]", ",", "[]")).select(items.alias("items"))
    names = list(schemas.declared(table))
    if rows.filter("items IS NULL").isEmpty():
        text = "array<struct<" + ",".join(f"`{n}`:string" for n in names) + ">>"
        laid = rows.select(F.explode(F.from_json(F.to_json("items"), text, {"primitivesAsString": "true"})).alias("r")).select("r.*")
        return schemas.typed(laid, table)
    return files.read_json_array(spark, path, table)


def read_result_csv(spark: SparkSession, path: str) -> DataFrame:
    """A result file with its header in lower case, every cell as text, and `errors` of rows with more or fewer cells than the header."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c.lower(), T.StringType()) for c in header] + [T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "_bad").csv(path)
    if rows.isEmpty():
        raise ValueError(f"{path}: no rows")
    bad = F.when(F.col("_bad").isNotNull(), F.array(F.concat(F.lit("cells do not fit the header: "), F.col("_bad")))).otherwise(
        F.array().cast("array<string>"))
    return rows.withColumn("errors", bad).drop("_bad")


# ── results records ───────────────────────────────────────────────────────────

def record_errors(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds errors to results records given as JSON text: types first, then what the values say."""
    rows = df.withColumn("_r", F.try_parse_json(value))

    def get(name: str) -> Column:
        return F.try_variant_get("_r", f"$.{name}", "string")
    kinds = {k: "string" if v == "text" else "object" for k, v in files.RECORD_KEYS.items()}
    shape = []
    for name, kind in kinds.items():
        own = F.coalesce(kind_of(field("_r", name)), F.lit("null"))
        shape.append(F.when(own == "null", F.lit(f"missing {name}")).when(own != kind, F.lit(f"{name} is no {'text' if kind == 'string' else kind}")))
    metrics = F.from_json(F.to_json(field("_r", "metrics")), "map<string,variant>")
    no_numbers = F.filter(F.map_keys(metrics), lambda k: ~kind_of(F.element_at(metrics, k)).isin("number", "object", "array"))
    values = [
        F.when(~get("date").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date(get("date")).isNull(), F.lit("date is not YYYY-MM-DD")),
        F.when(~get("area").isin(*files.AREAS), F.lit("unknown area")),
        *(F.when(F.trim(get(k)) == "", F.lit(f"{k} is empty")) for k in ("git_sha", "run", "hardware")),
        F.when(F.coalesce(kind_of(field("_r", "versions.python")), F.lit("null")) == "null", F.lit("versions has no python")),
        F.when(F.size(metrics) == 0, F.lit("metrics is empty")),
        F.when(F.size(no_numbers) > 0, F.concat(F.lit("no number: "), F.array_join(F.array_sort(no_numbers), ", ")))]
    wrong = F.array_compact(F.array(*shape))
    none = F.array(F.lit("no JSON object"))
    errors = F.when(F.coalesce(kind_of(F.col("_r")), F.lit("")) != "object", none).when(F.size(wrong) > 0, wrong).otherwise(
        F.array_compact(F.array(*values)))
    return rows.withColumn("errors", errors).drop("_r")


def result_name(day: str, run: str, taken: set[str]) -> str:
    """<date>_<run>, or with -2, -3, … where that is taken; a run's name keeps letters, digits, dots and dashes."""
    base = f"{day}_{re.sub(r'[^A-Za-z0-9.-]+', '-', run).strip('-')}"
    names = [base, *(f"{base}-{n}" for n in range(2, len(taken) + 3))]
    return next(n for n in names if n not in taken)


def write_record(df: DataFrame, folder: str, taken: set[str] = frozenset()) -> str:
    """Write one valid record, given as JSON text, under its own name and never over another, and point LATEST at it."""
    row = record_errors(df).first()
    if row is None or row.errors:
        raise ValueError("no record" if row is None else "; ".join(row.errors))
    day, run = df.select(*(F.try_variant_get(F.parse_json("value"), f"$.{k}", "string") for k in ("date", "run"))).first()
    name = result_name(day, run, set(taken))
    df.select("value").coalesce(1).write.mode("errorifexists").text(f"{folder}/{name}")
    df.sparkSession.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").text(f"{folder}/LATEST")
    return f"{folder}/{name}"

"""Keyed tables over time: upsert, prune, partial update, versions, retention.

A stored table is Parquet folders `version=N`; a version is complete when its marker row is in
the tags table, and is never changed afterwards. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricway.session import written

# The prefix of seed tags, how many are kept.
SEED = "seed-"
KEEP_SEEDS = 10


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """New rows replace old rows of the same key; the others stay. A key repeated in the new rows is stored once: its last row
    by `order`, and of equal ones (or without an order) the one whose JSON text is greatest, whatever the order of the input.

    Only the order and the text are compared, so columns may be of any type, maps included.
    """
    rest = [c for c in new.columns if c not in key]
    if rest:
        text = F.to_json(F.struct(*rest))
        new = new.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), text) if order else text).alias("_r")).select(
            *key, "_r.*").select(*new.columns)
    else:
        new = new.distinct()
    return new.unionByName(old.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)


def prune(old: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose key is in the batch."""
    return old.join(batch.select(*key), key, "left_semi")


def stale(old: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    return old.join(batch.select(*key), key, "left_anti")


def last_of_batch(batch: DataFrame, key: str, seq: str) -> DataFrame:
    """The last occurrence of each key: an aggregate that keeps one row per key in every task."""
    columns = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("_r")).select(key, "_r.*")


def ingest(store: DataFrame, batch: DataFrame, key: str = "call_id", seq: str = "seq") -> DataFrame:
    """A batch of documents into the store: the last of each id wins, then an upsert."""
    return upsert(store, last_of_batch(batch, key, seq).drop(seq), [key])


def set_scores(docs: DataFrame, surveys: DataFrame) -> DataFrame:
    """Survey columns of every row replaced: the score of the call's last survey, or NULL without a survey.

    A score off the scale fails the job: nothing of the batch is stored.
    """
    refused = F.col("csat_score").isNotNull() & ~F.col("csat_score").between(1, 5)
    score = F.when(refused, F.raise_error(F.concat(F.lit("score off the scale: "), F.col("csat_score")))).otherwise(
        F.col("csat_score"))
    fresh = surveys.select("call_id", score.alias("csat_score"), "surveyed_at").groupBy("call_id").agg(
        F.max(F.struct("surveyed_at", "csat_score")).alias("_s")).select("call_id", "_s.csat_score", "_s.surveyed_at")
    return docs.drop("csat_score", "surveyed_at").join(fresh, "call_id", "left")


def refused_scores(surveys: DataFrame) -> DataFrame:
    """Surveys off the scale: must be empty before scores are set."""
    return surveys.filter(~F.col("csat_score").between(1, 5))


# ── a table in bucket folders ─────────────────────────────────────────────────

def bucket_of(key: Column, buckets: int) -> Column:
    """A number below `buckets` from the MD5 of a key."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def create_buckets(df: DataFrame, folder: str, key: str, buckets: int) -> None:
    """The rows as folders bucket=N by key; one row a key, with the order column that later batches compare."""
    _write_buckets(df.withColumn("bucket", bucket_of(F.col(key), buckets)), folder, key)


def _write_buckets(rows: DataFrame, folder: str, key: str) -> None:
    """Replace the folders of the buckets that the rows are in. A bucket is written by a few tasks."""
    rows.repartition(F.col("bucket"), F.pmod(F.xxhash64(key), F.lit(4))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def ingest_buckets(folder: str, batch: DataFrame, key: str, seq: str, buckets: int) -> list[int]:
    """A batch into a table of bucket folders; the buckets that were rewritten.

    Only the buckets of the batch's keys are read and replaced; the others keep their files. The row with the greatest
    `seq` of a key stays, wherever it comes from, so a batch that comes again, or late, changes nothing that is newer. What
    replaces a bucket is written aside first: a job that fails on the way leaves the table as it was, or is run again.
    """
    spark = batch.sparkSession
    batch = written(batch.withColumn("bucket", bucket_of(F.col(key), buckets)))
    touched = sorted(r[0] for r in batch.select("bucket").distinct().collect())  # `buckets` numbers at most
    if not touched:
        return []
    old = spark.read.parquet(folder).filter(F.col("bucket").isin(touched))
    rest = [c for c in old.columns if c != key]
    both = old.unionByName(batch, allowMissingColumns=True).groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(F.col(seq), F.sha2(F.to_json(F.struct(*rest)), 256))).alias("_r"))  # a text travels once
    _write_buckets(written(both.select(key, "_r.*")), folder, key)
    return touched


def bucket_files(spark, folder: str) -> DataFrame:
    """bucket, files: which files each bucket consists of."""
    return spark.read.parquet(folder).select("bucket", F.col("_metadata.file_path").alias("file")).distinct().groupBy(
        "bucket").agg(F.array_sort(F.collect_list("file")).alias("files"))  # a bucket's few files


# ── documents from transcripts ────────────────────────────────────────────────

def documents(transcripts: DataFrame, interactions: DataFrame, bridge: DataFrame, members: DataFrame) -> DataFrame:
    """Transcripts with their interaction, accounts (subject first) and the member's branch.

    A call refers to a handful of accounts, so its list is bounded.
    """
    role = F.when(F.col("account_role") == "subject", 0).otherwise(1)
    accounts = bridge.groupBy("interaction_id").agg(F.array_sort(F.collect_set(F.struct(
        role.alias("role"), F.col("account_id")))).alias("a")).select(
            "interaction_id", F.transform("a", lambda x: x["account_id"]).alias("account_ids"))
    ids = interactions.select("call_id", "interaction_id")
    branch = members.select("member_id", "home_branch")
    return (transcripts.join(ids, "call_id", "left").join(accounts, "interaction_id", "left").join(branch, "member_id", "left")
            .withColumn("account_id", F.try_element_at("account_ids", F.lit(1))))


def attach_surveys(docs: DataFrame, surveys: DataFrame, number: Column) -> DataFrame:
    """call_id, csat_score, surveyed_at for documents with a survey, matched by interaction id or by
    the number in the call id; surveys of no document fall away."""
    keyed = docs.select("call_id", F.coalesce("interaction_id", number).alias("interaction_id"))
    return keyed.join(surveys.select("interaction_id", F.col("score").alias("csat_score"), "surveyed_at"), "interaction_id").select(
        "call_id", "csat_score", "surveyed_at")


# ── versions ──────────────────────────────────────────────────────────────────

def tag_name(label: str, taken: set[str]) -> str:
    """seed-<label>, or seed-<label>-2, -3, … when taken."""
    base = f"{SEED}{label}"
    names = [base] + [f"{base}-{n}" for n in range(2, len(taken) + 3)]
    return next(n for n in names if n not in taken)


def expired_tags(tags: DataFrame, keep: int = KEEP_SEEDS) -> DataFrame:
    """Seed tags beyond the newest `keep` of each table (column `store`); other tags never expire."""
    seeds = tags.filter(F.col("name").startswith(SEED))
    place = F.row_number().over(Window.partitionBy("store").orderBy(F.desc("version"), F.desc("name")))
    newest = seeds.withColumn("place", place).filter(F.col("place") <= keep)  # each task keeps `keep` a store
    return seeds.join(newest.select("store", "name"), ["store", "name"], "left_anti")


def droppable_versions(versions: DataFrame, tags: DataFrame, days: int = 14, today: Column | None = None) -> DataFrame:
    """Versions older than their table's oldest tagged one; without tags, those older than `days`,
    never the newest."""
    oldest = tags.groupBy("store").agg(F.min("version").alias("oldest"))
    newest = versions.groupBy("store").agg(F.max("version").alias("newest"))
    rows = versions.join(oldest, "store", "left").join(newest, "store")
    aged = F.col("written") < F.date_sub(F.current_date() if today is None else today, days)
    return rows.filter(F.when(F.col("oldest").isNotNull(), F.col("version") < F.col("oldest")).otherwise(
        aged & (F.col("version") < F.col("newest")))).drop("oldest", "newest")


class VersionedTable:
    """A table whose versions stay readable: publish, tag, read as of, roll back."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def _meta(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as error:  # noqa: BLE001 - only a table not yet written is empty
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def versions(self) -> DataFrame:
        return self._meta("versions", "version int, made_from string")

    def tags(self) -> DataFrame:
        return self._meta("tags", "name string, version int")

    def newest(self) -> int:
        return self.versions().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def publish(self, df: DataFrame, made_from: str = "batch") -> int:
        """Write the next version, then make it visible by its marker row."""
        number = self.newest() + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/data/version={number}")
        self.spark.createDataFrame([(number, made_from)], "version int, made_from string").coalesce(1).write.mode(
            "append").parquet(f"{self.folder}/versions")
        return number

    def tag(self, label: str) -> str:
        """Tag the newest version seed-<label>."""
        taken = {r.name for r in self.tags().collect()}  # at most some tens of tags
        name = tag_name(label, taken)
        self.spark.createDataFrame([(name, self.newest())], "name string, version int").coalesce(1).write.mode(
            "append").parquet(f"{self.folder}/tags")
        return name

    def resolve(self, ref: int | str) -> int:
        if isinstance(ref, str) and not ref.isdigit():
            hit = self.tags().filter(F.col("name") == ref).first()
            if hit is None:
                raise ValueError(f"no tag {ref!r}")
            return hit.version
        if self.versions().filter(F.col("version") == int(ref)).isEmpty():
            raise ValueError(f"no version {ref!r}")
        return int(ref)

    def as_of(self, ref: int | str | None = None) -> DataFrame:
        """A version (the newest without `ref`), read from its own folder only."""
        number = self.newest() if ref is None else self.resolve(ref)
        return self.spark.read.parquet(f"{self.folder}/data/version={number}")

    def rollback(self, ref: int | str) -> int:
        """An old version published again as the newest; what lies between stays readable."""
        return self.publish(self.as_of(ref), f"rollback of {ref}")

"""Sources, sinks, ingestion and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from metricway.operators import embed as E
from metricway.operators import store as S
from metricway.session import shared_folder, written
from metricway.sources import checked, files, schemas
from registry.base import check, plain, rounded, tables
from registry.searches import STORE_SQL, doc_store


def scratch(spark) -> str:
    """A new place in the folder all executors share."""
    return f"{shared_folder(spark)}/metricway-{uuid.uuid4().hex}"


def json_lines(spark, sf):
    """Calls written as JSON lines, read back as text and cast to their declared types."""
    where = scratch(spark)
    files.write_json_lines(tables(spark, sf)["interaction"], where)
    return plain(files.read_json_lines(spark, where, "interaction"))


def typed_ledger(spark, sf):
    """The ledger with every value as text, typed again; fee_type is not in the source."""
    raw = tables(spark, sf)["account_transaction"]
    text = raw.select(*(F.col(c).cast("string").alias(c) for c in raw.columns))
    t = schemas.typed(text, "account_transaction")
    return rounded(t.groupBy("txn_type", "fee_type").agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount"), F.min("posted_at").alias("first"),
        F.max(F.col("transaction_id")).alias("last_id")), 2)


def dates_and_numbers(spark, sf):
    """Days of ISO times, and the numbers in call ids."""
    store = doc_store(spark, sf)
    return plain(store.select("doc_id", schemas.as_date(F.col("date")).alias("day"),
                              schemas.call_number(F.col("call_id")).alias("number")))


def transcript_table(spark, sf):
    from metricway.functions.text import transcripts

    t = transcripts(tables(spark, sf)["conversations"]).select(
        F.concat(F.lit("CALL-"), F.lpad(F.col("conv_id").cast("string"), 12, "0")).alias("call_id"), "full_text",
        F.col("utterances").alias("transcript"))
    rows = schemas.transcript_rows(t)
    back = F.from_json("utterances", "array<struct<speaker:string,text:string>>")
    return rows.select("interaction_id", "turn_count", F.length("full_text").alias("chars"),
                       F.element_at(back, -1)["speaker"].alias("last_speaker"))


def counted_load(spark, sf):
    t = tables(spark, sf)
    names = ("household", "member", "account", "csat_survey", "account_transaction")
    sent = files.load_counted({n: t[n] for n in names}, scratch(spark))
    return spark.createDataFrame(list(sent.items()), "name string, n long")


def upserted(spark, sf):
    """Balances replaced by those of customers with an order in 1996; new customers are added."""
    t = tables(spark, sf)
    old = t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    orders = t["orders"].filter((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1997-01-01"))
    new = orders.groupBy((F.col("o_custkey") * 2).alias("id")).agg(F.max("o_totalprice").alias("balance"))
    return S.upsert(old, new, ["id"])


_UPSERT = """new AS (SELECT o_custkey * 2 AS id, max(o_totalprice) AS balance FROM orders
        WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY 1)"""


def pruned(spark, sf):
    t = tables(spark, sf)
    return S.prune(t["csat_survey"], t["interaction"], ["interaction_id"]).select("survey_id", "interaction_id")


def gone(spark, sf):
    t = tables(spark, sf)
    return S.stale(t["csat_survey"], t["interaction"], ["interaction_id"]).groupBy("score").agg(F.count("*").alias("n"))


def last_wins(spark, sf):
    """Each customer's last order as the document of that customer, into a store of all customers."""
    t = tables(spark, sf)
    store = t["customer"].select(F.col("c_custkey").alias("call_id"), F.col("c_mktsegment").alias("text"))
    batch = t["orders"].select(F.col("o_custkey").alias("call_id"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("seq"))
    return S.ingest(store, batch)


def scored(spark, sf):
    """Scores of all documents replaced by a new survey of the labelled ones; those off the scale refused."""
    t = tables(spark, sf)
    docs = t["documents"].select(F.col("doc_id").alias("call_id"), "lang", F.lit(3).alias("csat_score"), F.lit("2026-01-01").alias("surveyed_at"))
    return S.set_scores(docs, surveys(spark, sf).filter(F.col("csat_score").between(1, 5)))


def surveys(spark, sf):
    t = tables(spark, sf)
    return t["labels"].select(F.col("doc_id").alias("call_id"), (F.col("quality") * 5 + F.col("toxic")).alias("csat_score"),
                              F.lit("2026-08-31").alias("surveyed_at"))


def enriched(spark, sf):
    """Conversations with their interaction, accounts and the member's branch."""
    t = tables(spark, sf)
    calls = t["conversations"].groupBy("conv_id").agg(F.count("*").alias("turns")).select(
        F.concat(F.lit("CALL-"), F.lpad(F.col("conv_id").cast("string"), 12, "0")).alias("call_id"), F.col("conv_id").alias("member_id"), "turns")
    ids = t["interaction"].select(F.concat(F.lit("CALL-"), F.lpad(F.col("interaction_id").cast("string"), 12, "0")).alias("call_id"), "interaction_id")
    return S.documents(calls, ids, t["interaction_account"], t["member"])


def enriched_rows(spark, sf):
    d = enriched(spark, sf)
    return d.select("call_id", "interaction_id", "account_id", F.array_join(
        F.transform("account_ids", lambda a: a.cast("string")), ",").alias("account_ids"), "home_branch", "turns")


def surveyed(spark, sf):
    d = enriched(spark, sf)
    return plain(S.attach_surveys(d, tables(spark, sf)["csat_survey"], schemas.call_number(F.col("call_id"))))


def reused(spark, sf):
    """Vectors of the documents: stored ones are reused unless the text or the model changed."""
    t = tables(spark, sf)
    docs = t["documents"].select(F.col("doc_id").cast("string").alias("call_id"), "text", "n_chars")
    store = docs.select(
        "call_id", E.content_hash(F.when(F.col("n_chars") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"),
        F.when(F.col("n_chars") % 5 == 0, "old").otherwise("new").alias("embedding_model"),
        F.array(F.lit(0.0).cast("float")).alias("vector"))
    made = E.embed_new(docs, store, "new", E.embedder(lambda texts: [[float(len(x))] for x in texts]))
    return made.select("call_id", "reused", F.element_at("vector", 1).cast("double").alias("v"), "content_hash")


def guard(spark, sf):
    """Rows of another model that a batch of the German and French documents would leave behind."""
    d = tables(spark, sf)["documents"]
    store = d.select(F.col("doc_id").alias("call_id"), F.when(F.col("n_chars") % 4 == 0, None).when(
        F.col("n_chars") % 4 == 1, "old").otherwise("new").alias("embedding_model"))
    return E.other_model_rows(store, d.filter("lang IN ('de', 'fr')").select(F.col("doc_id").alias("call_id")), "new")


def scaled(spark, sf):
    """Three copies of each document's id, and the relevant lists that follow."""
    d = tables(spark, sf)["documents"].select(F.col("doc_id").cast("string").alias("call_id"), "lang")
    copies = E.scale_up(d, 3)
    relevant = F.array_join(E.scaled_relevant(F.array("source_id"), 3), ",")
    return copies.select("call_id", "replica", relevant.alias("relevant"))


def shaken(spark, sf):
    """Two copies of each vector: the first unchanged, the second within a hair of it."""
    v = tables(spark, sf)["embeddings"].select(F.col("vec_id").cast("string").alias("call_id"), F.col("embedding").alias("vector"),
                                              F.col("vec_id").cast("string").alias("text"))
    both = E.jittered(E.scale_up(v, 2))
    moved = both.join(v.select(F.col("call_id").alias("source_id"), F.col("vector").alias("was")), "source_id")
    dot = F.aggregate(F.zip_with("vector", "was", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return moved.select("call_id", "replica", (dot > 0.995).alias("close"), (F.abs(1 - dot) < 1e-6).alias("same"))


def rolled_back(spark, sf):
    """Customers published, changed, published again and rolled back: the first version is newest."""
    t = tables(spark, sf)
    table = S.VersionedTable(spark, scratch(spark))
    first = t["customer"].select("c_custkey", "c_acctbal")
    table.publish(first)
    tag = table.tag("base")
    table.publish(first.withColumn("c_acctbal", F.lit(0.0)))
    table.tag("base")
    table.rollback(tag)
    marks = table.tags().agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tags"))
    return table.as_of().withColumn("tags", marks.select("tags").scalar()).withColumn("version", F.lit(table.newest()))


def tags_of(spark, sf):
    o = tables(spark, sf)["orders"]
    return o.select(F.col("o_orderpriority").alias("store"), F.col("o_orderkey").alias("version"), F.concat(
        F.when(F.col("o_custkey") % 3 == 0, "keep-").otherwise("seed-"), F.col("o_orderkey").cast("string")).alias("name"))


def expired(spark, sf):
    return S.expired_tags(tags_of(spark, sf)).groupBy("store").agg(F.count("*").alias("n"), F.max("version").alias("newest"))


def droppable(spark, sf):
    """Versions older than the oldest seed tag that is kept; one store has no tag at all."""
    o = tables(spark, sf)["orders"]
    versions = o.select(F.col("o_orderpriority").alias("store"), F.col("o_orderkey").alias("version"), F.to_date("o_orderdate").alias("written"))
    tags = tags_of(spark, sf).filter("name LIKE 'seed-%' AND store <> '5-LOW'")
    kept = tags.join(S.expired_tags(tags).select("name"), "name", "left_anti")
    gone = S.droppable_versions(versions, kept, 14, F.lit("2000-01-01").cast("date"))
    return gone.groupBy("store").agg(F.count("*").alias("n"), F.max("version").alias("newest"))


def records_checked(spark, sf):
    """A results record per order, some without a key, with a bad date, area or empty metrics."""
    o = tables(spark, sf)["orders"]
    k = F.col("o_orderkey")
    text = F.create_map(F.lit("python"), F.lit("3"))
    rows = o.select(
        k.alias("id"), F.when(k % 5 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.when(k % 7 == 0, None).otherwise(F.lit("abc1234")).alias("git_sha"),
        F.when(k % 11 == 0, "elsewhere").otherwise("retrieval").alias("area"), F.lit("run").alias("run"),
        F.when(k % 13 == 0, "  ").otherwise("laptop").alias("hardware"),
        F.when(k % 17 == 0, F.create_map(F.lit("java"), F.lit("17"))).otherwise(text).alias("versions"), text.alias("params"),
        F.when(k % 19 == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(text).alias("metrics"), F.lit("").alias("notes"))
    return files.record_errors(rows).select("id", F.array_join("errors", "; ").alias("errors"))


def pivoted(spark, sf):
    """Mean price per order priority and line status, as a table of configs and metrics."""
    t = tables(spark, sf)
    rows = t["lineitem"].groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_extendedprice"), 2).alias("value"))
    return files.metrics_table(rows, "l_returnflag", "l_linestatus", "value", ["F", "O"])


def typed_cells(spark, sf):
    p = tables(spark, sf)["part"]
    k = F.col("p_partkey")
    cell = F.when(k % 4 == 0, F.col("p_size").cast("string")).when(k % 4 == 1, F.col("p_retailprice").cast("string")).when(
        k % 4 == 2, F.col("p_name")).otherwise("  ")
    return files.best_effort(p.select("p_partkey", cell.alias("cell")), "cell")


def labelled(spark, sf):
    o = tables(spark, sf)["orders"]
    k = F.col("o_orderkey")
    ids = F.array(F.lit("a"), F.when(k % 5 == 0, "a").otherwise("b"))
    return o.select((k % 10000).cast("string").alias("id"), F.when(k % 3 == 0, "other").otherwise("exact").alias("type"),
                    F.when(k % 7 > 0, "q").alias("query"), F.lit("d").alias("derivation"),
                    F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(ids).alias("relevant"))


def labelled_errors(spark, sf):
    return files.query_errors(labelled(spark, sf)).groupBy(F.array_join("errors", "; ").alias("errors")).agg(F.count("*").alias("n"))


def logged(spark, sf):
    """A change log made of the orders' days: entries without a name or a date are left out."""
    o = tables(spark, sf)["orders"]
    raw = o.select(F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("change "), F.col("o_orderkey").cast("string"))).otherwise("").alias("name"),
                   F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).alias("date"))
    return plain(files.change_log(raw))


def hashes(spark, sf):
    return tables(spark, sf)["documents"].select("doc_id", E.content_hash(F.col("text")).alias("hash"))


def bucketed(spark, sf):
    """Documents in bucket folders; toxic ones come again without their text. Buckets without one keep their files, and the batch that
    comes a second time, or an older one, changes no row."""
    where, buckets = scratch(spark), 128
    t = tables(spark, sf)
    docs = t["documents"].select("doc_id", "text", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"), F.lit(1).alias("seq"))
    S.create_buckets(docs, where, "doc_id", buckets)
    before = written(S.bucket_files(spark, where))
    toxic = t["labels"].filter("toxic = 1").select("doc_id").distinct()
    batch = docs.join(toxic, "doc_id").withColumn("text", F.lit("[removed]")).withColumn("seq", F.lit(2))
    S.ingest_buckets(where, batch, "doc_id", "seq", buckets)
    after = written(S.bucket_files(spark, where))
    row = F.xxhash64("doc_id", "text", "seq", F.to_json("metadata")).cast("decimal(38,0)")
    first = written(spark.read.parquet(where).groupBy("bucket").agg(
        F.sum(row).alias("a"), F.count("*").alias("rows"), F.count_if(F.col("text") == "[removed]").alias("removed"),
        F.count(F.col("metadata")["lang"]).alias("with_lang")))  # a row for each bucket, before the batch comes again
    S.ingest_buckets(where, batch.unionByName(docs.filter("doc_id % 3 = 0")), "doc_id", "seq", buckets)
    def content(df, name):
        return df.groupBy("bucket").agg(F.sum(row).alias(name))
    again = first.select("bucket", "a").join(content(spark.read.parquet(where), "b"), "bucket").select("bucket", (F.col("a") == F.col("b")).alias("same"))
    files_ = before.join(after.withColumnRenamed("files", "now"), "bucket").select("bucket", (F.col("files") != F.col("now")).alias("rewritten"))
    counts = first.drop("a")
    return counts.join(files_, "bucket").join(again, "bucket")


def upsert_maps(spark, sf):
    """Rows with a map column, some repeated in the batch: the last by order stays."""
    d = tables(spark, sf)["documents"]
    old = d.select("doc_id", F.create_map(F.lit("source"), F.col("source")).alias("metadata"), F.lit(0).alias("seq"))
    new = d.filter("doc_id % 4 = 0").select("doc_id", F.explode(F.array(F.lit(2), F.lit(3), F.lit(1))).alias("seq"), "lang").select(
        "doc_id", F.create_map(F.lit("source"), F.concat_ws("-", "lang", "seq")).alias("metadata"), "seq")
    return S.upsert(old, new, ["doc_id"], "seq").select("doc_id", F.col("metadata")["source"].alias("source"), "seq")


def json_array(spark, sf):
    """The ledger's interactions written as one array of objects over lines, and read by splits."""
    where = scratch(spark)
    rows = tables(spark, sf)["interaction"].select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    # The first file has the opening bracket, the last one the closing: Spark writes the parts in the order of a union.
    ends = [spark.createDataFrame([(x,)], "value string").coalesce(1) for x in "[]"]
    ends[0].unionByName(rows.select(F.concat("value", F.lit(",")).alias("value"))).unionByName(ends[1]).write.text(where)
    back = checked.read_json_array(spark, where, "interaction")
    return back.groupBy("category_code").agg(F.count("*").alias("n"), F.max("interaction_id").alias("last"))


def query_file(spark, sf):
    """Labelled queries as JSON lines, some broken, read with what is wrong and where."""
    where = scratch(spark)
    o = tables(spark, sf)["orders"]
    k = F.col("o_orderkey")
    relevant = F.when(k % 11 == 0, F.lit("[]")).when(k % 13 == 0, F.lit('"a"')).otherwise(F.lit('["a","b"]'))
    record = F.concat(F.lit('{"id": '), F.when(k % 7 == 0, F.lit("5")).otherwise(F.concat(F.lit('"'), k.cast("string"), F.lit('"'))),
                      F.lit(', "type": "exact", "query": '), F.when(k % 5 == 0, F.lit("null")).otherwise(F.lit('"q"')),
                      F.lit(', "derivation": "d", "relevant": '), relevant, F.lit("}"))
    line = F.when(k % 17 == 0, F.lit("{broken")).when(k % 19 == 0, F.lit("[1]")).otherwise(record)
    o.select(line.alias("value")).write.text(where)
    rows = checked.read_queries(spark, where)
    return rows.groupBy(F.array_join("errors", "; ").alias("errors")).agg(
        F.count("*").alias("n"), F.count_distinct("file", "line").alias("lines"))


def typed_records(spark, sf):
    """Results records as JSON text, some with values of a wrong type."""
    o = tables(spark, sf)["orders"]
    k = F.col("o_orderkey")
    def text(name, wrong, bad):
        return F.concat(F.lit(f'"{name}": '), F.when(wrong, F.lit(bad)).otherwise(F.lit('"x"')))
    value = F.concat(
        F.lit('{"date": '), F.when(k % 5 == 0, F.lit('"2026-13-45"')).otherwise(F.lit('"2026-01-02"')), F.lit(', "area": "evals", '),
        text("git_sha", k % 7 == 0, "12"), F.lit(", "), text("run", k % 11 == 0, "null"), F.lit(', "notes": "", '),
        text("hardware", k % 13 == 0, '" "'), F.lit(', "versions": '), F.when(k % 17 == 0, F.lit("[]")).otherwise(F.lit('{"python": "3"}')),
        F.lit(', "params": {}, "metrics": '), F.when(k % 19 == 0, F.lit('{"recall": "high"}')).otherwise(F.lit('{"recall": 0.5}')), F.lit("}"))
    value = F.when(k % 23 == 0, F.lit("[]")).otherwise(value)
    rows = checked.record_errors(o.select("o_orderkey", value.alias("value")))
    return rows.select(F.col("o_orderkey").alias("id"), F.array_join("errors", "; ").alias("errors"))


QUERIES = {
    "ingest_bucketed": (bucketed, """WITH d AS (SELECT d.doc_id, CAST(('0x' || md5(CAST(d.doc_id AS VARCHAR))[:8])::BIGINT % 128 AS INT) AS bucket,
            d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS gone FROM documents d)
        SELECT bucket, count(*) AS rows, count(*) FILTER (gone) AS removed, count(*) AS with_lang, bool_or(gone) AS rewritten, true AS same
        FROM d GROUP BY 1"""),
    "ingest_upsert_maps": (upsert_maps, """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang || '-3' ELSE source END AS source,
        CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 0 END AS seq FROM documents"""),
    "ingest_json_array": (json_array, check("SELECT category_code, count(*) AS n, max(interaction_id) AS last FROM interaction GROUP BY 1")),
    "labels_query_file": (query_file, """SELECT CASE WHEN k % 17 = 0 THEN 'no JSON' WHEN k % 19 = 0 THEN 'no object' ELSE concat_ws('; ',
            CASE WHEN k % 5 = 0 THEN 'query missing' END, CASE WHEN k % 7 = 0 THEN 'id is no string' END,
            CASE WHEN k % 11 <> 0 AND k % 13 = 0 THEN 'relevant is no array' END,
            CASE WHEN k % 5 <> 0 AND k % 7 <> 0 AND k % 11 = 0 THEN 'relevant must be a non-empty list of unique ids' END) END AS errors,
            count(*) AS n, count(*) AS lines FROM (SELECT o_orderkey AS k FROM orders) GROUP BY 1"""),
    "results_record_types": (typed_records, """SELECT k AS id, CASE WHEN k % 23 = 0 THEN 'no JSON object' WHEN k % 7 = 0 OR k % 11 = 0 OR k % 17 = 0
            THEN concat_ws('; ', CASE WHEN k % 7 = 0 THEN 'git_sha is no text' END, CASE WHEN k % 11 = 0 THEN 'missing run' END,
                CASE WHEN k % 17 = 0 THEN 'versions is no object' END)
            ELSE concat_ws('; ', CASE WHEN k % 5 = 0 THEN 'date is not YYYY-MM-DD' END, CASE WHEN k % 13 = 0 THEN 'hardware is empty' END,
                CASE WHEN k % 19 = 0 THEN 'no number: recall' END) END AS errors FROM (SELECT o_orderkey AS k FROM orders)"""),
    "ingest_json_lines": (json_lines, check("""SELECT * REPLACE (CAST(staff_id AS INTEGER) AS staff_id, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
        strftime(ended_at, '%Y-%m-%d %H:%M:%S.%f') AS ended_at) FROM interaction""")),
    "ingest_typed_ledger": (typed_ledger, check("""SELECT txn_type, CAST(NULL AS VARCHAR) AS fee_type, count(*) AS n,
        round(CAST(sum(amount) AS DOUBLE), 2) AS amount, strftime(min(posted_at), '%Y-%m-%d %H:%M:%S.%f') AS first, max(transaction_id) AS last_id
        FROM account_transaction GROUP BY 1""")),
    "ingest_dates_and_numbers": (dates_and_numbers, f"WITH {STORE_SQL} SELECT doc_id, date[:10] AS day, doc_id AS number FROM store"),
    "ingest_transcript_table": (transcript_table, """SELECT conv_id AS interaction_id, CAST(count(*) AS INT) AS turn_count,
        CAST(length(string_agg(upper(role) || ': ' || text, ' ' ORDER BY turn)) AS INT) AS chars, upper(max_by(role, turn)) AS last_speaker
        FROM conversations GROUP BY 1"""),
    "ingest_counted_load": (counted_load, check(" UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("household", "member", "account", "csat_survey", "account_transaction")))),
    "ingest_upsert": (upserted, f"""WITH {_UPSERT} SELECT id, balance FROM new UNION ALL
        SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT id FROM new)"""),
    "ingest_prune": (pruned, check("SELECT survey_id, interaction_id FROM csat_survey WHERE interaction_id IN (SELECT interaction_id FROM interaction)")),
    "ingest_stale": (gone, check("""SELECT score, count(*) AS n FROM csat_survey WHERE interaction_id NOT IN (SELECT interaction_id FROM interaction) GROUP BY 1""")),
    "ingest_last_wins": (last_wins, """SELECT coalesce(k, c_custkey) AS call_id, coalesce(p, c_mktsegment) AS text FROM customer
        FULL OUTER JOIN (SELECT o_custkey AS k, max_by(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) ON k = c_custkey"""),
    "ingest_set_scores": (scored, """SELECT d.doc_id AS call_id, lang, CASE WHEN quality * 5 + toxic BETWEEN 1 AND 5 THEN quality * 5 + toxic END AS csat_score,
        CASE WHEN quality * 5 + toxic BETWEEN 1 AND 5 THEN '2026-08-31' END AS surveyed_at FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
    "ingest_refused_scores": (lambda spark, sf: S.refused_scores(surveys(spark, sf)), """SELECT doc_id AS call_id, quality * 5 + toxic AS csat_score,
        '2026-08-31' AS surveyed_at FROM labels WHERE quality * 5 + toxic NOT BETWEEN 1 AND 5"""),
    "ingest_documents": (enriched_rows, check("""
        WITH a AS (SELECT interaction_id, list(account_id ORDER BY r, account_id) AS l FROM (SELECT DISTINCT interaction_id, account_id,
                CASE account_role WHEN 'subject' THEN 0 ELSE 1 END AS r FROM interaction_account) GROUP BY 1)
        SELECT 'CALL-' || lpad(CAST(conv_id AS VARCHAR), 12, '0') AS call_id, i.interaction_id, l[1] AS account_id, array_to_string(l, ',') AS account_ids,
            any_value(home_branch) AS home_branch, count(*) AS turns
        FROM conversations LEFT JOIN interaction i ON i.interaction_id = conv_id LEFT JOIN a ON a.interaction_id = i.interaction_id
        LEFT JOIN member m ON m.member_id = conv_id GROUP BY conv_id, i.interaction_id, l""")),
    "ingest_attach_surveys": (surveyed, check("""SELECT 'CALL-' || lpad(CAST(conv_id AS VARCHAR), 12, '0') AS call_id, score AS csat_score,
        strftime(surveyed_at, '%Y-%m-%d') AS surveyed_at FROM (SELECT DISTINCT conv_id FROM conversations) JOIN csat_survey ON interaction_id = conv_id""")),
    "ingest_embed_reuse": (reused, """SELECT CAST(doc_id AS VARCHAR) AS call_id, n_chars % 3 > 0 AND n_chars % 5 > 0 AS reused,
        CASE WHEN n_chars % 3 > 0 AND n_chars % 5 > 0 THEN 0 ELSE length(text) END::DOUBLE AS v, sha256(text) AS content_hash FROM documents"""),
    "ingest_model_guard": (guard, """SELECT doc_id AS call_id, CASE n_chars % 4 WHEN 1 THEN 'old' END AS embedding_model FROM documents
        WHERE n_chars % 4 < 2 AND lang NOT IN ('de', 'fr')"""),
    "ingest_content_hash": (hashes, "SELECT doc_id, sha256(text) AS hash FROM documents"),
    "ingest_scale_up": (scaled, """SELECT doc_id || CASE r WHEN 0 THEN '' ELSE '~r' || lpad(CAST(r AS VARCHAR), 3, '0') END AS call_id, CAST(r AS INT) AS replica,
        doc_id || ',' || doc_id || '~r001,' || doc_id || '~r002' AS relevant FROM documents, range(3) t(r)"""),
    "ingest_jitter": (shaken, """SELECT vec_id || CASE r WHEN 0 THEN '' ELSE '~r001' END AS call_id, CAST(r AS INT) AS replica, true AS close, r = 0 AS same
        FROM embeddings, range(2) t(r)"""),
    "snapshot_rollback": (rolled_back, "SELECT c_custkey, c_acctbal, 'seed-base,seed-base-2' AS tags, 3 AS version FROM customer"),
    "snapshot_expired_tags": (expired, """SELECT o_orderpriority AS store, count(*) AS n, max(o_orderkey) AS newest FROM (
        SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS r FROM orders WHERE o_custkey % 3 <> 0)
        WHERE r > 10 GROUP BY 1"""),
    "snapshot_droppable": (droppable, """
        WITH t AS (SELECT o_orderpriority AS store, min(o_orderkey) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
                ORDER BY o_orderkey DESC) AS r FROM orders WHERE o_custkey % 3 <> 0 AND o_orderpriority <> '5-LOW') WHERE r <= 10 GROUP BY 1)
        SELECT o_orderpriority AS store, count(*) AS n, max(o_orderkey) AS newest FROM orders LEFT JOIN t ON store = o_orderpriority
        WHERE o_orderkey < oldest OR (oldest IS NULL AND o_orderdate < DATE '1999-12-18' AND o_orderkey < (SELECT max(o_orderkey) FROM orders
            WHERE o_orderpriority = '5-LOW')) GROUP BY 1"""),
    "results_record_errors": (records_checked, """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'missing git_sha' ELSE concat_ws('; ',
        CASE WHEN o_orderkey % 5 = 0 THEN 'date is not YYYY-MM-DD' END, CASE WHEN o_orderkey % 11 = 0 THEN 'unknown area' END,
        CASE WHEN o_orderkey % 13 = 0 THEN 'hardware is empty' END, CASE WHEN o_orderkey % 17 = 0 THEN 'versions has no python' END,
        CASE WHEN o_orderkey % 19 = 0 THEN 'metrics is empty' END) END AS errors FROM orders"""),
    "results_metrics_table": (pivoted, """SELECT l_returnflag, round(avg(l_extendedprice) FILTER (l_linestatus = 'F'), 2) AS F,
        round(avg(l_extendedprice) FILTER (l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY 1"""),
    "results_typed_cells": (typed_cells, """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS BIGINT) END AS cell_long,
        CASE WHEN p_partkey % 4 = 1 THEN p_retailprice END AS cell_double, CASE WHEN p_partkey % 4 = 2 THEN p_name END AS cell_text FROM part"""),
    "labels_query_errors": (labelled_errors, """SELECT concat_ws('; ', CASE WHEN o_orderkey % 7 = 0 THEN 'query missing' END,
        CASE WHEN o_orderkey % 3 = 0 THEN 'unknown type' END, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0
        THEN 'relevant must be a non-empty list of unique ids' END) AS errors, count(*) AS n FROM orders GROUP BY 1"""),
    "labels_repeated_ids": (lambda spark, sf: files.repeated_ids(labelled(spark, sf)), """SELECT CAST(o_orderkey % 10000 AS VARCHAR) AS id, count(*) AS n
        FROM orders GROUP BY 1 HAVING count(*) > 1"""),
    "change_log_entries": (logged, """SELECT 'change ' || o_orderkey AS name, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders
        WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 > 0"""),
}

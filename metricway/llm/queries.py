"""The registered queries of the corpus operators: (query, SQL check or None) by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from metricway.llm import bagminhash, chat, language, lines, mixing, packing, pii, repair, rules, runs, sharding, simhash, toxicity
from metricway.llm.common import table, utf8_bytes, written


def histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes; equal texts are one run of the order."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (utf8_bytes(F.col("text")) + 8).alias("size"), F.crc32("text").alias("text_crc32"),
        F.xxhash64("text").alias("text_key"))
    out = sharding.histogram_sort(rows, "text_key", "doc_id", "size", 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the verdict of the adaptive limits for every document."""
    rows = rules.measured(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    kept = rules.adaptive_filter(written(rows))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept")


def _adaptive_rules_sql() -> str:
    unit = f"CAST(pow(2, greatest(length(bin(v)) - {rules.SIGNIFICANT}, 0)) AS BIGINT)"
    values = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, base_failed, '{m}' AS measure, "
        f"CASE WHEN {under} > 0 THEN {rules.SCALE} * {over} // {under} ELSE 0 END AS v FROM base"
        for m, (over, under, *_) in rules.MEASURES.items())

    def quartiles(by: str) -> str:
        keys = f"{by}, " if by else ""
        return f"""SELECT {keys}measure, max(total) AS n,
            min(CASE WHEN 4 * below >= total THEN bin END) AS q1,
            min(CASE WHEN 4 * below >= 3 * total THEN bin END) AS q3
          FROM (SELECT {keys}measure, bin, sum(c) OVER (PARTITION BY {keys}measure ORDER BY bin) AS below,
                       sum(c) OVER (PARTITION BY {keys}measure) AS total
                FROM (SELECT {keys}measure, bin, count(*) AS c FROM binned GROUP BY {keys}measure, bin))
          GROUP BY {keys}measure"""

    widths = " ".join(f"WHEN '{m}' THEN {x[2]}" for m, x in rules.MEASURES.items())
    least = " ".join(f"WHEN '{m}' THEN {x[3]}" for m, x in rules.MEASURES.items())
    lower = ", ".join(f"'{m}'" for m, x in rules.MEASURES.items() if x[4])
    return f"""
    WITH texts AS (
      SELECT doc_id, lang, source,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)),
                         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM documents),
    places AS (
      SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM texts)),
    starts AS (
      SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM places) WHERE c > 1),
    repeats AS (
      SELECT doc_id, sum(least(coalesce(following - i, 3), 3)) AS n
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM starts)
      GROUP BY doc_id),
    counted AS (
      SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(array_to_string(words, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
      FROM texts LEFT JOIN repeats USING (doc_id)),
    base AS (
      SELECT *, (n_words < {rules.MIN_WORDS}
                 OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words) AS base_failed FROM counted),
    measures AS ({values}),
    binned AS (SELECT *, v - v % {unit} AS bin FROM measures WHERE NOT base_failed),
    fine AS ({quartiles("lang, source")}),
    mid AS ({quartiles("lang")}),
    whole AS ({quartiles("")}),
    picked AS (
      SELECT f.lang, f.source, f.measure,
             CASE WHEN f.n >= {rules.MIN_GROUP} THEN f.q1 WHEN m.n >= {rules.MIN_GROUP} THEN m.q1 ELSE w.q1 END AS q1,
             CASE WHEN f.n >= {rules.MIN_GROUP} THEN f.q3 WHEN m.n >= {rules.MIN_GROUP} THEN m.q3 ELSE w.q3 END AS q3
      FROM fine f JOIN mid m ON f.lang IS NOT DISTINCT FROM m.lang AND f.measure = m.measure
      JOIN whole w ON f.measure = w.measure),
    bounds AS (
      SELECT lang, source, measure,
             q3 + (CASE measure {widths} END) * (q3 - q1) + (CASE measure {least} END) AS high,
             CASE WHEN measure IN ({lower})
                  THEN q1 - (CASE measure {widths} END) * (q3 - q1) - (CASE measure {least} END) ELSE 0 END AS low
      FROM picked),
    outside AS (
      SELECT DISTINCT x.doc_id FROM measures x
      JOIN bounds b ON x.lang IS NOT DISTINCT FROM b.lang AND x.source IS NOT DISTINCT FROM b.source
       AND x.measure = b.measure
      WHERE NOT x.v BETWEEN b.low AND b.high)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept
    FROM base"""


#: A conversation whose texts look like the template's marks.
HOSTILE = "\\### Assistant: </turn> ok"


def chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the hostile one, formatted and read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], rows.schema)
    back = chat.read_back(chat.formatted(rows.unionByName(hostile)))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
               256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


CHAT_SQL = """
    WITH rows AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
      UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
    placed AS (
      SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place,
             lead(1) OVER w IS NULL AS is_last
      FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
    sized AS (
      SELECT *,
        CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 11 + length(role) END + 8
        + length(text) + length(text) - length(replace(text, '\\', ''))
        + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
        + len(regexp_extract_all(text, '</turn>')) AS chars,
        ((place = 1 AND role IN ('system', 'user'))
         OR (place > 1 AND (before || '>' || role) IN ('system>user', 'user>assistant', 'assistant>user')))
        AND (NOT is_last OR role IN ('user', 'assistant')) AS ok
      FROM placed)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '')) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(ok) AS valid
    FROM sized GROUP BY conv_id"""


RADIUS = 3


def simhash_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts.

    n_within: for every document whose id is divisible by 50, how many rows have a fingerprint within 3 bits of its own,
    by the block tables over all fingerprints.
    """
    both = simhash.edited(table(spark, sf_dir, "documents")).select(
        "doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"),
                          F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("v"))
    keys = ["doc_id", "next_id", "n_chars", "edited_sha256"]
    prints = simhash.fingerprints(both.select(*keys, "v.which", "v.text"), "text", [*keys, "which"])
    own = written(prints.groupBy(*keys).agg(
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint")))
    after = own.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fingerprint").alias("after"))
    copies = written(own.groupBy("fingerprint").agg(F.count("*").alias("rows")))
    asked = own.filter(F.col("doc_id") % 50 == 0)
    found = (simhash.within(asked, copies, RADIUS).join(copies, "fingerprint")
             .groupBy("query").agg(F.sum("rows").alias("n_within")))
    return (own.join(after, "next_id")
            .join(found, (F.col("query") == F.col("fingerprint")) & (F.col("doc_id") % 50 == 0), "left")
            .select("doc_id", "n_chars", "edited_sha256", simhash.hexed(F.col("fingerprint")).alias("fingerprint"),
                    simhash.hexed(F.col("edited_fingerprint")).alias("edited_fingerprint"),
                    simhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    simhash.likeness(F.col("fingerprint"), F.col("after")).alias("near_next"),
                    (F.col("n_within") - 1).alias("n_within")))


def packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def segmentation_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the folds other than 1 of 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = packing.vocabulary(language.VOCABULARY)
    langs, model = language.fit(docs.filter(language.fold("doc_id", 3) != 1), path)
    out = language.predict(docs.withColumn("held_out", language.fold("doc_id", 3) == 1), langs, model, path,
                           keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def toxicity_label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the folds other than 0 of 5."""
    docs, held_out = table(spark, sf_dir, "documents"), language.fold("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document by multisets of five-word shingles that overlap by 0.8."""
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that goes because a line like it comes before: its place, and the place of the line that stays."""
    gone = lines.dropped(table(spark, sf_dir, "documents"))
    return gone.select("doc_id", F.col("place").alias("line_no"), "kept_doc", F.col("kept_place").alias("kept_line_no"))


def raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the probability of its raked cell, and whether it is drawn."""
    out = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", "topic", "tokens", F.round("probability", 6).alias("probability"), "chosen")


def _raked_mixture_sql() -> str:
    topics = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in mixing.TOPICS)
    steps, last = [], "start"
    for r in range(mixing.ROUNDS):
        for d in mixing.DIMENSIONS:
            name = f"r{r}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (weight * {d}_target / sum(weight) OVER (PARTITION BY {d}) AS weight) "
                         f"FROM {last})")
            last = name
        steps.append(f"r{r} AS MATERIALIZED (SELECT * REPLACE (least(weight, bound) AS weight) FROM {last})")
        last = f"r{r}"
    targets = "".join(
        f", {d}_shares AS (SELECT {d}, raised / sum(raised) OVER () AS target FROM (SELECT {d}, "
        f"pow(CAST(sum(tokens) AS DOUBLE), {mixing.TEMPERS[d]}) AS raised FROM cells GROUP BY {d}))" for d in mixing.DIMENSIONS)
    columns = ", ".join(f"{d}_shares.target AS {d}_target" for d in mixing.DIMENSIONS)
    joins = " ".join(f"JOIN {d}_shares ON cells.{d} IS NOT DISTINCT FROM {d}_shares.{d}" for d in mixing.DIMENSIONS)
    same = " AND ".join(f"d.{x} IS NOT DISTINCT FROM p.{x}" for x in mixing.DIMENSIONS)
    return f"""
    WITH docs AS (
      SELECT doc_id, source, lang, CASE {topics} ELSE '{mixing.PROSE}' END AS topic,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
      FROM documents),
    cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM docs GROUP BY ALL){targets},
    start AS (SELECT cells.source, cells.lang, cells.topic, tokens, CAST(tokens AS DOUBLE) AS weight,
                     tokens / ({mixing.KEEP} * sum(tokens) OVER ()) AS bound, {columns} FROM cells {joins}),
    {", ".join(steps)},
    p AS (SELECT *, weight / bound AS probability FROM {last})
    SELECT doc_id, d.topic, d.tokens, round(probability, 6) AS probability,
           CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, {mixing.DIGITS}) AS BIGINT) / {float(16 ** mixing.DIGITS)} < probability AS chosen
    FROM docs d JOIN p ON {same}"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated or of another role, by the CRC-32 of `conv_id:turn`."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    rows = rows.select("conv_id", "turn", spaced[2].alias("role"), spaced[3].alias("text"), F.pmod(
        F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1])), F.lit(20)).alias("kind")).filter("kind <> 0")
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1)))
                                                     .otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def weighted_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.report(repair.numbered(damaged(rows))).withColumnRenamed("conv_id", "conv")
    every = rows.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by the CRC-32 of the id, words from some place on repeat with a period."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    worded = docs.select("doc_id", "text", crc.alias("h"), F.floor(crc / 10).alias("g"), F.when(
        crc % 10 == 0, rules.words_of(F.col("text"))).alias("words"))
    size = F.size("words").cast("long")
    first = F.pmod(F.col("g"), size)
    placed = worded.withColumn("a", F.when(size > 0, first)).withColumn(
        "p", F.when(size > 0, 1 + F.floor((size - F.col("a")) / (3 + F.pmod(F.col("g"), F.lit(8))))))
    repeated = F.transform("words", lambda _, i: F.element_at("words", F.when(i < F.col("a"), i + 1).otherwise(
        F.col("a") + F.pmod(i - F.col("a"), F.col("p")) + 1).cast("int")))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(
        F.col("text")).alias("text"))


def automaton_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of every document, and the digest of its text without repetitions."""
    out = runs.with_runs(periodic(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return out.select("doc_id", "runs", "collapsed", best.alias("best"), listed.alias("listed")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * (-best.n) DIV best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: the fixed patterns, and what their contexts gave away."""
    out = pii.found(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
                      pii.listed(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_histogram_sort": (histogram_sort, None),
    "op2_adaptive_rules": (adaptive_rules, _adaptive_rules_sql()),
    "op3_label_model": (toxicity_label_model, None),
    "op4_segmentations": (segmentation_language, None),
    "op5_bagminhash": (near_duplicates, None),
    "op6_chat_segments": (chat_segments, CHAT_SQL),
    "op7_differencing": (packed_windows, None),
    "op8_raking": (raked_mixture, _raked_mixture_sql()),
    "op9_fuzzy_lines": (fuzzy_lines, None),
    "op10_simhash": (simhash_tables, None),
    "op11_weighted_repair": (weighted_repair, None),
    "op12_automaton_runs": (automaton_runs, None),
    "op13_bootstrapped_pii": (bootstrapped_pii, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}

"""Text and privacy operators over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricway.functions import phrases as P
from metricway.functions import text as T
from metricway.operators import change as C
from metricway.session import spread
from registry.base import check, plain, tables
from registry.changes import LOG_SQL, calls_of, log_of


def masked(spark, sf):
    """Every document with its account numbers masked, as a hash of the whole text."""
    d = spread(tables(spark, sf)["documents"].select("doc_id", "text"))
    shown = T.mask_accounts(F.col("text"))
    return d.select("doc_id", F.sha2(shown, 256).alias("hash"), (shown != F.col("text")).alias("changed"))


def ids_named(spark, sf):
    """Texts that name calls: each order's note names its own call and its customer's."""
    o = tables(spark, sf)["orders"]
    note = F.format_string("see CALL-%05d and call-%05d, CALL-%05d again; AGT-%d", F.col("o_orderkey") % 100000,
                           F.col("o_custkey") % 100000, F.col("o_orderkey") % 100000, F.col("o_custkey"))
    return o.select("o_orderkey", F.array_join(T.call_ids(note), ",").alias("exact"),
                    F.array_join(T.call_ids(F.upper(note)), ",").alias("any_case"),
                    F.size(F.regexp_extract_all(note, F.lit(T.STAFF_OR_MEMBER), F.lit(0))).alias("agents"))


def labels_cleaned(spark, sf):
    c = tables(spark, sf)["customer"]
    raw = F.concat(F.lit("  AGT-"), F.col("c_custkey").cast("string"), F.lit("   late \n fee for MBR-00"),
                   F.col("c_custkey").cast("string"), F.lit(" at "), F.col("c_name"), F.lit("  "))
    return c.select("c_custkey", T.clean_label(raw, 24).alias("label"))


def marked(spark, sf):
    """Conversations as marked transcripts: the user is the member, anyone else the agent."""
    c = tables(spark, sf)["conversations"]
    said = c.select("conv_id", "turn", F.when(F.col("role") == "user", "member").otherwise("agent").alias("role"), "text")
    return T.transcripts(said)


def transcripts(spark, sf):
    t = T.transcripts(tables(spark, sf)["conversations"])
    return t.select("conv_id", "turn_count", F.sha2("full_text", 256).alias("hash"),
                    F.array_join(F.transform("utterances", lambda u: u["speaker"]), ",").alias("speakers"))


def turns(spark, sf):
    m = marked(spark, sf)
    return m.select("conv_id", F.posexplode(T.split_turns(F.col("full_text"))).alias("pos", "turn")).select(
        "conv_id", "pos", F.sha2(F.regexp_replace("turn", r"\s+", " "), 256).alias("hash"))


_MARKED = """m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'MEMBER' ELSE 'AGENT' END AS who, text FROM conversations)"""


def cited_turn(spark, sf):
    """The last 20 characters of each third turn, cited with the turns around them."""
    c = tables(spark, sf)["conversations"]
    quote = c.filter("turn = 2").select("conv_id", F.right("text", F.lit(20)).alias("quote"))
    m = marked(spark, sf).select("conv_id", T.split_turns(F.col("full_text")).alias("turns")).join(quote, "conv_id")
    rows = T.citation_context(m, "turns", "quote", "conv_id")
    return rows.select("conv_id", "cited", "of", "position", "mark")


def views(spark, sf):
    """The header of each transcript view (conversations have no length: every second is given one)."""
    m = marked(spark, sf)
    seconds = F.when(F.col("conv_id") % 2 == 0, F.col("turn_count") * 37)
    view = T.transcript_view({"Call ID": F.col("conv_id"), "Date": F.lit("2026-01-05"), "Category": F.lit("other"),
                              "Outcome": F.lit("resolved"), "Agent": F.lit("AGT-00012345"), "Member": F.lit("MBR-000012")},
                             seconds.cast("int"), F.col("full_text"))
    return m.select("conv_id", F.element_at(F.split(view, "\n\nTRANSCRIPT:\n"), 1).alias("header"),
                    F.element_at(F.split(view, "\n"), 3).alias("length"))


def periods(spark, sf):
    """A phrase per order, made of its own date, read against the range of the calls."""
    calls = calls_of(spark, sf)
    o = tables(spark, sf)["orders"].select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    kind, name = F.col("o_orderkey") % 8, F.date_format("d", "MMMM")
    day = F.dayofmonth("d").cast("string")
    phrase = (F.when(kind == 0, F.date_format("d", "yyyy-MM-dd")).when(kind == 1, F.concat_ws(" ", F.lit("on"), name, day))
              .when(kind == 2, F.concat_ws(" ", F.lit("in early"), F.lower(name))).when(kind == 3, F.concat_ws("-", F.lit("mid"), F.date_format("d", "MMM")))
              .when(kind == 4, F.concat_ws(" ", F.lit("since late"), F.upper(name))).when(kind == 5, F.concat_ws(" ", F.lit("during"), name))
              .when(kind == 6, F.concat(name, F.lit(" 32"))).otherwise("last spring"))
    span = C.data_range(calls)
    p = P.period(phrase, F.col("data_start"), F.col("data_end"))
    o = o.withColumn("data_start", C.only(span, "data_start")).withColumn("data_end", C.only(span, "data_end"))
    return plain(o.select("o_orderkey", p["start"].alias("start"), p["end"].alias("end")))


def subjects(spark, sf):
    """What each order's question is about."""
    o = tables(spark, sf)["orders"]
    words = ("fee disputes", "Card services calls", "fraud at Downtown", "new accounts in riverside", "prefees", "rate lock status and escrow")
    asked = F.element_at(F.array(*map(F.lit, words)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    measure = F.element_at(F.array(*map(F.lit, ("average handle time", "first contact resolution of calls", "csat", "talk time and fcr", "nothing", "the call volume"))),
                           (F.col("o_custkey") % 6 + 1).cast("int"))
    return o.select("o_orderkey", F.array_join(P.subject_categories(asked), ",").alias("categories"),
                    F.array_join(P.subject_branches(asked), ",").alias("branches"),
                    F.array_join(F.transform(P.measures(measure), lambda m: m["measure"]), ",").alias("measures"))


def logged_names(spark, sf):
    o = tables(spark, sf)["orders"]
    options = ("fee schedule", "  Card   OUTAGE ", "- \"app release\"", "branch move (1999-11-01)", "branch move (1999-11-02)", "no such change")
    name = F.element_at(F.array(*map(F.lit, options)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return plain(P.match_logged(o.select("o_orderkey", name.alias("name")), log_of(spark)).drop("name"))


def redacted(spark, sf):
    o = tables(spark, sf)["customer"]
    raw = F.concat(F.lit("open /home/"), F.col("c_name"), F.lit("/x.txt and /Users/me/y on db.example.com:5432 via db.example.com"))
    safe = T.redact_values(T.redact_home(raw), ["db.example.com", "db.example.com:5432", "me"])
    return o.select("c_custkey", safe.alias("safe"))


WORDS = ["the", "rest", "der", "planted"]


def forbidden(spark, sf):
    d = tables(spark, sf)["documents"]
    hits = P.forbidden_words(d, "doc_id", ["text", "source"], WORDS)
    return hits.groupBy("column", "word").agg(F.count("*").alias("texts"), F.min("doc_id").alias("first"))


def tool_failures(spark, sf):
    d = tables(spark, sf)["documents"]
    answer = F.concat(F.lit("head\n  TOOL ERROR ("), F.col("source"), F.lit(") no table\nquery_metric error: later"))
    return d.select("doc_id", T.tool_error(F.when(F.col("lang") == "en", answer).otherwise(F.col("lang"))).alias("failure"))


_PERIOD_SQL = """
    WITH r AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) AS d,
            make_date((SELECT min(y) FROM (SELECT DISTINCT year(day) AS y, month(day) AS m FROM call_log)
                       WHERE m = month(o_orderdate)), month(o_orderdate), 1) AS f FROM orders),
    s AS (SELECT *, CASE k WHEN 0 THEN d WHEN 1 THEN CASE WHEN day(d) <= day(last_day(f)) THEN f + CAST(day(d) AS INT) - 1 END WHEN 2 THEN f WHEN 3 THEN f + 10 WHEN 4 THEN f + 20 WHEN 5 THEN f END AS lo,
        CASE k WHEN 0 THEN d WHEN 1 THEN CASE WHEN day(d) <= day(last_day(f)) THEN f + CAST(day(d) AS INT) - 1 END WHEN 2 THEN f + 9 WHEN 3 THEN f + 19 WHEN 4 THEN last_day(f) WHEN 5 THEN last_day(f) END AS hi FROM r)
    -- a day that its month does not have in that year (February 29 of 1995) is no period
    SELECT o_orderkey, strftime(lo - 3, '%Y-%m-%d') AS start, strftime(hi + 4, '%Y-%m-%d') AS "end" FROM s"""

QUERIES = {
    "text_mask_accounts": (masked, None),
    "text_call_ids": (ids_named, """
        WITH n AS (SELECT o_orderkey, 'CALL-' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS a,
            'CALL-' || lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') AS b FROM orders)
        SELECT o_orderkey, a AS exact, CASE WHEN a = b THEN a ELSE a || ',' || b END AS any_case, 1 AS agents FROM n"""),
    "text_clean_label": (labels_cleaned, """
        SELECT c_custkey, trim(substr('late fee for at ' || c_name, 1, 24)) AS label FROM customer"""),
    "text_transcripts": (transcripts, """
        SELECT conv_id, CAST(count(*) AS INT) AS turn_count, sha256(string_agg(upper(role) || ': ' || text, ' ' ORDER BY turn)) AS hash,
            string_agg(upper(role), ',' ORDER BY turn) AS speakers FROM conversations GROUP BY 1"""),
    "text_turns": (turns, f"""WITH {_MARKED} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos,
        sha256(regexp_replace(who || ': ' || trim(text, ' ' || chr(10) || chr(9) || chr(13)), '\\s+', ' ', 'g')) AS hash FROM m"""),
    "text_citation_context": (cited_turn, f"""WITH {_MARKED}, n AS (SELECT conv_id, turn, trim(text) AS text,
            CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS pos, CAST(count(*) OVER (PARTITION BY conv_id) AS INT) AS n FROM m),
        q AS (SELECT conv_id, right(text, 20) AS q FROM conversations WHERE turn = 2),
        c AS (SELECT conv_id, min(pos) AS cited FROM n JOIN q USING (conv_id) WHERE contains(text, q) GROUP BY 1)
        SELECT conv_id, CAST(cited AS BIGINT) AS cited, n AS "of", pos AS position, pos = cited AS mark FROM n JOIN c USING (conv_id) WHERE abs(pos - cited) <= 1"""),
    "text_transcript_view": (views, """
        WITH n AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN count(*) * 37 END AS s FROM conversations GROUP BY 1),
        l AS (SELECT conv_id, 'Duration: ' || coalesce((s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0'), 'unknown') || ' (minutes:seconds)' AS length FROM n)
        SELECT conv_id, 'Call ID: ' || conv_id || chr(10) || 'Date: 2026-01-05' || chr(10) || length || chr(10) || 'Category: other' || chr(10)
            || 'Outcome: resolved' || chr(10) || 'Agent: AGT-00012345' || chr(10) || 'Member: MBR-000012' AS header, length FROM l"""),
    "text_periods": (periods, check(_PERIOD_SQL)),
    "text_subjects": (subjects, """
        SELECT o_orderkey, ['fee_dispute', 'card_services,fraud_dispute', 'fraud_dispute', 'account_opening', '', 'rate_lock_status,escrow_analysis'][o_orderkey % 6 + 1] AS categories,
            ['', '', 'Downtown', 'Riverside', '', ''][o_orderkey % 6 + 1] AS branches,
            ['average_handle_time', 'first_contact_resolution_rate', 'csat_average_score', 'average_handle_time', '', 'call_volume'][o_custkey % 6 + 1] AS measures FROM orders"""),
    "text_logged_names": (logged_names, f"""
        WITH o AS (SELECT o_orderkey, ['fee schedule', 'card outage', 'app release', 'branch move', NULL, NULL][o_orderkey % 6 + 1] AS n FROM orders)
        SELECT o_orderkey, name AS logged_name, strftime(date, '%Y-%m-%d') AS logged_date FROM o LEFT JOIN {LOG_SQL} ON n = name"""),
    "text_redacted": (redacted, "SELECT c_custkey, 'open ~/x.txt and ~/y on <redacted> via <redacted>' AS safe FROM customer"),
    "text_forbidden_words": (forbidden, """
        WITH s AS (SELECT doc_id, 'text' AS "column", lower(text) AS t FROM documents UNION ALL SELECT doc_id, 'source', lower(source) FROM documents)
        SELECT "column", word, count(*) AS texts, min(doc_id) AS first FROM s, (SELECT unnest(['the', 'rest', 'der', 'planted']) AS word)
        WHERE regexp_matches(t, '(^|[^a-z0-9_à-öø-ÿßœ])' || word || '($|[^a-z0-9_à-öø-ÿßœ])') GROUP BY 1, 2"""),
    "text_tool_failures": (tool_failures, """
        SELECT doc_id, CASE WHEN lang = 'en' THEN 'TOOL ERROR (' || source || ') no table' END AS failure FROM documents"""),
}

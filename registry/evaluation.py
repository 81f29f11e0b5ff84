"""Evaluation: retrieval scores, pass rates, gates, comparisons, matching, derived labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricway.operators.quotes import quote_pairs
from metricway.operators import change as C
from metricway.operators import labels as L
from metricway.operators import scoring as E
from metricway.operators import search as S
from metricway.plans.catalog import METRICS
from registry.base import check, plain, rounded, tables
from registry.changes import calls_of, detect_sql
from registry.searches import BM25_SQL, LABEL_QUERIES_SQL, STORE_SQL, by_label, doc_store, nearest_sql, text_sql, vectors

# ── retrieval scores: relevant is what carries the query's label ──────────────

def scores(spark, sf):
    v = vectors(spark, sf)
    relevant = v.select(F.col("category").cast("int").alias("query_id"), "doc_id")
    return E.retrieval_scores(by_label()(spark, sf), relevant)


def score_means(spark, sf):
    kind = F.when(F.col("query_id") < 3, "topical").when(F.col("query_id") < 6, "filter").otherwise("paraphrase")
    return rounded(E.macro_means(scores(spark, sf).withColumn("type", kind), "type", ["recall_5", "recall_10", "mrr_10"]))


_SCORES = f"""{LABEL_QUERIES_SQL}, hits AS ({nearest_sql()}),
    sizes AS (SELECT label AS query_id, count(*) AS relevant FROM embeddings GROUP BY 1),
    s AS (SELECT z.query_id, relevant, count(*) FILTER (label = z.query_id AND rank <= 5) / least(5, relevant) AS recall_5,
        count(*) FILTER (label = z.query_id AND rank <= 10) / least(10, relevant) AS recall_10,
        coalesce(1.0::DOUBLE / min(rank) FILTER (label = z.query_id), 0) AS mrr_10
        FROM sizes z JOIN hits h USING (query_id) JOIN embeddings e ON e.vec_id = h.doc_id GROUP BY 1, 2)"""


def text_scores(spark, sf):
    """BM25 hits of each passage against the documents that hold it word for word."""
    t = tables(spark, sf)
    held = quote_pairs(t["benchmark"].select("item_id", F.col("text").alias("quote")), t["documents"].select("doc_id", "text"))
    from registry.searches import text_hits

    return rounded(E.retrieval_scores(text_hits(spark, sf), held.withColumnRenamed("item_id", "query_id")))


_HELD = """held AS (SELECT item_id AS query_id, doc_id FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM benchmark) b
        JOIN (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) d ON contains(t, q)
        WHERE q <> '')"""

# ── percentiles ───────────────────────────────────────────────────────────────

def percentile_rows(spark, sf):
    return rounded(E.percentiles(tables(spark, sf)["interaction"], "duration_seconds", [50, 95, 99], ("category_code",)))


def percentile_all(spark, sf):
    return rounded(E.percentiles(tables(spark, sf)["lineitem"], "l_extendedprice", [5, 50, 95]))


# ── runs: one row per document and check ──────────────────────────────────────

KEYS = ("labelled", "quality", "clean")


def run_rows(spark, sf, limit_chars=6000):
    """Checks on every document; those on labels do not apply where there is none."""
    t = tables(spark, sf)
    rows = t["documents"].join(t["labels"], "doc_id", "left")
    answer = F.when(F.col("n_chars") > 15000, "first\nTOOL ERROR (query): gone\nlast").otherwise("fine")
    from metricway.functions.text import tool_error

    checks = F.array(
        F.struct(F.lit("labelled").alias("key"), F.col("quality").isNotNull().alias("score")),
        F.struct(F.lit("quality").alias("key"), (F.col("quality") == 1).alias("score")),
        F.struct(F.lit("clean").alias("key"), F.when(F.col("n_chars") < limit_chars, F.col("toxic") == 0).alias("score")))
    return rows.select(F.col("doc_id").alias("item"), F.col("lang").alias("group"),
                       tool_error(answer).isNotNull().alias("tool_error"), F.lit("").alias("comment"), F.inline(checks))


_RUN = """base AS (SELECT d.doc_id AS item, lang AS "group", n_chars > 15000 AS failed, quality IS NOT NULL AS labelled,
        quality = 1 AS quality, CASE WHEN n_chars < 6000 THEN toxic = 0 END AS clean,
        CASE WHEN n_chars < 2000 THEN toxic = 0 END AS clean2, n_chars
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
    long AS (SELECT item, "group", n_chars, 'labelled' AS key, labelled AS score FROM base UNION ALL
             SELECT item, "group", n_chars, 'quality', quality FROM base UNION ALL
             SELECT item, "group", n_chars, 'clean', clean FROM base)"""


def known_failures(spark, sf):
    """What was known to fail: everything unlabelled, and quality of the short texts."""
    rows = run_rows(spark, sf).join(tables(spark, sf)["documents"].select(F.col("doc_id").alias("item"), "n_chars"), "item")
    return rows.filter("(key = 'labelled' AND NOT score AND n_chars < 4000) OR (key = 'quality' AND n_chars < 600)").select(
        "item", "key")


def gate_rows(spark, sf):
    found = E.failures(run_rows(spark, sf)).select("item", "key")
    return E.gate(found, known_failures(spark, sf))


def compared(spark, sf):
    def rates(limit):
        rows = run_rows(spark, sf, limit).filter("score IS NOT NULL")
        return rows.groupBy("group", "key").agg(F.avg(F.col("score").cast("int")).alias("value"))
    return rounded(E.compare_runs(rates(6000), rates(2000)))


def file_rows(spark, sf):
    """Names of run files made of the documents' ids and sources; some are no runs."""
    d = tables(spark, sf)["documents"]
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    name = F.concat(F.lit("2026-10-"), day, F.lit("T1200"), F.lpad((F.col("n_chars") % 60).cast("string"), 2, "0"),
                    F.lit("Z_"), F.col("source"), F.lit("_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 7),
                    F.when(F.col("doc_id") % 9 == 0, ".txt").otherwise(".json"))
    return d.select(name.alias("name"))


_FILES = """names AS (SELECT '2026-10-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T1200' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0')
        || 'Z_' || source || '_' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 7) AS stem, source AS run, doc_id % 9 <> 0 AS is_run FROM documents),
    runs AS (SELECT stem || '.json' AS name, substr(stem, 1, 18) AS "at", run FROM names WHERE is_run)"""


# ── answers ───────────────────────────────────────────────────────────────────

def answer_rows(spark, sf):
    """An answer per document, with its expectation; ids past the corpus are not real."""
    d = tables(spark, sf)["documents"]
    i, n = F.col("doc_id"), F.col("n_chars")

    def call(x):
        return F.concat(F.lit("CALL-"), F.lpad(x.cast("string"), 12, "0"))

    metric = n % 3 == 0
    cited = F.when(n % 3 == 1, F.array(call(i), call(i + n % 400))).otherwise(F.array().cast("array<string>"))
    sql = F.when(metric & (n % 2 == 0), F.lit("SELECT 1"))
    return d.select(
        i.alias("item"), F.when(metric, "resolve_metric").otherwise("retrieve").alias("expected_route"),
        F.when(n % 5 == 0, "retrieve").when(metric, "resolve_metric").otherwise("retrieve").alias("route"),
        F.when(metric, F.array(F.lit("rate"))).otherwise(F.array().cast("array<string>")).alias("expected_interrupts"),
        F.when(metric & (n % 4 > 0), F.array(F.lit("rate"))).otherwise(F.array().cast("array<string>")).alias("interrupts"),
        F.when(metric, F.array(F.lit("nps"), F.lit("responses"))).otherwise(F.array().cast("array<string>")).alias("expected_metrics"),
        F.when(n % 2 == 0, F.array(F.lit("responses"), F.lit("nps"))).otherwise(F.array(F.lit("nps"))).alias("metrics"),
        metric.alias("expect_sql"), sql.alias("sql"), F.concat_ws(" ", F.lit("see"), F.array_join(cited, " "), sql).alias("answer"),
        cited.alias("citations"), (n % 7 > 0).alias("expect_citations"),
        F.when(n % 3 == 1, call(i)).when(n % 6 == 2, F.lit("CALL-999999999999")).alias("call_id"))


def corpus_of(spark, sf):
    return doc_store(spark, sf).select("call_id")


def checked_answers(spark, sf):
    return E.answer_checks(answer_rows(spark, sf), corpus_of(spark, sf)).groupBy("key").agg(
        F.count_if("score").alias("passed"), F.count_if(~F.col("score")).alias("failed"),
        F.count_if(F.col("score").isNull()).alias("not_applicable"))


_ANSWERS = """d AS (SELECT doc_id AS i, n_chars AS n FROM documents),
    size AS (SELECT max(doc_id) AS top FROM documents),
    c AS (SELECT 'route' AS key, CASE WHEN n % 5 = 0 THEN n % 3 <> 0 ELSE true END AS score FROM d UNION ALL
        SELECT 'interrupt', n % 3 <> 0 OR n % 4 > 0 FROM d UNION ALL
        SELECT 'metric', CASE WHEN n % 3 = 0 THEN n % 2 = 0 END FROM d UNION ALL
        SELECT 'sql', CASE WHEN n % 3 = 0 THEN n % 2 = 0 END FROM d UNION ALL
        SELECT 'citations', CASE WHEN n % 3 = 0 THEN NULL WHEN n % 7 = 0 THEN n % 3 <> 1
            ELSE n % 3 = 1 AND i + n % 400 IN (SELECT doc_id FROM documents) END FROM d UNION ALL
        SELECT 'call_id', CASE WHEN n % 3 = 1 THEN true WHEN n % 6 = 2 THEN false END FROM d)"""


def point_rows(spark, sf):
    """A detected point per category against a planted one, and stated points against themselves."""
    calls = calls_of(spark, sf)
    cube = C.daily_cube(calls, "call_volume", ("category",))
    found = C.detect(cube, C.data_range(calls), "call_volume", ("category",))
    expected = F.when(F.substring("category", 1, 1).isin("1", "2"), F.date_add("day", 3)).otherwise(F.date_sub("day", 9))
    how = F.when(F.substring("category", 1, 1) == "5", "log").otherwise("detected")
    source = F.when(F.substring("category", 1, 1) == "4", "argument").otherwise("detected")
    return found.select("category", E.point_check(expected, how, F.col("day"), source).alias("passed"))


def value_rows(spark, sf):
    """Weekly values of the rounded series against the raw recomputation, by category."""
    calls = calls_of(spark, sf)
    raw = calls.groupBy(C.monday(F.col("day")).alias("week"), "category").agg(
        F.avg(F.col("resolved").cast("int")).alias("value"), F.count("*").alias("n"))
    series = C.weekly_series(C.daily_cube(calls, "first_contact_resolution_rate", ("category",)),
                             "first_contact_resolution_rate", ("category",))
    shifted = series.withColumn("value", F.when(F.month("week") == 7, F.col("value") + 0.01).otherwise(F.col("value")))
    same = E.values_check(shifted, raw, ["week", "category"])
    return same.groupBy("category").agg(F.count("*").alias("weeks"), F.count_if("same").alias("same"))


def agents_named(spark, sf):
    calls = calls_of(spark, sf)
    answers = calls.groupBy("day").agg(F.max("seconds").alias("s")).select("day", F.when(
        F.col("s") % 2 == 0, F.concat(F.lit("agent AGT-"), F.col("s"), F.lit(" spoke"))).otherwise("xAGT-5 spoke").alias("shown"))
    return answers.agg(F.count("*").alias("answers"), F.count_if(E.names_agent(F.col("shown"))).alias("naming_an_agent"))


# ── planted and reported groups ───────────────────────────────────────────────

def planted_of(spark, sf):
    return calls_of(spark, sf).select(F.concat_ws("/", "category", "home_branch").alias("planted"), "call_id")


def reported_of(spark, sf):
    """Reported groups: a category and branch, without the longest calls of some and with strays in others."""
    calls = calls_of(spark, sf)
    keep = ~((F.col("category") == "1-URGENT") & (F.col("seconds") > 200))
    stray = F.when(F.col("seconds") % 10 == 0, "5-LOW").otherwise(F.col("category"))
    return calls.filter(keep).select(F.concat_ws("/", stray, "home_branch").alias("reported"), "call_id")


def matched(spark, sf):
    return rounded(E.match_groups(planted_of(spark, sf), reported_of(spark, sf)))


_MATCH = """p AS (SELECT concat_ws('/', category, home_branch) AS planted, call_id FROM call_log),
    r AS (SELECT concat_ws('/', CASE WHEN seconds % 10 = 0 THEN '5-LOW' ELSE category END, home_branch) AS reported, call_id
        FROM call_log WHERE NOT (category = '1-URGENT' AND seconds > 200)),
    ps AS (SELECT planted, count(*) AS size FROM p GROUP BY 1), rs AS (SELECT reported, count(*) AS n FROM r GROUP BY 1),
    good AS (SELECT planted, reported, count(*) / any_value(size) AS recall, count(*) / any_value(n) AS "precision"
        FROM p JOIN r USING (call_id) JOIN ps USING (planted) JOIN rs USING (reported) GROUP BY 1, 2
        HAVING count(*) / any_value(size) >= 0.5 AND count(*) / any_value(n) >= 0.6),
    m AS (SELECT ps.planted, size, g.reported, recall, "precision" FROM ps LEFT JOIN (SELECT * FROM good QUALIFY
        row_number() OVER (PARTITION BY planted ORDER BY reported) = 1) g USING (planted))"""


def recalled(spark, sf):
    return E.group_recall(E.match_groups(planted_of(spark, sf), reported_of(spark, sf)))


def shares(spark, sf):
    planted, reported = planted_of(spark, sf), reported_of(spark, sf)
    return rounded(E.group_shares(E.match_groups(planted, reported), reported, calls_of(spark, sf)))


# ── derived labels ────────────────────────────────────────────────────────────

def specs_of():
    return {
        "q01": F.col("category") == "en",
        "q02": (F.col("category") == "fr") & F.col("outcome").isin("src1", "src2", "src3"),
        "q03": (F.col("date") >= "2026-03-05") & (F.col("date") <= "2026-03-09"),
        "q04": (F.col("csat_score") == 5) & (F.col("home_branch") == "Downtown"),
        "q05": F.lower("text").contains("the and"),
        "q06": F.col("category") == "xx",
    }


_SPECS = {"q01": "category = 'en'", "q02": "category = 'fr' AND outcome IN ('src1', 'src2', 'src3')",
          "q03": "date >= '2026-03-05' AND date <= '2026-03-09'", "q04": "csat_score = 5 AND home_branch = 'Downtown'",
          "q05": "contains(lower(text), 'the and')", "q06": "category = 'xx'"}
_RELEVANT = " UNION ALL ".join(f"SELECT '{q}' AS query_id, doc_id FROM store WHERE {c}" for q, c in _SPECS.items())


def derived(spark, sf):
    return L.relevant_rows(doc_store(spark, sf), specs_of())


def thin(spark, sf):
    return L.thin_queries(derived(spark, sf), specs_of())


def misplaced(spark, sf):
    filters = {"q01": F.col("category").isin("en", "de"), "q03": F.col("date") >= "2026-03-07",
               "q05": F.col("home_branch").isNotNull()}
    return L.misplaced(derived(spark, sf), doc_store(spark, sf), filters)


def spoken(spark, sf):
    return L.most_spoken(L.spoken_ids(tables(spark, sf)["documents"], r"[0-9]{4,}"), 20)


def endings(spark, sf):
    return L.repeated_endings(tables(spark, sf)["account"], "account_id")


def phrase_homes(spark, sf):
    t = tables(spark, sf)
    pairs = quote_pairs(t["benchmark"].select("item_id", F.col("text").alias("quote")), t["documents"].select("doc_id", "text"))
    rows = L.phrase_categories(pairs, doc_store(spark, sf))
    return rows.select("item_id", F.array_join("categories", ",").alias("categories"), (F.size("categories") > 1).alias("ambiguous"))


def overlap(spark, sf):
    """Content words a reply shares with the turn before it."""
    t = tables(spark, sf)["conversations"]
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("said"))
    both = t.join(before, ["conv_id", "turn"]).select("conv_id", "turn", L.shared_words(F.col("text"), F.col("said")).alias("w"))
    return both.select("conv_id", "turn", F.array_join("w", " ").alias("shared"), (F.size("w") > L.MAX_SHARED).alias("too_close"))


def _tok(x):
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda x: x <> '')"


# ── questions ─────────────────────────────────────────────────────────────────

_CORES = [(n, L.label_core(m.label)) for n, m in METRICS.items()]
_TAILS = ("the mortgage rate", "our fees and the escrow balance", "the ltv", "nothing else",
          "rate lock rates and the overdraft fee", "the first contact resolution rate of heloc balances")


def questions(spark, sf):
    """A question per document, naming two metrics and often an open term."""
    d = tables(spark, sf)["documents"]
    cores = F.array(*(F.lit(c) for _, c in _CORES))
    tails = F.array(*map(F.lit, _TAILS))

    def pick(array, number, n):
        return F.element_at(array, (number % n + 1).cast("int"))

    n = F.col("n_chars")
    return d.select("doc_id", F.concat(
        F.lit("What was the "), pick(cores, n, len(_CORES)), F.lit(" beside the "), pick(cores, n + F.col("doc_id"), len(_CORES)),
        F.lit(" and "), pick(tails, n, len(_TAILS)), F.lit(" in "), F.col("source"), F.lit("?")).alias("question"))


def _sql_list(items):
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


_QUESTIONS = f"""asked AS (SELECT doc_id, 'What was the ' || {_sql_list(c for _, c in _CORES)}[n_chars % 47 + 1] || ' beside the ' ||
        {_sql_list(c for _, c in _CORES)}[(n_chars + doc_id) % 47 + 1] || ' and ' || {_sql_list(_TAILS)}[n_chars % 6 + 1] || ' in ' || source || '?' AS question
        FROM documents),
    cores(name, core) AS (VALUES {', '.join(f"('{n}', '{c}')" for n, c in _CORES)}),
    spans AS (SELECT doc_id, name, instr(lower(question), core) AS s, instr(lower(question), core) + length(core) AS e
        FROM asked, cores WHERE regexp_matches(lower(question), '\\b' || core || '\\b')),
    named AS (SELECT doc_id, string_agg(name, ',' ORDER BY s, e - s, name) AS names, list(name) AS l FROM spans a WHERE NOT EXISTS (
        SELECT 1 FROM spans b WHERE a.doc_id = b.doc_id AND b.s <= a.s AND a.e <= b.e AND b.e - b.s > a.e - a.s) GROUP BY 1)"""

_TERM_SQL = f"""cand(term, metric, ord) AS (VALUES {', '.join(f"('{t}', '{m}', {i})" for t, (_, _, c) in L.TERMS.items() for i, m in enumerate(c))}),
    qual(term, metric, q) AS (VALUES {', '.join(f"('{t}', '{m}', '{q}')" for t, (_, _, c) in L.TERMS.items() for m, qs in c.items() for q in qs)}),
    bare AS ({' UNION ALL '.join(f"SELECT doc_id, lower(question) AS q, '{t}' AS term, " + 'regexp_replace(' * bool(u) + 'lower(question)' + (", '\\b(" + '|'.join(sorted(u, key=len, reverse=True)) + ")\\b', ' ', 'g')" if u else '') + f" AS b, '\\b({'|'.join(sorted(a, key=len, reverse=True))})\\b' AS pat FROM asked" for t, (a, u, _) in L.TERMS.items())}),
    said AS (SELECT * FROM bare WHERE regexp_matches(b, pat)),
    voted AS (SELECT s.doc_id, s.term, c.metric, c.ord, s.b, s.pat,
        (SELECT count(*) FROM qual x WHERE x.term = s.term AND x.metric = c.metric AND regexp_matches(s.q, '\\b' || x.q || '\\b')) AS votes,
        CASE WHEN regexp_matches(s.q, '\\b' || replace(c.metric, '_', ' ') || '\\b') THEN length(c.metric) ELSE 0 END AS "full"
        FROM said s JOIN cand c USING (term))"""


def term_rows(spark, sf):
    asked = questions(spark, sf)
    rows = asked.select("doc_id", F.explode(L.matched_terms(F.col("question"))).alias("t"))
    return rows.select("doc_id", "t.term", F.array_join("t.candidates", ",").alias("candidates"))


def golden(spark, sf):
    asked = questions(spark, sf).withColumn("named", L.named_metrics(F.col("question")))
    return asked.select("doc_id", F.array_join("named", ",").alias("names"))


def interrupts(spark, sf):
    asked = questions(spark, sf).withColumn("named", L.named_metrics(F.col("question")))
    rows = asked.select("doc_id", F.explode(L.expected_interrupts(F.col("question"), F.col("named"))).alias("i"))
    return rows.select("doc_id", "i.term", F.array_join("i.options", ",").alias("options"))


def settled(spark, sf):
    asked = questions(spark, sf).withColumn("named", L.named_metrics(F.col("question")))
    return asked.select("doc_id", F.array_join(F.array_sort(L.settled_metrics(F.col("question"), F.col("named"))), ",").alias("metrics"))


PICKS = {"english": {"category": "en"}, "low_score": {"category": "de", "csat_score": 1},
         "downtown": {"home_branch": "Downtown", "outcome": "src3"}, "none": {"category": "xx"}}


def picked(spark, sf):
    return L.lowest_match(doc_store(spark, sf), PICKS)


def change_set(spark, sf):
    """A spec per category and year; its event is the first call of that year and category."""
    calls = calls_of(spark, sf)
    name = F.concat_ws("/", "category", F.year("day"))
    truth = calls.groupBy(name.alias("id")).agg(F.min("day").alias("day"), F.max(F.when(
        F.year("day") == 1999, "heldout").otherwise("golden")).alias("split"))
    specs = truth.select(
        F.concat(F.lit("c:"), "id").alias("id"), F.when(F.col("id").contains("2000"), "missing").otherwise(F.col("id")).alias("event"),
        F.when(F.col("id").contains("1996"), F.concat(F.lit("c:"), F.replace("id", F.lit("1996"), F.lit("1995")))).alias("follow_up_of"),
        F.when(F.col("id").startswith("1"), "call_volume").otherwise("csat_average_score").alias("metric"))
    return plain(L.change_questions(specs, truth, "golden"))


def examples(spark, sf):
    store = doc_store(spark, sf).select(F.col("call_id").alias("golden_id"), F.col("category").alias("kind"))
    return L.selected(store, ["fr", "de"], 25)


QUERIES = {
    "eval_recall_mrr": (lambda spark, sf: rounded(scores(spark, sf)),
                        f"WITH {_SCORES} SELECT query_id, relevant, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(mrr_10, 6) AS mrr_10 FROM s"),
    "eval_macro_means": (score_means, f"""WITH {_SCORES}, k AS (SELECT *, CASE WHEN query_id < 3 THEN 'topical' WHEN query_id < 6 THEN 'filter'
            ELSE 'paraphrase' END AS type FROM s), g AS (SELECT 'all' AS "group", * FROM k UNION ALL SELECT type, * FROM k)
        SELECT "group", count(*) AS queries, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10,
            round(avg(mrr_10), 6) AS mrr_10 FROM g GROUP BY 1"""),
    "eval_text_scores": (text_scores, f"""WITH {BM25_SQL}, {text_sql()}, {_HELD}, z AS (SELECT query_id, count(*) AS relevant FROM held GROUP BY 1),
        f AS (SELECT query_id, count(*) FILTER (rank <= 5) AS a, count(*) FILTER (rank <= 10) AS b, min(rank) AS r
              FROM fts JOIN held USING (query_id, doc_id) GROUP BY 1)
        SELECT query_id, relevant, round(coalesce(a, 0) / least(5, relevant), 6) AS recall_5, round(coalesce(b, 0) / least(10, relevant), 6) AS recall_10,
            round(coalesce(1.0::DOUBLE / r, 0), 6) AS mrr_10 FROM z LEFT JOIN f USING (query_id)"""),
    "eval_percentiles": (percentile_rows, check("""SELECT category_code, round(quantile_cont(duration_seconds, 0.5), 6) AS p50,
        round(quantile_cont(duration_seconds, 0.95), 6) AS p95, round(quantile_cont(duration_seconds, 0.99), 6) AS p99
        FROM interaction GROUP BY 1""")),
    "eval_percentiles_all": (percentile_all, """SELECT round(quantile_cont(l_extendedprice, 0.05), 6) AS p5,
        round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem"""),
    "eval_pass_rates": (lambda spark, sf: E.pass_rates(run_rows(spark, sf), list(KEYS)), f"""WITH {_RUN},
        g AS (SELECT 'all' AS g, * FROM base UNION ALL SELECT "group" AS g, * FROM base)
        SELECT g AS "group", count(*) AS n, count(*) FILTER (failed) AS tool_errors, round(avg(CAST(labelled AS INT)), 3) AS labelled,
            round(avg(CAST(quality AS INT)), 3) AS quality, round(avg(CAST(clean AS INT)), 3) AS clean FROM g GROUP BY 1"""),
    "eval_failures": (lambda spark, sf: E.failures(run_rows(spark, sf)),
                      f"WITH {_RUN} SELECT item, key, '' AS comment FROM long WHERE score = false"),
    "eval_gate": (gate_rows, f"""WITH {_RUN}, known AS (SELECT item, key FROM long WHERE (key = 'labelled' AND score = false AND n_chars < 4000)
            OR (key = 'quality' AND n_chars < 600)), found AS (SELECT item, key FROM long WHERE score = false)
        SELECT *, 'new failure' AS problem FROM (SELECT * FROM found EXCEPT SELECT * FROM known) UNION ALL
        SELECT *, 'now passes' FROM (SELECT * FROM known EXCEPT SELECT * FROM found)"""),
    "eval_compare": (compared, f"""WITH {_RUN}, b AS (SELECT "group", key, avg(CAST(score AS INT)) AS v FROM long WHERE score IS NOT NULL GROUP BY 1, 2),
        a AS (SELECT "group", key, avg(CAST(CASE WHEN key = 'clean' AND n_chars >= 2000 THEN NULL ELSE score END AS INT)) AS v FROM long GROUP BY 1, 2)
        SELECT "group", key, round(b.v, 6) AS before, round(a.v, 6) AS after, CASE WHEN a.v IS NULL OR b.v IS NULL THEN ''
            WHEN abs(a.v - b.v) < 0.005 THEN '=' ELSE printf('%+.2f', a.v - b.v) END AS delta FROM b JOIN a USING ("group", key)"""),
    "eval_run_files": (lambda spark, sf: E.run_files(file_rows(spark, sf)), f"WITH {_FILES} SELECT * FROM runs"),
    "eval_newest_of_runs": (lambda spark, sf: E.newest_of_runs(E.run_files(file_rows(spark, sf)), 3), f"""WITH {_FILES}
        SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY "at" DESC, name DESC) - 1 AS INT) AS run_place FROM runs
        QUALIFY run_place < 3"""),
    "eval_latest_run": (lambda spark, sf: E.latest(E.run_files(file_rows(spark, sf)), 2).select("name", "run"),
                        f'WITH {_FILES} SELECT name, run FROM runs ORDER BY "at" DESC, name DESC LIMIT 1 OFFSET 2'),
    "eval_ambiguous_runs": (lambda spark, sf: E.ambiguous_runs(E.run_files(file_rows(spark, sf))), f"""WITH {_FILES}
        SELECT run FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY "at" DESC, name DESC) AS r FROM runs) WHERE r <= 2
        GROUP BY 1 HAVING count(*) = 2 AND min("at"[:15]) = max("at"[:15])"""),
    "eval_answer_checks": (checked_answers, f"""WITH {_ANSWERS} SELECT key, count(*) FILTER (score) AS passed, count(*) FILTER (NOT score) AS failed,
        count(*) FILTER (score IS NULL) AS not_applicable FROM c GROUP BY 1"""),
    "eval_change_point": (point_rows, f"""SELECT category, CASE WHEN category[1] IN ('1', '2') THEN true ELSE false END AS passed
        FROM ({detect_sql('call_volume', ('category',))})"""),
    "eval_change_values": (value_rows, check("""WITH w AS (SELECT category, date_trunc('week', day) AS week, avg(CAST(resolved AS INT)) AS v
            FROM call_log GROUP BY 1, 2)
        SELECT category, count(*) AS weeks, count(*) FILTER (month(week) <> 7 OR round(v + 0.01, 2) = round(v, 2)) AS same FROM w GROUP BY 1""")),
    "eval_agent_ids": (agents_named, check("""SELECT count(*) AS answers, count(*) FILTER (s % 2 = 0) AS naming_an_agent
        FROM (SELECT max(seconds) AS s FROM call_log GROUP BY day)""")),
    "eval_match_groups": (matched, check(f"""WITH {_MATCH} SELECT planted, size, reported, round(recall, 6) AS recall,
        round("precision", 6) AS "precision" FROM m""")),
    "eval_group_recall": (recalled, check(f"""WITH {_MATCH} SELECT count(*) AS planted, count(reported) AS found,
        count(*) > 0 AND count(*) = count(reported) AS passed FROM m WHERE size >= 5""")),
    "eval_group_shares": (shares, check(f"""WITH {_MATCH} SELECT planted, round(n / t, 6) AS got, round(size / t, 6) AS want,
        abs(n / t - size / t) <= 0.1 AS close FROM m JOIN rs USING (reported), (SELECT count(*) AS t FROM call_log) WHERE size >= 5""")),
    "eval_derived_labels": (derived, f"WITH {STORE_SQL} {_RELEVANT}"),
    "eval_thin_queries": (thin, f"""WITH {STORE_SQL}, r AS ({_RELEVANT}), q AS (SELECT unnest({_sql_list(_SPECS)}) AS query_id)
        SELECT query_id, count(doc_id) AS n FROM q LEFT JOIN r USING (query_id) GROUP BY 1 HAVING count(doc_id) < 2"""),
    "eval_misplaced_labels": (misplaced, f"""WITH {STORE_SQL}, r AS ({_RELEVANT}) SELECT query_id, doc_id FROM r JOIN store USING (doc_id)
        WHERE (query_id = 'q03' AND date < '2026-03-07') OR (query_id = 'q05' AND home_branch IS NULL)"""),
    "eval_most_spoken": (spoken, """WITH s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS spoken FROM documents)
        SELECT spoken, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, spoken) - 1 AS INT) AS place FROM s GROUP BY 1
        QUALIFY place < 20"""),
    "eval_repeated_endings": (endings, check("""SELECT right(lpad(CAST(account_id AS VARCHAR), CAST(greatest(4, length(CAST(account_id AS VARCHAR))) AS INT), '0'), 4) AS last4,
        count(DISTINCT account_id) AS n FROM account GROUP BY 1 HAVING count(DISTINCT account_id) > 1""")),
    "eval_phrase_categories": (phrase_homes, f"""WITH {_HELD} SELECT query_id AS item_id, string_agg(DISTINCT lang, ',' ORDER BY lang) AS categories,
        count(DISTINCT lang) > 1 AS ambiguous FROM held JOIN documents USING (doc_id) GROUP BY 1"""),
    "eval_wording_overlap": (overlap, f"""WITH p AS (SELECT a.conv_id, a.turn, list_sort(list_distinct(list_filter({_tok('a.text')},
            lambda w: list_contains({_tok('b.text')}, w) AND NOT list_contains({_sql_list(L.STOPWORDS)}, w)))) AS w
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
        SELECT conv_id, turn, array_to_string(w, ' ') AS shared, len(w) > 1 AS too_close FROM p"""),
    "eval_named_metrics": (golden, f"WITH {_QUESTIONS} SELECT a.doc_id, coalesce(names, '') AS names FROM asked a LEFT JOIN named USING (doc_id)"),
    "eval_expected_interrupts": (interrupts, f"""WITH {_QUESTIONS}, {_TERM_SQL}, t AS (
        SELECT doc_id, term, count(*) FILTER (votes > 0) AS hits, string_agg(metric, ',' ORDER BY ord) AS every,
            string_agg(metric, ',' ORDER BY ord) FILTER (votes > 0) AS voted_for, list(metric) AS c FROM voted GROUP BY 1, 2)
        SELECT doc_id, term, coalesce(voted_for, every) AS options FROM t JOIN named USING (doc_id) WHERE hits <> 1 AND NOT list_has_any(l, c)"""),
    "eval_settled_metrics": (settled, f"""WITH {_QUESTIONS}, {_TERM_SQL}, t AS (
        SELECT doc_id, term, list(metric) FILTER (votes > 0) AS hits, list(metric) AS c FROM voted GROUP BY 1, 2),
        extra AS (SELECT doc_id, hits[1] AS m FROM t JOIN named USING (doc_id) WHERE len(hits) = 1 AND NOT list_has_any(l, c)),
        every AS (SELECT doc_id, m FROM extra UNION ALL SELECT doc_id, unnest(l) FROM named)
        SELECT doc_id, string_agg(m, ',' ORDER BY m) AS metrics FROM every GROUP BY 1"""),
    "eval_lowest_match": (picked, f"WITH {STORE_SQL} SELECT " + " UNION ALL SELECT ".join(
        f"'{n}' AS pick, min(call_id) AS call_id FROM store WHERE " + " AND ".join(
            f"{k} = " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in p.items()) for n, p in PICKS.items())),
    "eval_change_questions": (change_set, check("""
        WITH e AS (SELECT category || '/' || year(day) AS id, min(day) AS d, year(min(day)) AS y FROM call_log GROUP BY category, year(day))
        SELECT 'c:' || id AS id, CASE WHEN y = 2000 THEN 'missing' ELSE id END AS event,
            CASE WHEN id LIKE '1-%' THEN 'call_volume' ELSE 'csat_average_score' END AS metric,
            CASE WHEN y <> 2000 THEN strftime(d, '%Y-%m-%d') END AS change_point,
            CASE WHEN y = 1999 THEN 'event of another split' WHEN y = 2000 THEN 'no such event' END AS problem FROM e""")),
    "eval_selected_examples": (examples, f"""WITH {STORE_SQL} SELECT call_id AS golden_id, category AS kind FROM store
        WHERE category IN ('fr', 'de') ORDER BY call_id LIMIT 25"""),
    "text_terms": (term_rows, f"""WITH {_QUESTIONS}, {_TERM_SQL}, best AS (SELECT *, max(votes) OVER (PARTITION BY doc_id, term) AS mv,
            max("full") OVER (PARTITION BY doc_id, term) AS mf FROM voted)
        SELECT doc_id, term, string_agg(metric, ',' ORDER BY ord) AS candidates FROM best
        WHERE CASE WHEN mf > 0 THEN "full" = mf ELSE votes = mv END GROUP BY 1, 2"""),
}

"""Training-set construction and deterministic assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricway.operators import assign as A
from metricway.operators import training as T
from metricway.session import dealt
from registry.base import check, plain, rounded, tables
from registry.changes import calls_of
from registry.searches import doc_store

TEMPLATES = {
    "account_balance": [
        [("MEMBER", "Hi, I am {member_id} and want my balance."),
         ("AGENT", "Your ledger balance is {balance} and {secondary_balance} is available, {member_id}.")],
        [("MEMBER", "Balance please (mine)."), ("AGENT", "It is {balance}, of which {secondary_balance} is free.")]],
    "rate_inquiry": [[("MEMBER", "What rate do I get?"), ("AGENT", "You get {rate} on {balance}. Again: {rate}.")]],
    "account_opening": [[("AGENT", "A new account pays {new_account_apy}.")]],
    "fraud_dispute": [[("MEMBER", "I see a charge against {balance}."), ("AGENT", "We opened a dispute on {balance}.")]],
}


def calls(spark, sf):
    """A call per order in four categories; some repeat a figure wrongly."""
    o = tables(spark, sf)["orders"]
    k = F.col("o_orderkey")
    money = F.col("o_totalprice").cast("decimal(14,2)").cast("string")
    return o.select(
        F.concat(F.lit("CALL-"), F.lpad(k.cast("string"), 12, "0")).alias("call_id"), k.alias("k"),
        F.element_at(F.array(*map(F.lit, TEMPLATES)), (k % 4 + 1).cast("int")).alias("category"),
        F.concat(F.lit("$"), money).alias("b"), F.concat(F.lit("$"), money, F.lit("9")).alias("s"),
        F.concat((F.col("o_custkey") % 40).cast("string"), F.lit("%")).alias("r"),
        F.when(F.col("o_orderstatus") == "P", None).otherwise("banking").alias("subject_lob"))


def turns(spark, sf):
    """The turns of each call, all in one partition: what follows by call is not shuffled."""
    c = dealt(calls(spark, sf), "call_id")
    k = F.col("k")

    def turn(speaker, text):
        return F.struct(F.lit(speaker).alias("speaker"), text.alias("text"))

    me = F.concat(F.lit("MBR-"), k.cast("string"))
    balance = F.when(k % 8 == 0, F.array(
        turn("MEMBER", F.concat(F.lit("Hi, I am "), me, F.lit(" and want my balance."))),
        turn("AGENT", F.concat(F.lit("Your ledger balance is "), "b", F.lit(" and "), "s", F.lit(" is available, "), me, F.lit("."))))).otherwise(F.array(
            turn("MEMBER", F.lit("Balance please (mine).")),
            turn("AGENT", F.concat(F.lit("It is "), "b", F.lit(", of which "), "s", F.lit(" is free.")))))
    again = F.when(k % 12 == 1, F.lit("0.5%")).otherwise(F.col("r"))
    rate = F.array(turn("MEMBER", F.lit("What rate do I get?")),
                   turn("AGENT", F.concat(F.lit("You get "), "r", F.lit(" on "), "b", F.lit(". Again: "), again, F.lit("."))))
    opening = F.array(turn("AGENT", F.concat(F.lit("A new account pays "), "r", F.lit("."))))
    second = F.when(k % 20 == 3, F.col("s")).otherwise(F.col("b"))
    fraud = F.array(turn("MEMBER", F.concat(F.lit("I see a charge against "), "b", F.lit("."))),
                    turn("AGENT", F.concat(F.lit("We opened a dispute on "), second, F.lit("."))))
    said = F.when(k % 4 == 0, balance).when(k % 4 == 1, rate).when(k % 4 == 2, opening).otherwise(fraud)
    return c.select("call_id", "category", F.posexplode(said).alias("turn", "u")).select(
        "call_id", "category", "turn", "u.speaker", "u.text")


def facts(spark, sf):
    return T.spoken_facts(turns(spark, sf), T.template_rows(TEMPLATES))


def fact_rows(spark, sf):
    def said(key):
        return F.try_element_at("facts", F.lit(key)).alias(key)
    return facts(spark, sf).select("call_id", "variant", *(said(x) for x in ("balance", "secondary_balance", "rate", "new_account_apy", "member_id")))


_CALLS = """c AS (SELECT 'CALL-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS call_id, o_orderkey AS k,
        ['account_balance', 'rate_inquiry', 'account_opening', 'fraud_dispute'][o_orderkey % 4 + 1] AS category,
        '$' || CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) AS b, '$' || CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) || '9' AS s,
        (o_custkey % 40) || '%' AS r, CASE WHEN o_orderstatus <> 'P' THEN 'banking' END AS lob,
        o_orderkey % 12 <> 1 AND o_orderkey % 20 <> 3 AS fits FROM orders)"""


def gold(spark, sf):
    c = dealt(calls(spark, sf), "call_id")
    text = turns(spark, sf).groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("turn", "speaker", "text"))), lambda t: F.concat(t["speaker"], F.lit(": "), t["text"])), " ").alias("text"))
    return T.gold_labels(c.join(facts(spark, sf).select("call_id", "facts"), "call_id").join(text, "call_id"))


def gold_rows(spark, sf):
    g = gold(spark, sf)
    said = F.array_join(F.transform(g["label"]["metric_mentioned"], lambda m: F.concat_ws("=", m["name"], m["value"])), ";")
    return g.select("call_id", F.col("label.product_line"), F.col("label.resolution"), said.alias("said"),
                    F.col("label.follow_up.needed"), F.size(T.label_errors(F.col("label"), F.col("text"))).alias("errors"))


def broken(spark, sf):
    """Gold labels, some with a wrong reason, a value nobody said, or an action missing."""
    g = gold(spark, sf).filter("label IS NOT NULL")
    k, label = F.col("k"), F.col("label")
    reason = F.when(k % 7 == 0, "xx").otherwise(label["reason_for_call"])
    said = F.when(k % 11 == 0, F.array(F.struct(F.lit("balance").alias("name"), F.lit("$-1").alias("value")))).otherwise(label["metric_mentioned"])
    follow = F.when(k % 13 == 0, F.struct(F.lit(True).alias("needed"), F.lit("").alias("action"))).otherwise(label["follow_up"])
    changed = F.struct(reason.alias("reason_for_call"), label["product_line"].alias("product_line"), said.alias("metric_mentioned"),
                       label["resolution"].alias("resolution"), follow.alias("follow_up"))
    return g.select("call_id", "text", changed.alias("label"))


def error_rows(spark, sf):
    errors = T.label_errors(F.col("label"), F.col("text"))
    return broken(spark, sf).select("call_id", F.array_join(errors, "|").alias("errors"))


def kept(spark, sf):
    """Three labels a call: the first may be of an older text, the second may be invalid."""
    g = gold(spark, sf).filter("label IS NOT NULL")
    rows = g.select("call_id", "k", "text", "label", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seq"))
    stale = (F.col("seq") == 0) & (F.floor(F.col("k") / 4) % 2 == 0)
    wrong = (F.col("seq") == 1) & (F.floor(F.col("k") / 4) % 3 == 0)
    label = F.col("label")
    marked = F.struct(F.when(wrong, "xx").otherwise(label["reason_for_call"]).alias("reason_for_call"),
                      *(label[f].alias(f) for f in ("product_line", "metric_mentioned", "resolution", "follow_up")))
    labels = rows.select("call_id", "seq", marked.alias("label"),
                         F.sha2(F.when(stale, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("text_sha256"))
    return T.kept_labels(labels, g.select("call_id", "text")).select("call_id", "seq")


def baseline(spark, sf):
    t = tables(spark, sf)
    planted = t["interaction"].filter("outcome = 'escalated'").select("interaction_id")
    rows = T.baseline(t["interaction"].select("interaction_id", "category_code"), planted, t["interaction_account"], t["account"], t["product"])
    return rows.select("interaction_id", "category_code", "account_id", "subject_lob")


def split_rows(spark, sf):
    return T.splits(calls_of(spark, sf).select("call_id", "category"))


_SPLITS = """n AS (SELECT category, count(*) AS n, sum(count(*)) OVER () AS t FROM call_log GROUP BY 1),
    want AS (SELECT *, CAST(round_even(t * 300 / 1250, 0) AS BIGINT) AS wt, CAST(round_even(t * 150 / 1250, 0) AS BIGINT) AS wd FROM n),
    fl AS (SELECT *, (n * wt) // t AS ft, (n * wt) % t AS rt, (n * wd) // t AS fd, (n * wd) % t AS rd FROM want),
    q AS (SELECT category, n, ft + CASE WHEN row_number() OVER (ORDER BY rt DESC, category) <= wt - sum(ft) OVER () THEN 1 ELSE 0 END AS qt,
        fd + CASE WHEN row_number() OVER (ORDER BY rd DESC, category) <= wd - sum(fd) OVER () THEN 1 ELSE 0 END AS qd FROM fl),
    s AS (SELECT call_id, category, sha256('summary_v1:' || call_id) AS hash,
        row_number() OVER (PARTITION BY category ORDER BY sha256('summary_v1:' || call_id)) AS place FROM call_log),
    cut AS (SELECT call_id, category, hash, CASE WHEN place <= least(qt, n) THEN 'test'
        WHEN place <= least(qt, n) + least(qd, n - least(qt, n)) THEN 'dev' ELSE 'train' END AS split FROM s JOIN q USING (category))"""


def quotas(spark, sf):
    """101 places over the categories, and over the branches of each category."""
    n = calls_of(spark, sf).groupBy("category", "home_branch").agg(F.count("*").alias("n"))
    named = n.withColumn("branch", F.coalesce("home_branch", F.lit("none"))).select("category", "branch", "n")
    return A.largest_remainder(named, "branch", "n", F.lit(101), ["category"]).select("category", "branch", "n", "quota")


def teacher(spark, sf):
    """A second label per call that differs in known ways."""
    c = calls(spark, sf)
    k = F.floor(F.col("k") / 4)

    def pair(name, value):
        return F.struct(F.lit(name).alias("name"), F.col(value).alias("value"))

    def label(line, said, needed):
        return F.struct(F.col("category").alias("reason_for_call"), line.alias("product_line"), said.alias("metric_mentioned"),
                        F.lit("information_provided").alias("resolution"),
                        F.struct(needed.alias("needed"), F.lit(None).cast("string").alias("action")).alias("follow_up"))

    both = F.array(pair("balance", "b"), pair("secondary_balance", "s"))
    said = F.when(k % 3 == 0, F.array(pair("balance", "b"))).when(k % 3 == 1, both).otherwise(
        F.array(pair("rate", "b"), pair("secondary_balance", "s")))
    return c.select("call_id", "category", label(F.coalesce("subject_lob", F.lit("unknown")), said, k % 5 == 0).alias("given"),
                    label(F.lit("banking"), both, F.lit(False)).alias("gold"))


def agreement(spark, sf):
    rows = teacher(spark, sf)
    fields = T.agreement(F.col("given"), F.col("gold"))
    return rows.groupBy("category").agg(*(F.round(F.avg(c), 4).alias(n) for n, c in fields.items()))


def review(spark, sf):
    rows = doc_store(spark, sf).select("call_id", "category")
    return T.review_sample(rows).select("call_id", "category", "place")


def to_do(spark, sf):
    log = calls_of(spark, sf)
    return plain(T.pending(log.select("call_id", "day"), log.filter("seconds < 400").select("call_id"), "day", 40))


def fingerprint(spark, sf):
    return T.content_fingerprint(split_rows(spark, sf), "call_id", "split")


def tried(spark, sf):
    return T.attempts(calls(spark, sf).select((F.col("k") % 3 + 1).alias("attempts")))


# ── assignment ────────────────────────────────────────────────────────────────

# Branch shares, fee prices.
SHARES = {"Westside": 0.20, "Downtown": 0.30, "Northgate": 0.25, "Riverside": 0.25}
OVERDRAFT_OLD, OVERDRAFT_NEW = 29.0, 35.0


def branches(spark, sf):
    m = tables(spark, sf)["member"]
    return m.select("member_id", A.hash_bucket(F.col("member_id").cast("string"), SHARES).alias("branch"))


def numbered(spark, sf):
    e = tables(spark, sf)["events"]
    at = F.date_format("ts", "yyyy-MM-dd HH:mm")
    keyed = e.select("event_id", at.alias("at"), A.call_order_hash(F.col("user_id"), F.col("event_type"), at).alias("hash"))
    return A.renumber(keyed, ["at", "hash", "event_id"], "number").select("event_id", "number")


def phase_rows(spark, sf):
    """Three phases from the first day of each category of each year, the last open."""
    log = calls_of(spark, sf)
    events = log.groupBy(F.concat_ws("/", "category", F.year("day")).alias("id")).agg(F.min("day").alias("day")).withColumn(
        "weeks", F.array(F.lit(2), F.lit(30), F.lit(None).cast("int")))
    end = log.agg(F.date_add(F.max("day"), 1).alias("e")).select("e").scalar()
    return plain(A.phases(events, end))


def prices(spark, sf):
    """Overdraft fees at the price of their day; the price changed at the start of 1998."""
    t = tables(spark, sf)["account_transaction"]
    fees = t.filter("txn_type = 'fee'").withColumn("price", A.effective_price(
        F.to_date("posted_at"), F.lit("1998-01-01").cast("date"), OVERDRAFT_OLD, OVERDRAFT_NEW))
    return fees.groupBy(F.year("posted_at").alias("y"), "price").agg(F.count("*").alias("n"))


def shifts(spark, sf):
    s = A.clamped_shift(F.col("score"), F.when(F.col("seconds") % 2 == 0, 2).otherwise(1))
    return calls_of(spark, sf).filter("score IS NOT NULL").select(s.alias("s")).groupBy("s.score", "s.asked", "s.applied").agg(
        F.count("*").alias("n"))


QUERIES = {
    "train_baseline": (baseline, check("""
        WITH subj AS (SELECT interaction_id, min(account_id) AS account_id FROM interaction_account WHERE account_role = 'subject' GROUP BY 1)
        SELECT interaction_id, category_code, account_id, lob AS subject_lob FROM interaction LEFT JOIN subj USING (interaction_id)
        LEFT JOIN account USING (account_id) LEFT JOIN product USING (product_id) WHERE outcome <> 'escalated'""")),
    "train_spoken_facts": (fact_rows, f"""WITH {_CALLS}
        SELECT call_id, CASE WHEN fits THEN CASE WHEN k % 8 = 4 THEN 1 ELSE 0 END END AS variant,
            CASE WHEN fits AND k % 4 <> 2 THEN b END AS balance, CASE WHEN k % 4 = 0 THEN s END AS secondary_balance,
            CASE WHEN fits AND k % 4 = 1 THEN r END AS rate, CASE WHEN k % 4 = 2 THEN r END AS new_account_apy,
            CASE WHEN k % 8 = 0 THEN 'MBR-' || k END AS member_id FROM c"""),
    "train_gold_labels": (gold_rows, f"""WITH {_CALLS}
        SELECT call_id, CASE WHEN fits THEN CASE WHEN k % 4 = 2 THEN 'banking' ELSE coalesce(lob, 'unknown') END END AS product_line,
            CASE WHEN fits THEN ['information_provided', 'information_provided', 'request_submitted', 'dispute_opened'][k % 4 + 1] END AS resolution,
            CASE WHEN fits THEN ['balance=' || b || ';secondary_balance=' || s, 'rate=' || r || ';balance=' || b, 'new_account_apy=' || r, 'balance=' || b][k % 4 + 1] END AS said,
            CASE WHEN fits THEN k % 4 >= 2 END AS needed, CASE WHEN fits THEN 0 ELSE 1 END AS errors FROM c"""),
    "train_label_errors": (error_rows, f"""WITH {_CALLS} SELECT call_id, CASE WHEN k % 7 = 0 AND k % 13 = 0 THEN 'reason_for_call|follow_up'
            WHEN k % 7 = 0 THEN 'reason_for_call' WHEN k % 13 = 0 THEN 'follow_up' WHEN k % 11 = 0 THEN 'not in the text: $-1' ELSE '' END AS errors
        FROM c WHERE fits"""),
    "train_kept_labels": (kept, f"""WITH {_CALLS} SELECT call_id, CASE WHEN (k // 4) % 2 = 1 THEN 0 WHEN (k // 4) % 3 <> 0 THEN 1 ELSE 2 END AS seq
        FROM c WHERE fits"""),
    "train_pending": (to_do, check("""SELECT call_id, strftime(day, '%Y-%m-%d') AS day FROM call_log WHERE seconds >= 400
        ORDER BY day, call_id LIMIT 40""")),
    "train_splits": (split_rows, check(f"WITH {_SPLITS} SELECT * FROM cut")),
    "train_split_counts": (lambda spark, sf: T.split_counts(split_rows(spark, sf)),
                           check(f"WITH {_SPLITS} SELECT split, category, count(*) AS n FROM cut GROUP BY 1, 2")),
    "train_quotas": (quotas, check("""
        WITH g AS (SELECT category, coalesce(home_branch, 'none') AS branch, count(*) AS n FROM call_log GROUP BY 1, 2),
        f AS (SELECT *, 101 * n // sum(n) OVER (PARTITION BY category) AS fl, 101 * n % sum(n) OVER (PARTITION BY category) AS re FROM g)
        SELECT category, branch, n, CAST(fl + CASE WHEN row_number() OVER (PARTITION BY category ORDER BY re DESC, branch)
            <= 101 - sum(fl) OVER (PARTITION BY category) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f""")),
    "train_agreement": (agreement, f"""WITH {_CALLS}, x AS (SELECT *, k // 4 AS j FROM c)
        SELECT category, 1.0::DOUBLE AS reason_for_call, round(avg(CAST(lob IS NOT NULL AS INT)), 4) AS product_line, 1.0::DOUBLE AS resolution,
            round(avg(CAST(j % 5 <> 0 AS INT)), 4) AS follow_up_needed, round(avg([2.0 / 3, 1, 0.5][j % 3 + 1]::DOUBLE), 4) AS metric_pair_f1,
            round(avg([2.0 / 3, 1, 1][j % 3 + 1]::DOUBLE), 4) AS metric_value_f1 FROM x GROUP BY 1"""),
    "train_review_sample": (review, """
        WITH d AS (SELECT 'CALL-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS call_id, lang AS category FROM documents),
        g AS (SELECT category, count(*) AS n, sum(count(*)) OVER () AS t FROM d GROUP BY 1),
        f AS (SELECT *, least(2, n) AS fl, 50 - sum(least(2, n)) OVER () AS spare FROM g),
        slots AS (SELECT category, row_number() OVER (ORDER BY 50 * n / t - held DESC, category DESC) AS r, spare
            FROM (SELECT *, unnest(range(fl, n)) AS held FROM f)),
        q AS (SELECT f.category, fl + count(r) AS quota FROM f LEFT JOIN slots s ON s.category = f.category AND r <= s.spare GROUP BY f.category, fl),
        p AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY sha256('review_v1:' || call_id)) AS INT) AS place FROM d)
        SELECT call_id, category, place FROM p JOIN q USING (category) WHERE place <= quota"""),
    "train_agreement_means": (
        lambda spark, sf: T.agreement_means(teacher(spark, sf), "given", "gold"), f"""WITH {_CALLS}, x AS (SELECT *, k // 4 AS j FROM c)
        SELECT count(*) AS n, 1.0::DOUBLE AS reason_for_call, round(avg(CAST(lob IS NOT NULL AS INT)), 4) AS product_line, 1.0::DOUBLE AS resolution,
            round(avg(CAST(j % 5 <> 0 AS INT)), 4) AS follow_up_needed, round(avg([2.0 / 3, 1, 0.5][j % 3 + 1]::DOUBLE), 4) AS metric_pair_f1,
            round(avg([2.0 / 3, 1, 1][j % 3 + 1]::DOUBLE), 4) AS metric_value_f1 FROM x"""),
    "train_attempts": (tried, "SELECT o_orderkey % 3 + 1 AS attempts, count(*) AS n FROM orders GROUP BY 1"),
    "train_fingerprint": (fingerprint, check(f"""WITH {_SPLITS}, r AS (SELECT sha256(call_id || chr(1) || split) AS h, count(*) AS m FROM cut GROUP BY 1),
        p AS (SELECT h[:4] AS p, sha256(string_agg(h || 'x' || m, '' ORDER BY h)) AS h FROM r GROUP BY h[:4]),
        halves AS (SELECT p[:2] AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM p GROUP BY p[:2])
        SELECT sha256(string_agg(h, '' ORDER BY p)) AS fingerprint FROM halves""")),
    "assign_hash_buckets": (branches, check("""
        WITH u AS (SELECT member_id, ('0x' || sha256(CAST(member_id AS VARCHAR))[:13])::BIGINT / 4503599627370496 AS u FROM member)
        SELECT member_id, CASE WHEN u < 0.2 THEN 'Westside' WHEN u < 0.5 THEN 'Downtown' WHEN u < 0.75 THEN 'Northgate' ELSE 'Riverside' END AS branch FROM u""")),
    "assign_renumber": (numbered, """
        SELECT event_id, row_number() OVER (ORDER BY strftime(ts, '%Y-%m-%d %H:%M'),
            sha256(user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d %H:%M')), event_id) AS number FROM events"""),
    "assign_phases": (phase_rows, check("""
        WITH e AS (SELECT category || '/' || year(day) AS id, min(day) AS d FROM call_log GROUP BY category, year(day)),
        z AS (SELECT max(day) + 1 AS z FROM call_log),
        p AS (SELECT id, 0 AS i, d AS s, d + 14 AS f FROM e UNION ALL SELECT id, 1, d + 14, d + 224 FROM e UNION ALL SELECT id, 2, d + 224, DATE '2999-01-01' FROM e)
        SELECT id, i AS index, strftime(least(s, z), '%Y-%m-%d') AS start, strftime(least(f, z), '%Y-%m-%d') AS "end" FROM p, z""")),
    "assign_prices": (prices, check("""SELECT CAST(year(posted_at) AS INT) AS y, CASE WHEN posted_at >= DATE '1998-01-01' THEN 35.0 ELSE 29.0 END::DOUBLE AS price,
        count(*) AS n FROM account_transaction WHERE txn_type = 'fee' GROUP BY 1, 2""")),
    "assign_clamped_shift": (shifts, check("""
        WITH s AS (SELECT score AS old, CASE WHEN seconds % 2 = 0 THEN 2 ELSE 1 END AS asked FROM call_log WHERE score IS NOT NULL)
        SELECT greatest(1, least(5, old - asked)) AS score, asked, old - greatest(1, least(5, old - asked)) AS applied, count(*) AS n
        FROM s GROUP BY ALL""")),
}

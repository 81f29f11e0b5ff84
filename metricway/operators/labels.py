"""Labelled queries and golden questions, derived from facts and never typed in."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricway.functions.binding import let
from metricway.operators.search import tokens
from metricway.plans.catalog import METRICS

# Function words left out when two wordings are compared.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "d", "did", "do", "does", "for", "from", "has",
    "have", "how", "i", "if", "in", "is", "it", "its", "m", "me", "my", "no", "not", "of", "on", "or", "our", "s",
    "so", "that", "the", "their", "them", "then", "there", "this", "to", "up", "was", "we", "what", "when", "where",
    "which", "who", "will", "with", "would", "you", "your",
)
MIN_RELEVANT = 2
MAX_SHARED = 1

# Ambiguous terms: aliases, phrases that mean something else, candidates with qualifiers.
TERMS = {
    "rate": (
        ("rate", "rates"),
        ("first contact resolution rate", "resolution rate", "rate lock", "rate locks", "response rate"),
        {"average_mortgage_note_rate": ("mortgage note", "note rate", "mortgage"),
         "weighted_mortgage_portfolio_rate": ("weighted", "portfolio", "mortgage"),
         "average_heloc_current_rate": ("heloc",),
         "average_credit_card_purchase_apr": ("purchase", "credit card"),
         "average_credit_card_cash_advance_apr": ("cash advance",),
         "average_deposit_apy": ("deposit", "apy", "savings"),
         "average_investment_return_pct": ("investment", "return")}),
    "balance": (
        ("balance", "balances"), (),
        {"mortgage_principal_balance": ("mortgage", "principal"), "escrow_balance": ("escrow",),
         "heloc_drawn_balance": ("heloc", "drawn"), "banking_ledger_balance": ("ledger",),
         "banking_available_balance": ("banking", "available"), "checking_available_balance": ("checking",),
         "savings_balance": ("savings",), "credit_card_outstanding": ("credit card", "outstanding"),
         "investment_market_value": ("market value",),
         "investment_cash_value": ("investment cash", "settled cash")}),
    "lcv": (
        ("lcv", "ltv"), (),
        {"member_lifetime_value": ("lifetime", "customer value", "member value"),
         "loan_to_value": ("loan to value", "underwriting", "origination")}),
    "fee": (
        ("fee", "fees"),
        ("fee call", "fee calls", "fee dispute", "fee disputes", "dispute fees", "fee schedule", "fee change"),
        {"overdraft_fee_revenue": ("overdraft",), "nsf_fee_revenue": ("nsf", "insufficient funds"),
         "monthly_maintenance_fee_revenue": ("maintenance", "monthly"), "atm_fee_revenue": ("atm",),
         "total_fee_revenue": ("total", "all")}),
}


def word(phrase: str) -> str:
    """A pattern for the phrase as whole words."""
    return rf"\b{re.escape(phrase.lower())}\b"


def has(text: Column, phrase: str) -> Column:
    return text.rlike(word(phrase))


# ── relevance ─────────────────────────────────────────────────────────────────

def relevant_rows(facts: DataFrame, specs: dict[str, Column], doc: str = "doc_id") -> DataFrame:
    """(query_id, doc) for every fact row a query's condition holds for, in one pass."""
    named = F.array_compact(F.array(*(F.when(c, F.lit(q)) for q, c in specs.items())))
    return facts.select(F.explode(named).alias("query_id"), doc)


def thin_queries(relevant: DataFrame, specs: dict[str, Column]) -> DataFrame:
    """Queries with fewer than two relevant rows."""
    spark = relevant.sparkSession
    asked = spark.createDataFrame([(q,) for q in specs], "query_id string")
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    return asked.join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n")).filter(
        F.col("n") < MIN_RELEVANT)


def misplaced(relevant: DataFrame, facts: DataFrame, filters: dict[str, Column], doc: str = "doc_id") -> DataFrame:
    """Relevant rows that their query's own filter would drop."""
    passing = relevant_rows(facts, filters, doc)
    filtered = relevant.filter(F.col("query_id").isin(list(filters)))
    return filtered.join(passing, ["query_id", doc], "left_anti")


def spoken_ids(docs: DataFrame, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(spoken, doc): each distinct id a text says."""
    return docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("spoken"), doc)


def most_spoken(spoken: DataFrame, places: int) -> DataFrame:
    """The `places` ids said in most texts, ties by id, with their place from 0."""
    counts = spoken.groupBy("spoken").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "spoken").limit(places)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "spoken")) - 1)


def repeated_endings(accounts: DataFrame, column: str) -> DataFrame:
    """Last-four digits shared by more than one account: "ending in NNNN" would be ambiguous."""
    shown = F.col(column).cast("string")
    last4 = F.right(F.lpad(shown, F.greatest(F.lit(4), F.length(shown)), "0"), F.lit(4))  # lpad cuts what is longer
    return accounts.select(column).distinct().groupBy(last4.alias("last4")).agg(F.count("*").alias("n")).filter("n > 1")


def phrase_categories(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """phrase (item_id), categories: where a phrase is said; more than one breaks an exact query."""
    return pairs.join(facts.select("doc_id", "category"), "doc_id").groupBy("item_id").agg(
        F.array_sort(F.collect_set("category")).alias("categories"))


def shared_words(a: Column, b: Column) -> Column:
    """Content words two wordings share."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_sort(F.array_intersect(F.array_except(tokens(a), stop), tokens(b)))


# ── questions ─────────────────────────────────────────────────────────────────

def label_core(label: str) -> str:
    """What a question must contain to name a metric."""
    bare = re.sub(r"\([^)]*\)", " ", label).replace("%", " ").lower()
    return " ".join("average" if w == "avg" else w for w in bare.split())


def named_metrics(question: Column, labels: dict[str, str] | None = None) -> Column:
    """Names of the metrics whose label stands in the question, by position; a label inside a
    longer match does not count. (An array of name, from, to.)"""
    cores = {n: label_core(t) for n, t in (labels or {n: m.label for n, m in METRICS.items()}).items()}
    q = F.lower(question)
    spans = F.filter(F.array(*(F.struct(
        F.regexp_instr(q, F.lit(word(c))).alias("from"), F.lit(len(c)).alias("long"), F.lit(n).alias("name"))
        for n, c in cores.items())), lambda s: s["from"] > 0)

    def outer(found: Column) -> Column:
        def covers(o: Column, s: Column) -> Column:
            return (o["from"] <= s["from"]) & (s["from"] + s["long"] <= o["from"] + o["long"]) & (o["long"] > s["long"])

        kept = F.filter(found, lambda s: ~F.exists(found, lambda o: covers(o, s)))
        return F.transform(F.array_sort(kept), lambda s: s["name"])

    return let(spans, outer)


def _votes(text: Column, qualifiers: tuple[str, ...]) -> Column:
    return sum((has(text, q).cast("int") for q in qualifiers), F.lit(0))


def _strongest(scored: Column) -> Column:
    """The candidates named in full (the longest name), else those with the most votes."""
    def strongest(found: Column) -> Column:
        best = F.struct(F.array_max(F.transform(found, lambda c: c["full"])).alias("full"),
                        F.array_max(F.transform(found, lambda c: c["votes"])).alias("votes"))
        return let(best, lambda b: F.filter(found, lambda c: F.when(
            b["full"] > 0, c["full"] == b["full"]).otherwise(c["votes"] == b["votes"])))

    return let(scored, strongest)


def matched_terms(question: Column, skip: tuple[str, ...] = ()) -> Column:
    """Ambiguous terms in order of appearance: array of (at, term, candidates).

    A candidate named in full wins (the longest name); else those with most qualifier votes;
    with no vote at all every candidate stays.
    """
    q = F.lower(question)
    found = []
    for term, (aliases, unless, candidates) in TERMS.items():
        if term in skip:
            continue
        bare = reduce(lambda t, p: F.regexp_replace(t, word(p), " "), unless, q)
        spots = [F.regexp_instr(bare, F.lit(word(a))) for a in aliases]
        at = reduce(lambda a, b: F.when(a == 0, b).when(b == 0, a).otherwise(F.least(a, b)), spots)
        scored = F.array(*(F.struct(
            F.when(has(q, m.replace("_", " ")), F.lit(len(m))).otherwise(0).alias("full"),
            _votes(q, quals).alias("votes"), F.lit(m).alias("metric")) for m, quals in candidates.items()))
        kept = _strongest(scored)
        found.append(F.struct(at.alias("at"), F.lit(term).alias("term"),
                              F.transform(kept, lambda c: c["metric"]).alias("candidates")))
    return F.array_sort(F.filter(F.array(*found), lambda f: f["at"] > 0))


def expected_interrupts(question: Column, names: Column) -> Column:
    """Terms the question leaves open: array of (at, term, options). A term is settled by a named
    candidate or by a single candidate with a vote."""
    q = F.lower(question)
    found = []
    for term, (aliases, unless, candidates) in TERMS.items():
        bare = reduce(lambda t, p: F.regexp_replace(t, word(p), " "), unless, q)
        spots = [F.regexp_instr(bare, F.lit(word(a))) for a in aliases]
        at = reduce(lambda a, b: F.when(a == 0, b).when(b == 0, a).otherwise(F.least(a, b)), spots)
        hits = F.array_compact(F.array(*(F.when(_votes(q, quals) > 0, F.lit(m)) for m, quals in candidates.items())))
        every = F.array(*map(F.lit, candidates))
        settled = F.arrays_overlap(names, every) | (F.size(hits) == 1)
        found.append(F.struct(F.when(settled, 0).otherwise(at).alias("at"), F.lit(term).alias("term"),
                              F.when(F.size(hits) > 0, hits).otherwise(every).alias("options")))
    return F.array_sort(F.filter(F.array(*found), lambda f: f["at"] > 0))


def settled_metrics(question: Column, names: Column) -> Column:
    """Metrics a question settles without naming them: the one candidate of a term with a vote."""
    q = F.lower(question)
    out = []
    for term, (aliases, unless, candidates) in TERMS.items():
        bare = reduce(lambda t, p: F.regexp_replace(t, word(p), " "), unless, q)
        said = reduce(lambda a, b: a | b, (has(bare, a) for a in aliases))
        hits = F.array_compact(F.array(*(F.when(_votes(q, quals) > 0, F.lit(m)) for m, quals in candidates.items())))
        one = said & (F.size(hits) == 1) & ~F.arrays_overlap(names, F.array(*map(F.lit, candidates)))
        out.append(F.when(one, F.try_element_at(hits, F.lit(1))))
    return F.concat(names, F.array_compact(F.array(*out)))


def lowest_match(calls: DataFrame, picks: dict[str, dict[str, object]]) -> DataFrame:
    """pick, call_id: the lowest call id for which every field has the picked value."""
    found = calls.agg(*(F.min(F.when(reduce(and_, (F.col(k) == F.lit(v) for k, v in p.items())), F.col("call_id"))).alias(n)
                        for n, p in picks.items()))
    return found.select(F.inline(F.array(*(F.struct(F.lit(n).alias("pick"), F.col(n).alias("call_id")) for n in picks))))


def change_questions(specs: DataFrame, truth: DataFrame, split: str) -> DataFrame:
    """Specs (id, event, metric, follow_up_of) with their event's date; a follow-up takes its base's
    metric. `problem` names a spec whose event belongs to another split, or whose base is missing."""
    events = truth.select(F.col("id").alias("event"), F.col("day").alias("change_point"), F.col("split").alias("event_split"))
    base = specs.select(F.col("id").alias("follow_up_of"), F.col("metric").alias("base_metric"))
    rows = specs.join(events, "event", "left").join(base, "follow_up_of", "left")
    problem = (F.when(F.col("event_split") != split, F.lit("event of another split"))
               .when(F.col("change_point").isNull(), "no such event")
               .when(F.col("follow_up_of").isNotNull() & F.col("base_metric").isNull(), "follows nothing"))
    return rows.select("id", "event", F.coalesce("base_metric", "metric").alias("metric"), "change_point", problem.alias("problem"))


def selected(examples: DataFrame, groups: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The examples of the named groups in id order, the first `limit` of them."""
    rows = examples.filter(F.col("kind").isin(groups)) if groups else examples
    ordered = rows.orderBy("golden_id")
    return ordered.limit(limit) if limit else ordered

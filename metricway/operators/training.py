"""Training sets from calls: rule labels, splits, agreement, review samples, manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricway.operators.assign import largest_remainder, rank_by_hash

# The label's vocabularies, the rules per category, split and sample sizes.
PRODUCT_LINES = ("mortgage", "home", "car_insurance", "banking", "cards", "investments", "unknown")
RESOLUTIONS = ("information_provided", "action_completed", "dispute_opened", "request_submitted",
               "offer_pending", "review_needed")
METRIC_NAMES = (
    "balance", "secondary_balance", "ledger_balance", "credit_limit", "outstanding_balance", "available_credit",
    "purchase_apr", "payment_amount", "rate", "note_rate", "current_principal", "ltv", "escrow_balance", "monthly_pi",
    "annual_premium", "monthly_premium", "deductible", "market_value", "cash_value", "ytd_return", "new_account_apy",
    "monthly_fee", "waiver_min_balance", "locked_rate", "expires_at", "loan_amount",
)
# category -> (product line, metrics spoken, resolution, follow-up)
RULES = {
    "account_balance": ("subject_lob", ("balance", "secondary_balance"), "information_provided", None),
    "online_banking_support": ("subject_lob", ("ledger_balance",), "action_completed", None),
    "card_services": ("subject_lob", ("credit_limit", "outstanding_balance", "purchase_apr", "available_credit"),
                      "information_provided", None),
    "fraud_dispute": ("subject_lob", ("balance",), "dispute_opened",
                      "Investigate the disputed charge; the member gets the full resolution in about 10 business days."),
    "payment_assistance": ("subject_lob", ("payment_amount",), "request_submitted",
                           "Process the hardship deferral request and email the member a confirmation."),
    "rate_inquiry": ("subject_lob", ("rate", "balance"), "information_provided", None),
    "loan_inquiry": ("subject_lob", ("rate", "balance"), "offer_pending",
                     "Start a pre-qualification if the member wants one."),
    "mortgage_inquiry": ("subject_lob", ("note_rate", "current_principal", "ltv", "escrow_balance"),
                         "information_provided", None),
    "insurance_service": ("subject_lob", ("annual_premium", "monthly_premium", "deductible"), "offer_pending",
                          "Quote full coverage for the member's vehicle if the member wants it."),
    "investment_review": ("subject_lob", ("market_value", "cash_value", "ytd_return"), "information_provided", None),
    "account_opening": ("banking", ("new_account_apy",), "request_submitted",
                        "Finish opening the savings account and send the member the account details."),
    "fee_dispute": ("subject_lob", ("monthly_fee", "waiver_min_balance"), "action_completed", None),
    "escrow_analysis": ("subject_lob", ("escrow_balance", "monthly_pi"), "review_needed",
                        "Review the escrow adjustment caused by the change in property taxes."),
    "rate_lock_status": ("unknown", ("locked_rate", "expires_at", "loan_amount"), "information_provided", None),
}
CATEGORIES = tuple(RULES)
SPLIT_SIZES = {"train": 800, "dev": 150, "test": 300}
REVIEW_SIZE, REVIEW_FLOOR = 50, 2
SEPARATOR = "\u0001"
LABEL = ("struct<reason_for_call:string,product_line:string,metric_mentioned:array<struct<name:string,value:string>>,"
         "resolution:string,follow_up:struct<needed:boolean,action:string>>")


# ── the corpus ────────────────────────────────────────────────────────────────

def baseline(calls: DataFrame, planted: DataFrame, bridge: DataFrame, account: DataFrame, product: DataFrame) -> DataFrame:
    """Calls without the planted ones, with the line of their subject account (NULL without one)."""
    subject = bridge.filter("account_role = 'subject'").groupBy("interaction_id").agg(F.min("account_id").alias("account_id"))
    lob = account.select("account_id", "product_id").join(product.select("product_id", "lob"), "product_id").drop("product_id")
    return (calls.join(planted, "interaction_id", "left_anti").join(subject, "interaction_id", "left")
            .join(lob, "account_id", "left").withColumnRenamed("lob", "subject_lob"))


# ── spoken facts ──────────────────────────────────────────────────────────────

def template_rows(templates: dict[str, list[list[tuple[str, str]]]]) -> list[tuple]:
    """(category, variant, turns, turn, speaker, pattern, pick, keys) for each templated turn.

    A placeholder captures; said again, it must be the same text. `pick` writes the captures side by side.
    """
    rows = []
    for category, variants in templates.items():
        for v, turns in enumerate(variants):
            for t, (speaker, text) in enumerate(turns):
                keys: list[str] = []
                pattern = ""
                for piece in re.split(r"(\{\w+\})", text):
                    if re.fullmatch(r"\{\w+\}", piece):
                        key = piece[1:-1]
                        if key in keys:
                            pattern += f"\\{keys.index(key) + 1}"
                        else:
                            keys.append(key)
                            pattern += "(.+?)"
                    else:
                        pattern += re.escape(piece)
                pick = SEPARATOR.join(f"${i + 1}" for i in range(len(keys)))
                rows.append((category, v, len(turns), t, speaker, rf"(?s)\A{pattern}\z", pick, keys))
    return rows


def spoken_facts(turns: DataFrame, templates: list[tuple]) -> DataFrame:
    """call_id, category, variant, facts: the first variant of the category that every turn fits,
    with one value per fact. Calls that fit none have a NULL variant.

    `turns` is (call_id, category, turn, speaker, text); `templates` are rows of `template_rows`. Each template is an expression with its
    pattern as a literal, tried only on turns of its category and place: one pass over the turns, and each pattern is compiled once.
    """
    at: dict[tuple[str, int], list[Column]] = {}
    for category, variant, length, turn, speaker, pattern, _, keys in templates:
        said = [F.struct(F.lit(k).alias("k"), F.regexp_extract("text", pattern, i + 1).alias("v")) for i, k in enumerate(keys)]
        entries = F.array(*said) if said else F.array().cast("array<struct<k:string,v:string>>")
        fit = F.when((F.col("speaker") == speaker) & F.col("text").rlike(pattern), F.struct(
            F.lit(variant).alias("variant"), F.lit(length).alias("turns"), entries.alias("entries")))
        at.setdefault((category, turn), []).append(fit)
    per_category: dict[str, Column] = {}
    for (category, turn), fits in at.items():
        here, tried = F.col("turn") == turn, F.array_compact(F.array(*fits))
        per_category[category] = per_category[category].when(here, tried) if category in per_category else F.when(here, tried)
    fits = F.lit(None)
    for category, tried in per_category.items():
        fits = F.when(F.col("category") == category, tried).otherwise(fits)
    calls = turns.select("call_id", "category", fits.alias("fits")).groupBy("call_id", "category").agg(
        F.count("*").alias("told"), F.flatten(F.collect_list("fits")).alias("fits"))  # a call's turns
    of = F.transform(F.array_distinct(F.transform("fits", lambda x: x["variant"])), lambda v: F.struct(
        v.alias("variant"), F.filter("fits", lambda x: x["variant"] == v).alias("met")))
    whole = F.transform(F.filter(of, lambda c: (F.size(c["met"]) == F.col("told")) & (c["met"][0]["turns"] == F.col("told"))),
                        lambda c: F.struct(c["variant"].alias("variant"), F.array_distinct(F.flatten(
                            F.transform(c["met"], lambda x: x["entries"]))).alias("entries")))
    one_value = F.filter(whole, lambda c: F.size(F.array_distinct(F.transform(c["entries"], lambda e: e["k"]))) == F.size(c["entries"]))
    first = F.get(F.array_sort(one_value), F.lit(0))
    picked = calls.select("call_id", "category", first.alias("b"))
    return picked.select("call_id", "category", "b.variant", F.map_from_entries("b.entries").alias("facts"))


# ── labels ────────────────────────────────────────────────────────────────────

def gold_labels(calls: DataFrame) -> DataFrame:
    """Adds label from (category, subject_lob, facts) by the category's rule; NULL without facts."""
    spark = calls.sparkSession
    rules = spark.createDataFrame([(c, p, list(m), r, f) for c, (p, m, r, f) in RULES.items()],
                                  "category string, line string, wanted array<string>, resolution string, action string")
    line = F.when(F.col("line") == "subject_lob", F.coalesce("subject_lob", F.lit("unknown"))).otherwise(F.col("line"))
    mentioned = F.transform("wanted", lambda n: F.struct(n.alias("name"), F.try_element_at("facts", n).alias("value")))
    label = F.struct(F.col("category").alias("reason_for_call"), line.alias("product_line"),
                     mentioned.alias("metric_mentioned"), F.col("resolution"),
                     F.struct(F.col("action").isNotNull().alias("needed"), F.col("action")).alias("follow_up"))
    return calls.join(rules, "category", "left").withColumn(
        "label", F.when(F.col("facts").isNotNull() & F.col("wanted").isNotNull(), label)).drop(
            "line", "wanted", "resolution", "action")


def label_errors(label: Column, text: Column) -> Column:
    """Every reason a label is not valid for its text; empty when it is.

    Values are looked up in the text only once the label's form is right.
    """
    def listed(value: Column, allowed) -> Column:
        return F.coalesce(value.isin(list(allowed)), F.lit(False))

    said = label["metric_mentioned"]
    action, needed = label["follow_up"]["action"], label["follow_up"]["needed"]
    form = {
        "reason_for_call": ~listed(label["reason_for_call"], CATEGORIES),
        "product_line": ~listed(label["product_line"], PRODUCT_LINES),
        "resolution": ~listed(label["resolution"], RESOLUTIONS),
        "metric_mentioned": said.isNull() | F.exists(F.coalesce(said, F.array().cast("array<struct<name:string,value:string>>")),
            lambda m: ~listed(m["name"], METRIC_NAMES) | (F.length(F.coalesce(m["value"], F.lit(""))) == 0)),
        "follow_up": needed.isNull() | (F.coalesce(needed, F.lit(False)) & (F.length(F.coalesce(action, F.lit(""))) == 0))
        | (~F.coalesce(needed, F.lit(True)) & action.isNotNull()),
    }
    wrong = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in form.items())))
    absent = F.transform(F.filter(said, lambda m: ~text.contains(m["value"])),
                         lambda m: F.concat(F.lit("not in the text: "), m["value"]))
    return F.when(label.isNull(), F.array(F.lit("no label"))).when(F.size(wrong) > 0, wrong).otherwise(absent)


def kept_labels(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """One label per call: the first (by seq) whose text hash is the call's own and which is valid."""
    # Joined on the call alone: sides that lie by call are not dealt anew with their texts.
    valid = F.size(label_errors(F.col("label"), F.col("text"))) == 0
    fresh = labels.join(texts.select("call_id", "text"), "call_id").filter(F.when(F.sha2("text", 256) == F.col("text_sha256"), valid))
    return fresh.groupBy("call_id").agg(F.min_by("label", "seq").alias("label"), F.min("seq").alias("seq"))


def pending(wanted: DataFrame, done: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """Calls still to be labelled, in order."""
    rest = wanted.join(done, "call_id", "left_anti").orderBy(order, "call_id")
    return rest.limit(limit) if limit else rest


# ── splits ────────────────────────────────────────────────────────────────────

def splits(calls: DataFrame, sizes: dict[str, int] = SPLIT_SIZES) -> DataFrame:
    """call_id, category, split: per category the lowest hashes are test, the next dev, the rest
    train; quotas by largest remainder, so the totals are exact."""
    whole = sum(sizes.values())
    counted = calls.groupBy("category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row a category
    wanted = counted.withColumn("_test", F.bround(total * sizes["test"] / whole).cast("long")).withColumn(
        "_dev", F.bround(total * sizes["dev"] / whole).cast("long"))
    quota = largest_remainder(wanted, "category", "n", F.col("_test")).withColumnRenamed("quota", "test_quota")
    quota = largest_remainder(quota, "category", "n", F.col("_dev")).withColumnRenamed("quota", "dev_quota")
    test = F.least("test_quota", "n")
    edges = quota.select("category", test.alias("_a"), (test + F.least(F.col("dev_quota"), F.col("n") - test)).alias("_b"))
    hashed = calls.select("call_id", "category", F.sha2(F.concat(F.lit("summary_v1:"), "call_id"), 256).alias("hash"))
    placed = rank_by_hash(hashed, ["category"], "hash", "call_id").join(edges, "category")
    return placed.select("call_id", "category", "hash", F.when(F.col("place") <= F.col("_a"), "test").when(
        F.col("place") <= F.col("_b"), "dev").otherwise("train").alias("split"))


# ── agreement and review ──────────────────────────────────────────────────────

def f1(a: Column, b: Column) -> Column:
    """F1 of two sets; two empty sets agree."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    hit = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when(hit == 0, 0.0).otherwise(
        2.0 * hit / (F.size(x) + F.size(y)))


def agreement(given: Column, gold: Column) -> dict[str, Column]:
    """Per-field agreement of one label with another, 1 = agree."""
    out = {f: (given[f] == gold[f]).cast("double") for f in ("reason_for_call", "product_line", "resolution")}
    out["follow_up_needed"] = (given["follow_up"]["needed"] == gold["follow_up"]["needed"]).cast("double")
    out["metric_pair_f1"] = f1(given["metric_mentioned"], gold["metric_mentioned"])
    out["metric_value_f1"] = f1(*(F.transform(x["metric_mentioned"], lambda m: m["value"]) for x in (given, gold)))
    return out


def review_quotas(sizes: DataFrame, size: int, floor: int = REVIEW_FLOOR) -> DataFrame:
    """category, quota from (category, n): a floor each, the other slots to whoever is furthest below
    its proportional share.

    A category's next slot is wanted by share minus slots held, which falls by one with each
    slot, so handing out one at a time is the same as taking the most wanted slots of all. At
    most `size` slots a category are laid out.
    """
    everyone = Window.partitionBy()  # one row a category
    rows = sizes.withColumn("total", F.sum("n").over(everyone)).withColumn("first", F.least(F.lit(floor), "n"))
    rows = rows.withColumn("spare", F.greatest(F.lit(size) - F.sum("first").over(everyone), F.lit(0)))
    most = F.least("n", F.lit(size)).cast("int")
    slots = rows.filter(most > F.col("first")).select(
        "category", "n", "total", "spare", F.explode(F.sequence(F.col("first").cast("int"), most - 1)).alias("held"))
    want = F.lit(size) * F.col("n") / F.col("total") - F.col("held")
    place = F.row_number().over(Window.orderBy(want.desc(), F.desc("category")))
    given = slots.withColumn("place", place).filter(F.col("place") <= F.col("spare")).groupBy("category").agg(
        F.count("*").alias("more"))
    return rows.join(given, "category", "left").select("category", F.when(F.col("total") <= size, F.col("n")).otherwise(
        F.col("first") + F.coalesce("more", F.lit(0))).alias("quota"))


def review_sample(rows: DataFrame, size: int = REVIEW_SIZE) -> DataFrame:
    """About `size` rows spread over the categories, lowest hashes first."""
    quota = review_quotas(rows.groupBy("category").agg(F.count("*").alias("n")), size)
    hashed = rows.withColumn("hash", F.sha2(F.concat(F.lit("review_v1:"), "call_id"), 256))
    lowest = Window.partitionBy("category").orderBy("hash", "call_id")
    # Each task keeps at most `size` rows of a category before the shuffle.
    near = hashed.withColumn("place", F.row_number().over(lowest)).filter(F.col("place") <= size)
    return near.join(quota, "category").filter(F.col("place") <= F.col("quota")).drop("quota")


# ── manifest ──────────────────────────────────────────────────────────────────

def content_fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One hash of the whole content, whatever the order and partitioning of the rows.

    Equal rows are counted first, so copies are one entry. Entries are folded per prefix, then the
    prefixes' hashes; a fold holds 1/65536 of the distinct rows.
    """
    row = F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns)), 256)
    counted = rows.groupBy(row.alias("h")).agg(F.count("*").alias("n"))
    entry = F.concat("h", F.lit("x"), F.col("n").cast("string"))
    per_prefix = counted.groupBy(F.substring("h", 1, 4).alias("p")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ""), 256).alias("h"))
    per_half = per_prefix.groupBy(F.substring("p", 1, 2).alias("p")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return per_half.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""),
                               256).alias("fingerprint"))


def split_counts(split_rows: DataFrame) -> DataFrame:
    return split_rows.groupBy("split", "category").agg(F.count("*").alias("n"))


def agreement_means(rows: DataFrame, given: str, gold: str) -> DataFrame:
    """One row: how many labels were compared and the mean agreement per field (4 digits)."""
    fields = agreement(F.col(given), F.col(gold))
    return rows.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(n) for n, c in fields.items()))


def attempts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("attempts").agg(F.count("*").alias("n"))

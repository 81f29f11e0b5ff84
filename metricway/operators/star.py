"""The star schema: twelve dimensions, seven facts and the account staging view.

Every table is a function of the operational DataFrames it needs. Small dimensions are
left to Spark's own size-checked broadcast; no join carries a hint, so a dimension that
outgrows the threshold becomes a sort-merge join without a code change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The calendar's span, the snapshot day and the fee words.
CALENDAR_FIRST, CALENDAR_LAST = "2006-01-01", "2026-12-31"
SNAPSHOT_DAY = "2026-08-31"
FEE_WORDS = (
    ("overdraft", "overdraft"),
    ("maintenance", "monthly_maintenance"),
    ("nsf", "nsf"),
    ("atm", "atm"),
)


# ── scalar pieces ─────────────────────────────────────────────────────────────

def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for NULL)."""
    return F.when(condition, 1).otherwise(0)


def optional_column(df: DataFrame, name: str, fallback: Column | None = None,
                    data_type: str = "string") -> Column:
    """The column if the source has it, else the fallback, else a typed NULL."""
    if name in df.columns:
        return F.col(name)
    return (F.lit(None).cast(data_type) if fallback is None else fallback).alias(name)


def fee_type_of(txn_type: Column, description: Column) -> Column:
    """The fee kind read off the description; NULL for anything that is not a fee."""
    words = F.lower(description)
    kind = F.lit("other")
    for word, name in reversed(FEE_WORDS):
        kind = F.when(words.contains(word), name).otherwise(kind)
    return F.when(txn_type == "fee", kind)


# ── staging ───────────────────────────────────────────────────────────────────

_LINE_COLUMNS = {
    "mortgage_account": {
        c: c for c in ("original_principal", "current_principal", "note_rate", "term_months",
                       "monthly_pi", "escrow_balance", "ltv_at_origination", "property_state")
    },
    "home_equity_account": {
        "credit_limit": "heloc_credit_limit", "drawn_balance": "heloc_drawn_balance",
        "base_rate": "heloc_base_rate", "margin": "heloc_margin",
        "draw_period_months": "draw_period_months",
    },
    "auto_insurance_policy": {
        "annual_premium": "insurance_annual_premium",
        "monthly_premium": "insurance_monthly_premium", "coverage_code": "coverage_code",
        "deductible": "insurance_deductible", "vehicle_year": "vehicle_year",
    },
    "banking_account": {
        "sub_type": "banking_sub_type", "ledger_balance": "banking_ledger_balance",
        "available_balance": "banking_available_balance", "apy": "deposit_apy",
        "monthly_fee": "monthly_fee", "waiver_min_balance": "waiver_min_balance",
    },
    "credit_card_account": {
        "credit_limit": "card_credit_limit", "outstanding_balance": "card_outstanding_balance",
        "available_credit": "card_available_credit", "purchase_apr": "purchase_apr",
        "cash_advance_apr": "cash_advance_apr", "rewards_rate": "rewards_rate",
    },
    "investment_account": {
        "inv_type": "inv_type", "market_value": "investment_market_value",
        "cost_basis": "cost_basis", "cash_value": "investment_cash_value",
        "ytd_return_pct": "investment_return_pct", "advisory_fee_bps": "advisory_fee_bps",
    },
}


def stg_account_lob(t) -> DataFrame:
    """One wide row per account, columns qualified by product line.

    All six child joins use account_id, so the account side is shuffled once and stays
    partitioned for the whole chain.
    """
    wide = t["account"].join(t["product"], "product_id")
    for child, columns in _LINE_COLUMNS.items():
        renamed = t[child].select("account_id", *(F.col(a).alias(b) for a, b in columns.items()))
        wide = wide.join(renamed, "account_id", "left")
    lead = ["account_id", "product_id", "primary_member_id", "account_number", "opened_date",
            "status", "opened_by_staff_id", "lob", "product_code", "product_name", "is_active"]
    return wide.select(*lead, *(b for cols in _LINE_COLUMNS.values() for b in cols.values()))


# ── dimensions ────────────────────────────────────────────────────────────────

def d_account(t) -> DataFrame:
    return t["stg_account_lob"].drop("vehicle_year")


def _distinct_code(df: DataFrame, column: str, code: str, name: str) -> DataFrame:
    return (df.select(F.col(column).alias(code)).distinct()
            .withColumn(name, F.col(code)).orderBy(code))


def d_account_status(t) -> DataFrame:
    return _distinct_code(t["account"], "status", "account_status_code", "account_status_name")


def d_channel(t) -> DataFrame:
    return _distinct_code(t["interaction"], "channel", "channel_code", "channel_name")


def d_outcome(t) -> DataFrame:
    return _distinct_code(t["interaction"], "outcome", "outcome_code", "outcome_name")


def d_category(t) -> DataFrame:
    return t["interaction_category"].select("category_code", "category_name", "lob_id")


def d_household(t) -> DataFrame:
    return t["household"].select("household_id", "household_label", "income_band")


def d_member(t) -> DataFrame:
    member = t["member"]
    return member.select(
        "member_id", "household_id", "member_type", "legal_name", "email", "phone", "joined_date",
        "credit_score_band", "residence_state", "business_id", "naics_code", "employee_count",
        optional_column(member, "home_branch"))


def d_product(t) -> DataFrame:
    return t["product"].select("product_id", "lob", "product_code", "product_name", "is_active")


def d_staff(t) -> DataFrame:
    return t["staff"].select("staff_id", "full_name", "team_id", "role", "hire_date")


def d_team(t) -> DataFrame:
    return t["team"].select("team_id", "team_name", "function_area")


def calendar(spark: SparkSession, first: str = CALENDAR_FIRST, last: str = CALENDAR_LAST) -> DataFrame:
    """One row per day, made on the executors from a day range."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date_day"))
    day = F.col("date_day")
    dow = F.weekday(day) + 1

    def floor_to(grain: str) -> Column:
        return F.trunc(day, grain)

    return days.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_key"), day,
        dow.alias("day_of_week_iso"), F.date_format(day, "EEEE").alias("day_name"),
        F.dayofmonth(day).alias("day_of_month"), F.dayofyear(day).alias("day_of_year"),
        floor_to("week").alias("week_start_date"),
        F.date_add(floor_to("week"), 6).alias("week_end_date"),
        F.weekofyear(day).alias("week_of_year"), floor_to("month").alias("month_start_date"),
        F.month(day).alias("month_number"), F.date_format(day, "MMMM").alias("month_name"),
        floor_to("quarter").alias("quarter_start_date"), F.quarter(day).alias("quarter_number"),
        floor_to("year").alias("year_start_date"), F.year(day).alias("year_number"),
        (dow >= 6).alias("is_weekend"))


def d_date(t) -> DataFrame:
    return calendar(t.spark)


def metricflow_time_spine(t) -> DataFrame:
    return t["d_date"].select("date_day")


def d_time(t) -> DataFrame:
    hour = F.col("hour_of_day")

    def clock(h: Column) -> Column:
        return F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00"))

    return t.spark.range(24).select(F.col("id").cast("int").alias("hour_of_day")).select(
        hour.alias("time_key"), hour,
        F.concat_ws("-", clock(hour), clock(hour + 1)).alias("hour_bucket"),
        F.element_at(F.array(*map(F.lit, ("Night", "Morning", "Afternoon", "Evening"))),
                     (F.floor(hour / 6) + 1).cast("int")).alias("time_of_day_bucket"))


# ── facts ─────────────────────────────────────────────────────────────────────

def f_interaction(t) -> DataFrame:
    team = t["staff"].select("staff_id", "team_id")
    return t["interaction"].join(team, "staff_id").select(
        "interaction_id", "member_id", "staff_id", "team_id", "category_code", "started_at",
        "ended_at", "duration_seconds", "channel", "direction", "caller_type", "outcome",
        "first_contact_resolved", F.hour("started_at").alias("hour_of_day"),
        F.to_date("started_at").alias("interaction_date"))


def f_interaction_account(t) -> DataFrame:
    call = t["interaction"].select(
        "interaction_id", "member_id", "staff_id", "category_code", "started_at", "outcome")
    return t["interaction_account"].join(call, "interaction_id").select(
        "interaction_id", "account_id", "account_role", "member_id", "staff_id",
        "category_code", "started_at", "outcome")


def f_csat(t) -> DataFrame:
    call = t["interaction"].select(
        "interaction_id", "member_id", "staff_id", "category_code",
        F.col("started_at").alias("interaction_started_at"))
    team = t["staff"].select("staff_id", "team_id")
    score = F.col("score")
    return t["csat_survey"].join(call, "interaction_id").join(team, "staff_id").select(
        "survey_id", "interaction_id", "score", "comment", "surveyed_at", "question_code",
        "member_id", "staff_id", "team_id", "category_code", "interaction_started_at",
        flag(score == 5).alias("is_promoter"), flag(score <= 2).alias("is_detractor"),
        flag(score >= 4).alias("is_satisfied"))


def f_account_snapshot(t, snapshot_day: str = SNAPSHOT_DAY) -> DataFrame:
    def of_banking(kind: str, column: str) -> Column:
        return F.when((F.col("lob") == "banking") & (F.col("banking_sub_type") == kind), F.col(column))

    same = ["heloc_drawn_balance", "heloc_credit_limit", "banking_ledger_balance",
            "banking_available_balance"]
    tail = ["card_outstanding_balance", "card_credit_limit", "card_available_credit",
            "investment_market_value", "investment_cash_value", "insurance_annual_premium",
            "insurance_monthly_premium", "insurance_deductible"]
    rates = ["purchase_apr", "cash_advance_apr", "deposit_apy", "investment_return_pct",
             "ltv_at_origination"]
    return t["d_account"].select(
        "account_id", F.col("primary_member_id").alias("member_id"), "product_id", "lob", "status",
        "opened_date", F.lit(snapshot_day).cast("date").alias("snapshot_date"),
        F.col("current_principal").alias("mortgage_principal_balance"),
        F.col("original_principal").alias("mortgage_original_principal"),
        F.col("monthly_pi").alias("mortgage_monthly_pi"), "escrow_balance", *same,
        of_banking("checking", "banking_ledger_balance").alias("checking_ledger_balance"),
        of_banking("checking", "banking_available_balance").alias("checking_available_balance"),
        of_banking("savings", "banking_ledger_balance").alias("savings_balance"), *tail,
        F.col("note_rate").alias("mortgage_note_rate"), "heloc_base_rate", "heloc_margin",
        (F.col("heloc_base_rate") + F.col("heloc_margin")).alias("heloc_current_rate"), *rates)


def f_transaction(t) -> DataFrame:
    ledger = t["account_transaction"]
    owner = t["account"].select(
        "account_id", F.col("primary_member_id").alias("member_id"), "product_id")
    lob = t["product"].select("product_id", "lob")
    kind, amount = F.col("txn_type"), F.col("amount")
    guessed = fee_type_of(kind, F.col("description"))
    fee_type = F.when(kind == "fee", F.col("fee_type")) if "fee_type" in ledger.columns else guessed

    def when_kind(name: str, value: Column, extra: Column = F.lit(True)) -> Column:
        return F.when((kind == name) & extra, value).otherwise(0)

    return ledger.join(owner, "account_id").join(lob, "product_id").select(
        "transaction_id", "account_id", "member_id", "product_id", "lob", "posted_at",
        F.to_date("posted_at").alias("transaction_date"), "amount", "txn_type", "status",
        "description", fee_type.alias("fee_type"),
        when_kind("fee", -amount).alias("fee_revenue_amount"),
        when_kind("interest", amount, amount > 0).alias("interest_earned_amount"),
        when_kind("interest", -amount, amount < 0).alias("interest_paid_amount"),
        when_kind("premium", -amount).alias("premium_paid_amount"))


def f_rate_lock(t) -> DataFrame:
    lob = t["product"].select("product_id", "lob")
    status = F.col("status")
    return t["rate_lock"].join(lob, "product_id").select(
        "lock_id", "member_id", "product_id", "lob", "locked_rate", "loan_amount", "locked_at",
        "expires_at", "lock_period_days", "status", F.to_date("locked_at").alias("lock_date"),
        *(flag(status == s).alias(f"is_{s}") for s in ("exercised", "expired", "active", "cancelled")))


def f_rate(t) -> DataFrame:
    lob = t["product"].select("product_id", "lob")
    return t["product_rate"].join(lob, "product_id").select(
        "product_rate_id", "product_id", "lob", "effective_date", "rate_type", "rate_value",
        "is_teaser")


TABLES = {
    f.__name__: f
    for f in (stg_account_lob, d_account, d_account_status, d_category, d_channel, d_date,
              d_household, d_member, d_outcome, d_product, d_staff, d_team, d_time,
              metricflow_time_spine, f_interaction, f_interaction_account, f_csat,
              f_account_snapshot, f_transaction, f_rate_lock, f_rate)
}

# Facts are written by month of their own time column, so a window prunes folders.
PARTITION_TIME = {
    "f_interaction": "started_at", "f_interaction_account": "started_at", "f_csat": "surveyed_at",
    "f_transaction": "posted_at", "f_rate_lock": "locked_at", "f_rate": "effective_date",
}


class Star:
    """The star over a set of operational tables; tables are lazy and made once."""

    def __init__(self, tables):
        self.tables = tables
        self.spark = tables.spark
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            return self.tables[name]
        if name not in self._made:
            self._made[name] = TABLES[name](self)
        return self._made[name]

    def write(self, folder: str, names: list[str] | None = None) -> None:
        """Persist the marts as Parquet: facts by month, the snapshot by its date."""
        for name in names or [n for n in TABLES if not n.startswith("stg_")]:
            df = self[name]
            if name in PARTITION_TIME:
                month = F.date_format(PARTITION_TIME[name], "yyyy-MM")
                df = df.withColumn("month", month)
                # Ranges follow the data: a month with a third of all rows is written by a third of the tasks.
                df.repartitionByRange("month", F.xxhash64(df.columns[0])).write.mode(
                    "overwrite").partitionBy("month").parquet(f"{folder}/{name}")
            elif name == "f_account_snapshot":
                df.write.mode("overwrite").partitionBy("snapshot_date").parquet(f"{folder}/{name}")
            else:
                df.write.mode("overwrite").parquet(f"{folder}/{name}")


class StoredStar(Star):
    """The star read back from a folder written by `Star.write`."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(type("NoTables", (), {"spark": spark})())
        self.folder = folder

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}")
        return self._made[name]

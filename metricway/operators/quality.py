"""Data-quality checks. Each returns the rows (or keys) in violation; an empty result passes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys held by more than one row. NULL keys are not compared."""
    present = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    return df.filter(present).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def outside(column: str, values: list) -> Column:
    """True where a non-NULL value is not in the list."""
    return F.col(column).isNotNull() & ~F.col(column).isin([v for v in values if v is not None])


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(outside(column, values))


def relationships(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Values of `column` with no parent, and how many rows hold each.

    Children are counted per value before the join, so a value held by a third of all rows
    crosses the shuffle as one row per task.
    """
    held = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n"))
    known = parent.select(F.col(field).alias("value"))
    return held.join(known, "value", "left_anti")


# The magnitudes that are never negative, and the ledger's sign rules.
MAGNITUDES = ("mortgage_principal_balance escrow_balance heloc_drawn_balance heloc_credit_limit "
              "banking_ledger_balance banking_available_balance card_outstanding_balance "
              "card_credit_limit card_available_credit investment_market_value investment_cash_value "
              "insurance_annual_premium insurance_deductible").split()
DEBITS = ("withdrawal", "payment", "purchase", "fee", "premium", "transfer")
# line -> (columns only that line may fill, columns it must fill)
LINE_COLUMNS = {
    "mortgage": (("mortgage_note_rate", "ltv_at_origination"),
                 ("mortgage_note_rate", "mortgage_principal_balance")),
    "cards": (("purchase_apr", "cash_advance_apr"), ("purchase_apr", "card_outstanding_balance")),
    "banking": (("deposit_apy",), ("banking_ledger_balance", "banking_available_balance")),
    "home": (("heloc_base_rate",), ("heloc_base_rate", "heloc_drawn_balance")),
    "investments": (("investment_return_pct",), ("investment_market_value", "investment_return_pct")),
    "car_insurance": ((), ("insurance_annual_premium",)),
}


def negative_magnitudes(snapshot: DataFrame) -> DataFrame:
    return snapshot.filter(reduce(or_, (F.col(c) < 0 for c in MAGNITUDES)))


def fee_type_partition(ledger: DataFrame) -> DataFrame:
    """Rows where being a fee and having a fee type do not go together."""
    return ledger.filter((F.col("txn_type") == "fee") != F.col("fee_type").isNotNull()).select(
        "transaction_id", "txn_type", "fee_type")


def line_isolation(snapshot: DataFrame) -> DataFrame:
    """Rows with a line's column filled off that line, or missing on it."""
    lob, bad = F.col("lob"), []
    for line, (only, must) in LINE_COLUMNS.items():
        bad += [(lob != line) & F.col(c).isNotNull() for c in only]
        bad += [(lob == line) & F.col(c).isNull() for c in must]
    return snapshot.filter(reduce(or_, bad))


def ledger_signs(ledger: DataFrame) -> DataFrame:
    kind, amount = F.col("txn_type"), F.col("amount")
    return ledger.filter(((kind == "deposit") & (amount < 0)) | (kind.isin(*DEBITS) & (amount > 0)))


# ── the declared suite ────────────────────────────────────────────────────────

@dataclass(frozen=True)
class Check:
    table: str
    column: str
    kind: str  # unique | not_null | accepted_values | relationships
    values: tuple = ()
    parent: tuple[str, str] | None = None


# The value lists of the declared tests and constraints.
LINES = ("mortgage", "home", "car_insurance", "banking", "cards", "investments")
INCOME_BANDS = ("<$50k", "$50-100k", "$100-200k", ">$200k")
MEMBER_TYPES = ("individual", "business")
BRANCHES = ("Westside", "Downtown", "Northgate", "Riverside")
CREDIT_BANDS = ("excellent", "good", "fair", "poor", None)
AREAS = ("loans", "insurance", "cards", "fraud", "servicing", "investments")
ROLES = ("agent", "specialist", "supervisor")
ACCOUNT_STATUS = ("open", "closed", "delinquent", "charge_off")
SCORES = (1, 2, 3, 4, 5)
TXN_TYPES = ("deposit", "withdrawal", "payment", "purchase", "fee", "interest", "premium", "transfer")
FEE_TYPES = ("overdraft", "nsf", "monthly_maintenance", "atm", "other")
LOCK_STATUS = ("active", "expired", "exercised", "cancelled")


UNIQUE, NOT_NULL = ("unique",), ("not_null",)


def one_of(values: tuple) -> tuple:
    return "accepted_values", values


def parent(table: str, column: str) -> tuple:
    return "relationships", table, column


def _declare(table: str, columns: dict[str, list[tuple]]) -> list[Check]:
    """The checks of a table: its columns with their tests."""
    out = []
    for column, tests in columns.items():
        for kind, *more in tests:
            if kind == "accepted_values":
                out.append(Check(table, column, kind, tuple(more[0])))
            elif kind == "relationships":
                out.append(Check(table, column, kind, parent=tuple(more)))
            else:
                out.append(Check(table, column, kind))
    return out


STAR_CHECKS = [
    *_declare("d_date", {
        "date_day": [UNIQUE, NOT_NULL],
        "year_number": [NOT_NULL],
        "month_number": [NOT_NULL],
    }),
    *_declare("d_time", {
        "time_key": [UNIQUE, NOT_NULL],
    }),
    *_declare("d_household", {
        "household_id": [UNIQUE, NOT_NULL],
        "income_band": [NOT_NULL, one_of(INCOME_BANDS)],
    }),
    *_declare("d_member", {
        "member_id": [UNIQUE, NOT_NULL],
        "member_type": [NOT_NULL, one_of(MEMBER_TYPES)],
        "home_branch": [one_of(BRANCHES)],
        "household_id": [parent("d_household", "household_id")],
        "credit_score_band": [one_of(CREDIT_BANDS)],
    }),
    *_declare("d_team", {
        "team_id": [UNIQUE, NOT_NULL],
        "function_area": [NOT_NULL, one_of(AREAS)],
    }),
    *_declare("d_staff", {
        "staff_id": [UNIQUE, NOT_NULL],
        "team_id": [NOT_NULL, parent("d_team", "team_id")],
        "role": [NOT_NULL, one_of(ROLES)],
    }),
    *_declare("d_category", {
        "category_code": [UNIQUE, NOT_NULL],
    }),
    *_declare("d_product", {
        "product_id": [UNIQUE, NOT_NULL],
        "lob": [NOT_NULL, one_of(LINES)],
    }),
    *_declare("d_account", {
        "account_id": [UNIQUE, NOT_NULL],
        "product_id": [NOT_NULL, parent("d_product", "product_id")],
        "primary_member_id": [NOT_NULL, parent("d_member", "member_id")],
        "status": [NOT_NULL, one_of(ACCOUNT_STATUS)],
    }),
    *_declare("d_channel", {
        "channel_code": [UNIQUE, NOT_NULL],
    }),
    *_declare("d_outcome", {
        "outcome_code": [UNIQUE, NOT_NULL],
    }),
    *_declare("d_account_status", {
        "account_status_code": [UNIQUE, NOT_NULL],
    }),
    *_declare("f_interaction", {
        "interaction_id": [UNIQUE, NOT_NULL],
        "member_id": [parent("d_member", "member_id")],
        "staff_id": [parent("d_staff", "staff_id")],
        "team_id": [parent("d_team", "team_id")],
        "category_code": [parent("d_category", "category_code")],
        "duration_seconds": [NOT_NULL],
    }),
    *_declare("f_interaction_account", {
        "interaction_id": [NOT_NULL, parent("f_interaction", "interaction_id")],
        "account_id": [NOT_NULL, parent("d_account", "account_id")],
    }),
    *_declare("f_csat", {
        "survey_id": [UNIQUE, NOT_NULL],
        "interaction_id": [UNIQUE, NOT_NULL, parent("f_interaction", "interaction_id")],
        "member_id": [parent("d_member", "member_id")],
        "staff_id": [parent("d_staff", "staff_id")],
        "score": [NOT_NULL, one_of(SCORES)],
    }),
    *_declare("f_account_snapshot", {
        "account_id": [NOT_NULL, parent("d_account", "account_id")],
        "member_id": [parent("d_member", "member_id")],
        "product_id": [parent("d_product", "product_id")],
        "snapshot_date": [NOT_NULL],
    }),
    *_declare("f_transaction", {
        "transaction_id": [UNIQUE, NOT_NULL],
        "account_id": [NOT_NULL, parent("d_account", "account_id")],
        "member_id": [parent("d_member", "member_id")],
        "product_id": [parent("d_product", "product_id")],
        "txn_type": [NOT_NULL, one_of(TXN_TYPES)],
        "fee_type": [one_of(FEE_TYPES)],
    }),
    *_declare("f_rate_lock", {
        "lock_id": [UNIQUE, NOT_NULL],
        "member_id": [parent("d_member", "member_id")],
        "product_id": [parent("d_product", "product_id")],
        "status": [NOT_NULL, one_of(LOCK_STATUS)],
    }),
    *_declare("f_rate", {
        "product_rate_id": [UNIQUE, NOT_NULL],
        "product_id": [parent("d_product", "product_id")],
    }),
]

# The raw tables' own constraints: keys, parents and value lists.
RAW_CHECKS = [
    *_declare("household", {
        "household_id": [UNIQUE, NOT_NULL],
        "income_band": [one_of(INCOME_BANDS)],
    }),
    *_declare("member", {
        "member_id": [UNIQUE, NOT_NULL],
        "member_type": [one_of(MEMBER_TYPES)],
        "credit_score_band": [one_of(CREDIT_BANDS)],
        "household_id": [parent("household", "household_id")],
    }),
    *_declare("team", {
        "team_id": [UNIQUE, NOT_NULL],
        "function_area": [one_of(AREAS)],
    }),
    *_declare("staff", {
        "staff_id": [UNIQUE, NOT_NULL],
        "role": [one_of(ROLES)],
        "team_id": [parent("team", "team_id")],
    }),
    *_declare("product", {
        "product_id": [UNIQUE, NOT_NULL],
        "lob": [one_of(LINES)],
    }),
    *_declare("account", {
        "account_id": [UNIQUE, NOT_NULL],
        "status": [one_of(ACCOUNT_STATUS)],
        "product_id": [parent("product", "product_id")],
        "primary_member_id": [parent("member", "member_id")],
    }),
    *_declare("account_owner", {
        "account_id,member_id": [UNIQUE],
        "ownership_role": [one_of(("primary", "joint", "authorized_user"))],
    }),
    *_declare("auto_insurance_policy", {
        "account_id": [UNIQUE, NOT_NULL],
        "coverage_code": [one_of(("liability", "full", "liab+coll"))],
    }),
    *_declare("banking_account", {
        "account_id": [UNIQUE, NOT_NULL],
        "sub_type": [one_of(("checking", "savings", "money_market", "certificate"))],
    }),
    *_declare("investment_account", {
        "account_id": [UNIQUE, NOT_NULL],
        "inv_type": [one_of(("brokerage", "ira", "managed"))],
    }),
    *_declare("product_rate", {
        "product_rate_id": [UNIQUE, NOT_NULL],
        "rate_type": [one_of(("note", "purchase_apr", "cash_advance_apr", "base", "apy"))],
    }),
    *_declare("rate_lock", {
        "lock_id": [UNIQUE, NOT_NULL],
        "status": [one_of(LOCK_STATUS)],
        "product_id": [parent("product", "product_id")],
    }),
    *_declare("interaction", {
        "interaction_id": [UNIQUE, NOT_NULL],
        "channel": [one_of(("phone", "chat", "secure_message", "branch"))],
        "direction": [one_of(("inbound", "outbound", "callback"))],
        "caller_type": [one_of(("member", "business", "internal"))],
        "outcome": [one_of(("resolved", "escalated", "callback_scheduled", "unresolved", "transferred"))],
        "member_id": [parent("member", "member_id")],
    }),
    *_declare("interaction_account", {
        "interaction_id,account_id": [UNIQUE],
        "account_role": [one_of(("subject", "referenced"))],
        "interaction_id": [parent("interaction", "interaction_id")],
        "account_id": [parent("account", "account_id")],
    }),
    *_declare("csat_survey", {
        "survey_id": [UNIQUE, NOT_NULL],
        "interaction_id": [UNIQUE, parent("interaction", "interaction_id")],
        "score": [one_of(SCORES)],
    }),
    *_declare("account_transaction", {
        "transaction_id": [UNIQUE, NOT_NULL],
        "txn_type": [one_of(TXN_TYPES)],
        "status": [one_of(("posted", "pending", "hold"))],
        "account_id": [parent("account", "account_id")],
    }),
]


def suite(tables, checks: list[Check]) -> DataFrame:
    """table, column, test, violations: one row per declared check.

    All row-by-row checks of a table are one aggregate over one scan.
    """
    parts: list[DataFrame] = []
    by_table: dict[str, list[Check]] = {}
    for c in checks:
        if c.kind in ("not_null", "accepted_values"):
            by_table.setdefault(c.table, []).append(c)
            continue
        if c.kind == "unique":
            found = unique(tables[c.table], *c.column.split(","))
            amount = F.count("*")
        else:
            found = relationships(tables[c.table], c.column, tables[c.parent[0]], c.parent[1])
            amount = F.coalesce(F.sum("n"), F.lit(0))
        parts.append(found.agg(amount.alias("violations")).select(
            F.lit(c.table).alias("table_name"), F.lit(c.column).alias("column_name"),
            F.lit(c.kind).alias("test"), F.col("violations").cast("long")))
    for table, rows in by_table.items():
        sums = []
        for c in rows:
            bad = F.col(c.column).isNull() if c.kind == "not_null" else outside(c.column, list(c.values))
            sums.append(F.struct(
                F.lit(table).alias("table_name"), F.lit(c.column).alias("column_name"),
                F.lit(c.kind).alias("test"), F.count_if(bad).alias("violations")))
        parts.append(tables[table].agg(F.array(*sums).alias("found")).select(F.inline("found")))
    return reduce(DataFrame.unionByName, parts)

"""The declared columns of the operational tables and the typed reading of their rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tables, keys and column types as the operational database declares them.
TABLES = {
    "household": "household_id UUID, household_label TEXT, income_band TEXT",
    "member": ("member_id BIGINT, household_id UUID, member_type TEXT, legal_name TEXT, email TEXT, phone TEXT, "
               "joined_date DATE, credit_score_band TEXT, residence_state TEXT, business_id TEXT, naics_code TEXT, "
               "employee_count INT, home_branch TEXT"),
    "team": "team_id INT, team_name TEXT, function_area TEXT",
    "staff": "staff_id INT, full_name TEXT, team_id INT, role TEXT, hire_date DATE",
    "product": "product_id INT, lob TEXT, product_code TEXT, product_name TEXT, is_active BOOLEAN",
    "account": ("account_id BIGINT, product_id INT, primary_member_id BIGINT, account_number TEXT, opened_date DATE, "
                "status TEXT, opened_by_staff_id INT"),
    "account_owner": "account_id BIGINT, member_id BIGINT, ownership_role TEXT",
    "mortgage_account": ("account_id BIGINT, original_principal NUMERIC(14,2), current_principal NUMERIC(14,2), "
                         "note_rate NUMERIC(6,3), term_months INT, monthly_pi NUMERIC(10,2), escrow_balance NUMERIC(12,2), "
                         "ltv_at_origination NUMERIC(5,2), property_state TEXT"),
    "home_equity_account": ("account_id BIGINT, credit_limit NUMERIC(14,2), drawn_balance NUMERIC(14,2), "
                            "base_rate NUMERIC(6,3), margin NUMERIC(6,3), draw_period_months INT"),
    "auto_insurance_policy": ("account_id BIGINT, annual_premium NUMERIC(10,2), monthly_premium NUMERIC(8,2), "
                              "coverage_code TEXT, deductible NUMERIC(8,2), vehicle_year INT"),
    "banking_account": ("account_id BIGINT, sub_type TEXT, ledger_balance NUMERIC(14,2), available_balance NUMERIC(14,2), "
                        "apy NUMERIC(6,3), monthly_fee NUMERIC(6,2), waiver_min_balance NUMERIC(12,2)"),
    "credit_card_account": ("account_id BIGINT, credit_limit NUMERIC(14,2), outstanding_balance NUMERIC(14,2), "
                            "available_credit NUMERIC(14,2), purchase_apr NUMERIC(6,3), cash_advance_apr NUMERIC(6,3), "
                            "rewards_rate NUMERIC(4,2)"),
    "investment_account": ("account_id BIGINT, inv_type TEXT, market_value NUMERIC(14,2), cost_basis NUMERIC(14,2), "
                           "cash_value NUMERIC(14,2), ytd_return_pct NUMERIC(7,4), advisory_fee_bps INT"),
    "product_rate": ("product_rate_id BIGINT, product_id INT, effective_date DATE, rate_type TEXT, rate_value NUMERIC(7,4), "
                     "is_teaser BOOLEAN"),
    "rate_lock": ("lock_id BIGINT, member_id BIGINT, product_id INT, locked_rate NUMERIC(6,3), loan_amount NUMERIC(14,2), "
                  "locked_at TIMESTAMPTZ, expires_at TIMESTAMPTZ, lock_period_days INT, status TEXT"),
    "interaction_category": "category_code TEXT, category_name TEXT, lob_id INT",
    "interaction": ("interaction_id BIGINT, member_id BIGINT, staff_id INT, category_code TEXT, started_at TIMESTAMPTZ, "
                    "ended_at TIMESTAMPTZ, duration_seconds INT, channel TEXT, direction TEXT, caller_type TEXT, outcome TEXT, "
                    "first_contact_resolved BOOLEAN"),
    "interaction_account": "interaction_id BIGINT, account_id BIGINT, account_role TEXT",
    "interaction_transcript": "interaction_id BIGINT, full_text TEXT, utterances JSONB, turn_count INT",
    "csat_survey": ("survey_id BIGINT, interaction_id BIGINT, score INT, comment TEXT, surveyed_at DATE, question_code TEXT"),
    "account_transaction": ("transaction_id BIGINT, account_id BIGINT, posted_at TIMESTAMPTZ, amount NUMERIC(14,2), "
                            "txn_type TEXT, status TEXT, description TEXT, fee_type TEXT"),
}
KEYS = {
    "account_owner": ("account_id", "member_id"), "interaction_account": ("interaction_id", "account_id"),
    **{t: (spec.split(" ", 1)[0],) for t, spec in TABLES.items() if t not in ("account_owner", "interaction_account")},
}
_PLAIN = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "TEXT": T.StringType(), "UUID": T.StringType(),
          "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMPTZ": T.TimestampType(), "JSONB": T.StringType()}
CALL_NUMBER = r"-(\d+)$"


def spark_type(declared: str) -> T.DataType:
    """The Spark type of a declared column type; an unknown one is an error, never a guess."""
    number = re.fullmatch(r"NUMERIC\((\d+),\s*(\d+)\)", declared)
    if number:
        return T.DecimalType(int(number[1]), int(number[2]))
    if declared not in _PLAIN:
        raise ValueError(f"no type for {declared!r}")
    return _PLAIN[declared]


def declared(table: str) -> dict[str, str]:
    return dict(re.findall(r"(\w+) (\w+(?:\([\d,]+\))?)", TABLES[table]))


def schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, spark_type(d)) for c, d in declared(table).items()])


def as_date(value: Column) -> Column:
    """The day of an ISO date or time: its first ten characters."""
    return F.to_date(F.substring(value, 1, 10))


def call_number(call_id: Column) -> Column:
    """CALL-00042 is call 42."""
    return F.regexp_extract(call_id, CALL_NUMBER, 1).cast("bigint")


def typed(raw: DataFrame, table: str) -> DataFrame:
    """Rows of text as the declared columns. A missing column is NULL; a value that does not fit
    its type fails the job (ANSI casts), so types cannot drift with the data."""
    out = []
    for name, kind in declared(table).items():
        if name not in raw.columns:
            column = F.lit(None).cast(spark_type(kind))
        elif kind == "DATE":
            column = as_date(F.col(name))
        elif kind == "BOOLEAN":
            column = F.col(name).cast("string").cast("boolean")
        elif kind == "JSONB":
            column = F.col(name).cast("string")
        else:
            column = F.col(name).cast(spark_type(kind))
        out.append(column.alias(name))
    return raw.select(*out)


def transcript_rows(raw: DataFrame) -> DataFrame:
    """interaction_transcript from (call_id, full_text, transcript ARRAY<STRUCT>)."""
    return raw.select(call_number(F.col("call_id")).alias("interaction_id"), "full_text",
                      F.to_json("transcript").alias("utterances"), F.size("transcript").alias("turn_count"))

"""Star tables and their pieces (scans of typed raw tables, projections, joins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricway.operators import star as S
from registry.base import check, plain, star, tables, texts

_TYPES = {  # table -> (dates, times, decimals) to print alike
    "stg_account_lob": ("opened_date", "", "original_principal current_principal note_rate monthly_pi "
                        "escrow_balance ltv_at_origination heloc_credit_limit heloc_drawn_balance "
                        "heloc_base_rate heloc_margin insurance_annual_premium "
                        "insurance_monthly_premium insurance_deductible banking_ledger_balance "
                        "banking_available_balance deposit_apy monthly_fee waiver_min_balance "
                        "card_credit_limit card_outstanding_balance card_available_credit purchase_apr "
                        "cash_advance_apr rewards_rate investment_market_value cost_basis "
                        "investment_cash_value investment_return_pct"),
    "d_date": ("date_day week_start_date week_end_date month_start_date quarter_start_date "
               "year_start_date", "", ""),
    "metricflow_time_spine": ("date_day", "", ""),
    "d_member": ("joined_date", "", ""),
    "d_staff": ("hire_date", "", ""),
    "f_interaction": ("interaction_date", "started_at ended_at", ""),
    "f_interaction_account": ("", "started_at", ""),
    "f_csat": ("surveyed_at", "interaction_started_at", ""),
    "f_account_snapshot": ("opened_date snapshot_date", "", "mortgage_principal_balance "
                           "mortgage_original_principal mortgage_monthly_pi escrow_balance "
                           "heloc_drawn_balance heloc_credit_limit banking_ledger_balance "
                           "banking_available_balance checking_ledger_balance "
                           "checking_available_balance savings_balance card_outstanding_balance "
                           "card_credit_limit card_available_credit investment_market_value "
                           "investment_cash_value insurance_annual_premium insurance_monthly_premium "
                           "insurance_deductible mortgage_note_rate heloc_base_rate heloc_margin "
                           "heloc_current_rate purchase_apr cash_advance_apr deposit_apy "
                           "investment_return_pct ltv_at_origination"),
    "f_transaction": ("transaction_date", "posted_at", "amount fee_revenue_amount "
                      "interest_earned_amount interest_paid_amount premium_paid_amount"),
    "f_rate_lock": ("lock_date", "locked_at expires_at", "locked_rate loan_amount"),
    "f_rate": ("effective_date", "", "rate_value"),
}
_TYPES["d_account"] = _TYPES["stg_account_lob"]

# The calendar tables come from a fixed span, not from the given tables; they are checked
# where a fact uses them (star_calendar_calls, star_hours_calls) and in the tests.
_FIXED = ("d_date", "d_time", "metricflow_time_spine")


def _table(name):
    return lambda spark, sf: plain(star(spark, sf)[name])


def calendar_calls(spark, sf):
    """Every call with its calendar attributes: the day dimension at work."""
    s = star(spark, sf)
    calls = s["f_interaction"].groupBy(F.col("interaction_date").alias("date_day")).agg(
        F.count("*").alias("calls"))
    return plain(calls.join(s["d_date"], "date_day"))


def hours_calls(spark, sf):
    s = star(spark, sf)
    calls = s["f_interaction"].groupBy("hour_of_day").agg(F.count("*").alias("calls"))
    return calls.join(s["d_time"], "hour_of_day")


def spine_gaps(spark, sf):
    """Orders per day on the spine: days of the spine without an order count zero."""
    s = star(spark, sf)
    days = s["rate_lock"].groupBy(F.to_date("locked_at").alias("date_day")).agg(
        F.count("*").alias("locks"))
    return plain(s["metricflow_time_spine"].join(days, "date_day", "full_outer").select(
        "date_day", F.coalesce("locks", F.lit(0)).alias("locks")))


def bridge_counts(spark, sf):
    """Distinct calls and accounts over the bridge: never a fact-to-fact join."""
    bridge = star(spark, sf)["f_interaction_account"]
    return bridge.groupBy("category_code", "account_role").agg(
        F.count("*").alias("pairs"), F.countDistinct("interaction_id").alias("calls"),
        F.countDistinct("account_id").alias("accounts"))


def fee_type_column(spark, sf):
    """The ledger when the source has its own fee_type column (here in upper case)."""
    s = star(spark, sf)
    own = s.tables["account_transaction"].withColumn(
        "fee_type", F.upper(F.element_at(F.split("description", " "), 1)))
    s.tables._made["account_transaction"] = own
    return s["f_transaction"].groupBy("txn_type", "fee_type").agg(F.count("*").alias("n"))


def raw_rows(spark, sf):
    """Rows of each of the operational tables."""
    t = tables(spark, sf)
    from metricway.sources.bindings import OLTP

    counts = [t[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in OLTP]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _raw_sql():
    from metricway.sources.bindings import OLTP

    return " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in OLTP)


QUERIES = {
    **{f"star_{n}": (_table(n), check(f"SELECT {texts(*_TYPES.get(n, ('', '', '')))} FROM {n}"))
       for n in S.TABLES if n not in _FIXED},
    "star_calendar_calls": (calendar_calls, check(f"""
        SELECT {texts(_TYPES['d_date'][0])} FROM (
            SELECT d.*, c.calls FROM d_date d JOIN (
                SELECT interaction_date, count(*) AS calls FROM f_interaction GROUP BY 1) c
            ON d.date_day = c.interaction_date)""")),
    "star_hours_calls": (hours_calls, check("""
        SELECT d.*, c.calls FROM d_time d JOIN (
            SELECT hour_of_day, count(*) AS calls FROM f_interaction GROUP BY 1) c USING (hour_of_day)""")),
    "star_spine_gaps": (spine_gaps, check("""
        SELECT strftime(coalesce(s.date_day, l.d), '%Y-%m-%d') AS date_day, coalesce(n, 0) AS locks
        FROM metricflow_time_spine s FULL OUTER JOIN (
            SELECT CAST(locked_at AS DATE) AS d, count(*) AS n FROM rate_lock GROUP BY 1) l
        ON s.date_day = l.d""")),
    "star_bridge_counts": (bridge_counts, check("""
        SELECT category_code, account_role, count(*) AS pairs,
               count(DISTINCT interaction_id) AS calls, count(DISTINCT account_id) AS accounts
        FROM f_interaction_account GROUP BY 1, 2""")),
    "star_fee_type_column": (fee_type_column, check("""
        SELECT txn_type, CASE WHEN txn_type = 'fee' THEN upper(split_part(description, ' ', 1)) END
               AS fee_type, count(*) AS n
        FROM f_transaction GROUP BY 1, 2""")),
    "star_raw_rows": (raw_rows, check(_raw_sql())),
}

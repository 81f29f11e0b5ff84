"""Data-quality checks over the star and the raw tables."""

from __future__ import annotations

from metricway.operators import quality as Q
from registry.base import check, plain, star, tables


def _value(v):
    return f"'{v}'" if isinstance(v, str) else str(v)


def _suite_sql(checks, skip=()):
    parts = []
    for c in checks:
        if c.table in skip:
            continue
        head = f"SELECT '{c.table}' AS table_name, '{c.column}' AS column_name, '{c.kind}' AS test, "
        if c.kind == "unique":
            present = " AND ".join(f"{k} IS NOT NULL" for k in c.column.split(","))
            parts.append(head + f"count(*) AS violations FROM (SELECT {c.column} FROM {c.table} "
                         f"WHERE {present} GROUP BY {c.column} HAVING count(*) > 1)")
        elif c.kind == "not_null":
            parts.append(head + f"count(*) FILTER ({c.column} IS NULL) FROM {c.table}")
        elif c.kind == "accepted_values":
            listed = ", ".join(_value(v) for v in c.values if v is not None)
            parts.append(head + f"count(*) FILTER ({c.column} NOT IN ({listed})) FROM {c.table}")
        else:
            parent, field = c.parent
            parts.append(head + f"count(*) FROM {c.table} child WHERE {c.column} IS NOT NULL AND NOT "
                         f"EXISTS (SELECT 1 FROM {parent} p WHERE p.{field} = child.{c.column})")
    return " UNION ALL ".join(parts)


_SPAN = ("d_date", "d_time")  # a fixed span of days and hours, not a given table
_STAR_CHECKS = [c for c in Q.STAR_CHECKS if c.table not in _SPAN]


def _by(names):
    return ", ".join(names.split())


QUERIES = {
    "dq_unique": (
        lambda spark, sf: Q.unique(tables(spark, sf)["interaction_account"], "interaction_id", "account_id"),
        check("SELECT interaction_id, account_id, count(*) AS n FROM interaction_account "
              "GROUP BY ALL HAVING count(*) > 1")),
    "dq_not_null": (
        lambda spark, sf: Q.not_null(star(spark, sf)["d_member"], "home_branch").select("member_id", "home_branch"),
        check("SELECT member_id, home_branch FROM d_member WHERE home_branch IS NULL")),
    "dq_accepted_values": (
        lambda spark, sf: Q.accepted_values(star(spark, sf)["d_household"], "income_band", Q.INCOME_BANDS),
        check("SELECT * FROM d_household WHERE income_band NOT IN ('<$50k', '$50-100k', '$100-200k', '>$200k')")),
    "dq_relationships": (
        lambda spark, sf: Q.relationships(star(spark, sf)["f_transaction"], "member_id",
                                          star(spark, sf)["d_member"], "member_id"),
        check("SELECT member_id AS value, count(*) AS n FROM f_transaction t WHERE member_id IS NOT NULL "
              "AND member_id NOT IN (SELECT member_id FROM d_member) GROUP BY 1")),
    "dq_balance_signs": (
        lambda spark, sf: plain(Q.negative_magnitudes(star(spark, sf)["f_account_snapshot"]).select(
            "account_id", "lob")),
        check("SELECT account_id, lob FROM f_account_snapshot WHERE least("
              + ", ".join(f"coalesce({c}, 0)" for c in Q.MAGNITUDES) + ") < 0")),
    "dq_fee_partition": (
        lambda spark, sf: Q.fee_type_partition(star(spark, sf)["f_transaction"]),
        check("SELECT transaction_id, txn_type, fee_type FROM f_transaction WHERE (txn_type = 'fee' AND "
              "fee_type IS NULL) OR (txn_type <> 'fee' AND fee_type IS NOT NULL)")),
    "dq_line_isolation": (
        lambda spark, sf: Q.line_isolation(star(spark, sf)["f_account_snapshot"]).select("account_id", "lob"),
        check("""SELECT account_id, lob FROM f_account_snapshot WHERE
            (mortgage_note_rate IS NOT NULL) <> (lob = 'mortgage') OR
            (lob <> 'mortgage' AND ltv_at_origination IS NOT NULL) OR
            (lob = 'mortgage' AND mortgage_principal_balance IS NULL) OR
            (purchase_apr IS NOT NULL) <> (lob = 'cards') OR
            (lob <> 'cards' AND cash_advance_apr IS NOT NULL) OR
            (lob = 'cards' AND card_outstanding_balance IS NULL) OR
            (lob <> 'banking' AND deposit_apy IS NOT NULL) OR
            (lob = 'banking' AND (banking_ledger_balance IS NULL OR banking_available_balance IS NULL)) OR
            (heloc_base_rate IS NOT NULL) <> (lob = 'home') OR
            (lob = 'home' AND heloc_drawn_balance IS NULL) OR
            (investment_return_pct IS NOT NULL) <> (lob = 'investments') OR
            (lob = 'investments' AND investment_market_value IS NULL) OR
            (lob = 'car_insurance' AND insurance_annual_premium IS NULL)""")),
    "dq_ledger_signs": (
        lambda spark, sf: plain(Q.ledger_signs(star(spark, sf)["f_transaction"]).select(
            "transaction_id", "txn_type", "amount")),
        check("""SELECT transaction_id, txn_type, CAST(amount AS DOUBLE) AS amount FROM f_transaction
            WHERE CASE WHEN txn_type = 'deposit' THEN amount < 0 WHEN txn_type = 'interest' THEN false
                  ELSE amount > 0 END""")),
    "dq_star_suite": (lambda spark, sf: Q.suite(star(spark, sf), _STAR_CHECKS), check(_suite_sql(_STAR_CHECKS))),
    "dq_raw_suite": (lambda spark, sf: Q.suite(tables(spark, sf), Q.RAW_CHECKS), check(_suite_sql(Q.RAW_CHECKS))),
}

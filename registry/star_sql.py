"""The star tables in SQL, stated independently of the DataFrame jobs, for the checks."""

STAR_SQL = {
    "stg_account_lob": """
        SELECT a.account_id, a.product_id, a.primary_member_id, a.account_number, a.opened_date,
               a.status, a.opened_by_staff_id, p.lob, p.product_code, p.product_name, p.is_active,
               mo.* EXCLUDE (account_id),
               he.credit_limit AS heloc_credit_limit, he.drawn_balance AS heloc_drawn_balance,
               he.base_rate AS heloc_base_rate, he.margin AS heloc_margin, he.draw_period_months,
               au.annual_premium AS insurance_annual_premium,
               au.monthly_premium AS insurance_monthly_premium, au.coverage_code,
               au.deductible AS insurance_deductible, au.vehicle_year,
               ba.sub_type AS banking_sub_type, ba.ledger_balance AS banking_ledger_balance,
               ba.available_balance AS banking_available_balance, ba.apy AS deposit_apy,
               ba.monthly_fee, ba.waiver_min_balance,
               ca.credit_limit AS card_credit_limit, ca.outstanding_balance AS card_outstanding_balance,
               ca.available_credit AS card_available_credit, ca.purchase_apr, ca.cash_advance_apr,
               ca.rewards_rate, iv.inv_type, iv.market_value AS investment_market_value, iv.cost_basis,
               iv.cash_value AS investment_cash_value, iv.ytd_return_pct AS investment_return_pct,
               iv.advisory_fee_bps
        FROM account a JOIN product p USING (product_id)
        LEFT JOIN mortgage_account mo ON mo.account_id = a.account_id
        LEFT JOIN home_equity_account he ON he.account_id = a.account_id
        LEFT JOIN auto_insurance_policy au ON au.account_id = a.account_id
        LEFT JOIN banking_account ba ON ba.account_id = a.account_id
        LEFT JOIN credit_card_account ca ON ca.account_id = a.account_id
        LEFT JOIN investment_account iv ON iv.account_id = a.account_id""",
    "d_account": "SELECT * EXCLUDE (vehicle_year) FROM stg_account_lob",
    "d_account_status": """SELECT DISTINCT status AS account_status_code, status AS account_status_name
        FROM account""",
    "d_channel": "SELECT DISTINCT channel AS channel_code, channel AS channel_name FROM interaction",
    "d_outcome": "SELECT DISTINCT outcome AS outcome_code, outcome AS outcome_name FROM interaction",
    "d_category": "SELECT category_code, category_name, lob_id FROM interaction_category",
    "d_household": "SELECT household_id, household_label, income_band FROM household",
    "d_member": "SELECT * FROM member",
    "d_product": "SELECT product_id, lob, product_code, product_name, is_active FROM product",
    "d_staff": "SELECT staff_id, full_name, team_id, role, hire_date FROM staff",
    "d_team": "SELECT team_id, team_name, function_area FROM team",
    "d_date": """
        SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS date_day,
               CAST(isodow(d) AS INTEGER) AS day_of_week_iso, dayname(d) AS day_name,
               CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofyear(d) AS INTEGER) AS day_of_year,
               CAST(date_trunc('week', d) AS DATE) AS week_start_date,
               CAST(date_trunc('week', d) AS DATE) + 6 AS week_end_date,
               CAST(weekofyear(d) AS INTEGER) AS week_of_year,
               CAST(date_trunc('month', d) AS DATE) AS month_start_date,
               CAST(month(d) AS INTEGER) AS month_number, monthname(d) AS month_name,
               CAST(date_trunc('quarter', d) AS DATE) AS quarter_start_date,
               CAST(quarter(d) AS INTEGER) AS quarter_number,
               CAST(date_trunc('year', d) AS DATE) AS year_start_date,
               CAST(year(d) AS INTEGER) AS year_number, isodow(d) IN (6, 7) AS is_weekend
        FROM (SELECT CAST(unnest(generate_series(DATE '2006-01-01', DATE '2026-12-31',
                                                 INTERVAL 1 DAY)) AS DATE) AS d)""",
    "metricflow_time_spine": "SELECT date_day FROM d_date",
    "d_time": """
        SELECT CAST(h AS INTEGER) AS time_key, CAST(h AS INTEGER) AS hour_of_day,
               printf('%02d:00-%02d:00', h, h + 1) AS hour_bucket,
               CASE WHEN h < 6 THEN 'Night' WHEN h < 12 THEN 'Morning' WHEN h < 18 THEN 'Afternoon'
                    ELSE 'Evening' END AS time_of_day_bucket
        FROM range(24) AS hours(h)""",
    "f_interaction": """
        SELECT i.*, s.team_id, CAST(hour(i.started_at) AS INTEGER) AS hour_of_day,
               CAST(i.started_at AS DATE) AS interaction_date
        FROM interaction i JOIN staff s USING (staff_id)""",
    "f_interaction_account": """
        SELECT b.interaction_id, b.account_id, b.account_role, i.member_id, i.staff_id,
               i.category_code, i.started_at, i.outcome
        FROM interaction_account b JOIN interaction i USING (interaction_id)""",
    "f_csat": """
        SELECT c.survey_id, c.interaction_id, c.score, c.comment, c.surveyed_at, c.question_code,
               i.member_id, i.staff_id, s.team_id, i.category_code,
               i.started_at AS interaction_started_at, CAST(c.score = 5 AS INTEGER) AS is_promoter,
               CAST(c.score <= 2 AS INTEGER) AS is_detractor,
               CAST(c.score >= 4 AS INTEGER) AS is_satisfied
        FROM csat_survey c JOIN interaction i USING (interaction_id) JOIN staff s USING (staff_id)""",
    "f_account_snapshot": """
        SELECT account_id, primary_member_id AS member_id, product_id, lob, status, opened_date,
               DATE '2026-08-31' AS snapshot_date, current_principal AS mortgage_principal_balance,
               original_principal AS mortgage_original_principal, monthly_pi AS mortgage_monthly_pi,
               escrow_balance, heloc_drawn_balance, heloc_credit_limit, banking_ledger_balance,
               banking_available_balance,
               CASE WHEN banking_sub_type = 'checking' AND lob = 'banking' THEN banking_ledger_balance
                    END AS checking_ledger_balance,
               CASE WHEN banking_sub_type = 'checking' AND lob = 'banking' THEN banking_available_balance
                    END AS checking_available_balance,
               CASE WHEN banking_sub_type = 'savings' AND lob = 'banking' THEN banking_ledger_balance
                    END AS savings_balance,
               card_outstanding_balance, card_credit_limit, card_available_credit,
               investment_market_value, investment_cash_value, insurance_annual_premium,
               insurance_monthly_premium, insurance_deductible, note_rate AS mortgage_note_rate,
               heloc_base_rate, heloc_margin, heloc_base_rate + heloc_margin AS heloc_current_rate,
               purchase_apr, cash_advance_apr, deposit_apy, investment_return_pct, ltv_at_origination
        FROM d_account""",
    "f_transaction": """
        SELECT t.transaction_id, t.account_id, a.primary_member_id AS member_id, a.product_id, p.lob,
               t.posted_at, CAST(t.posted_at AS DATE) AS transaction_date, t.amount, t.txn_type,
               t.status, t.description,
               CASE WHEN txn_type = 'fee' THEN
                    CASE WHEN description ILIKE '%overdraft%' THEN 'overdraft'
                         WHEN description ILIKE '%maintenance%' THEN 'monthly_maintenance'
                         WHEN description ILIKE '%nsf%' THEN 'nsf'
                         WHEN description ILIKE '%atm%' THEN 'atm' ELSE 'other' END END AS fee_type,
               CASE txn_type WHEN 'fee' THEN -amount ELSE 0 END AS fee_revenue_amount,
               CASE txn_type WHEN 'interest' THEN greatest(amount, 0) ELSE 0 END AS interest_earned_amount,
               CASE txn_type WHEN 'interest' THEN greatest(-amount, 0) ELSE 0 END AS interest_paid_amount,
               CASE txn_type WHEN 'premium' THEN -amount ELSE 0 END AS premium_paid_amount
        FROM account_transaction t JOIN account a USING (account_id) JOIN product p USING (product_id)""",
    "f_rate_lock": """
        SELECT r.lock_id, r.member_id, r.product_id, p.lob, r.locked_rate, r.loan_amount, r.locked_at,
               r.expires_at, r.lock_period_days, r.status, CAST(r.locked_at AS DATE) AS lock_date,
               CAST(status = 'exercised' AS INTEGER) AS is_exercised,
               CAST(status = 'expired' AS INTEGER) AS is_expired,
               CAST(status = 'active' AS INTEGER) AS is_active,
               CAST(status = 'cancelled' AS INTEGER) AS is_cancelled
        FROM rate_lock r JOIN product p USING (product_id)""",
    "f_rate": """
        SELECT r.product_rate_id, r.product_id, p.lob, r.effective_date, r.rate_type, r.rate_value,
               r.is_teaser
        FROM product_rate r JOIN product p USING (product_id)""",
}

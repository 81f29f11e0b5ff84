"""Governed metric queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricway.operators import quality, summaries
from metricway.plans.catalog import MEASURES, METRICS, MODELS, catalogue, entity_links, join_paths, path_fanout, reachable_dimensions
from metricway.plans.compiler import MetricQuery
from registry.base import check, plain, rounded, star, tables

JANUARY = {"start": "2024-01-01", "end": "2024-02-01"}


def ask(metrics, group_by="", window=None, where=None, limit=None, digits=6):
    query = MetricQuery(metrics.split(), group_by.split(), window, where, limit)
    return lambda spark, sf: rounded(query.run(star(spark, sf)), digits)


weekly_by_category = ask(
    "call_volume average_handle_time first_contact_resolution_rate",
    "metric_time__week interaction__category_code", JANUARY)


def _r(expr, name, digits=6):
    return f"round(CAST({expr} AS DOUBLE), {digits}) AS {name}"


_SNAPSHOT = {  # metric -> (aggregate, line)
    "average_mortgage_note_rate": ("avg(mortgage_note_rate)", "mortgage"),
    "average_heloc_current_rate": ("avg(heloc_current_rate)", "home"),
    "average_credit_card_purchase_apr": ("avg(purchase_apr)", "cards"),
    "average_credit_card_cash_advance_apr": ("avg(cash_advance_apr)", "cards"),
    "average_deposit_apy": ("avg(deposit_apy)", "banking"),
    "average_investment_return_pct": ("avg(investment_return_pct)", "investments"),
    "banking_available_balance": ("sum(banking_available_balance)", "banking"),
    "banking_ledger_balance": ("sum(banking_ledger_balance)", "banking"),
    "checking_available_balance": ("sum(checking_available_balance)", "banking"),
    "savings_balance": ("sum(savings_balance)", "banking"),
    "credit_card_outstanding": ("sum(card_outstanding_balance)", "cards"),
    "mortgage_principal_balance": ("sum(mortgage_principal_balance)", "mortgage"),
    "heloc_drawn_balance": ("sum(heloc_drawn_balance)", "home"),
    "investment_market_value": ("sum(investment_market_value)", "investments"),
    "investment_cash_value": ("sum(investment_cash_value)", "investments"),
    "escrow_balance": ("sum(escrow_balance)", "mortgage"),
    "loan_to_value": ("avg(ltv_at_origination)", "mortgage"),
    "credit_card_credit_limit": ("sum(card_credit_limit)", "cards"),
    "heloc_credit_limit": ("sum(heloc_credit_limit)", "home"),
    "insurance_coverage_limit": ("avg(insurance_deductible)", "car_insurance"),
}


def _snapshot_select(names):
    return ", ".join(_r(f"{_SNAPSHOT[n][0]} FILTER (p.lob = '{_SNAPSHOT[n][1]}')", n) for n in names)


_JOINED = "f_account_snapshot s LEFT JOIN d_product p ON s.product_id = p.product_id"
_CALLS = "CAST(sum(1) AS BIGINT) AS call_volume"
_AHT = _r("sum(duration_seconds) / nullif(sum(1), 0)", "average_handle_time")
_FCR = _r("sum(CAST(first_contact_resolved AS INT)) / nullif(sum(1), 0)", "first_contact_resolution_rate")
_NPS = _r("(sum(is_promoter) - sum(is_detractor)) / nullif(sum(1), 0) * 100", "nps")


def _fee(kind, name):
    return _r(f"sum(fee_revenue_amount) FILTER (fee_type = '{kind}')", name)


def survey_summary(spark, sf):
    keep = summaries.survey_filter(2, 4, "click", "1996-01-01", "2000-01-01")
    return rounded(summaries.survey_summary(star(spark, sf)["f_csat"], keep))


def parity_diff(spark, sf):
    """The five parity metrics from three computations of the star: compiled, raw, per-category sums."""
    s = star(spark, sf)
    names = list(summaries.TOLERANCES)
    compiled = MetricQuery(names).run(s).select(F.lit("compiled").alias("target"), *(
        F.col(n).cast("double").alias(n) for n in names))
    calls, snap = s["f_interaction"], s["f_account_snapshot"]
    by_hand = calls.agg(
        F.count("*").cast("double").alias("call_volume"),
        F.avg(F.col("first_contact_resolved").cast("int")).alias("first_contact_resolution_rate")).join(
        snap.agg(
            F.avg(F.when(F.col("lob") == "mortgage", F.col("mortgage_note_rate").cast("double"))).alias(
                "average_mortgage_note_rate"),
            F.sum(F.when(F.col("lob") == "banking", F.col("banking_ledger_balance"))).cast("double").alias(
                "banking_available_balance"),
            F.sum(F.when(F.col("lob") == "cards", F.col("card_outstanding_balance"))).cast("double").alias(
                "credit_card_outstanding"))).withColumn("target", F.lit("by_hand"))
    wide = compiled.unionByName(by_hand)
    long = wide.select("target", F.explode(F.create_map(*(
        x for n in names for x in (F.lit(n), F.col(n))))).alias("metric", "value"))
    return rounded(summaries.parity(long, ["compiled", "by_hand"]), 4)


def declared_names(spark, sf):
    """Each declared metric beside the value it has over all the data."""
    wide = MetricQuery(list(METRICS)).run(star(spark, sf))
    long = wide.select(F.explode(F.map_from_arrays(
        F.array(*map(F.lit, METRICS)), F.array(*(F.col(n).cast("double") for n in METRICS)))).alias(
        "name", "value"))
    return catalogue(spark).join(long, "name").select("name", "kind", "label", F.round("value", 4).alias("value"))


def _declared_sql():
    own = {n: f"({a} FILTER (p.lob = '{lob}'))" for n, (a, lob) in _SNAPSHOT.items()}
    own["note_rate_times_balance"] = "(sum(mortgage_note_rate * mortgage_principal_balance) FILTER (p.lob = 'mortgage'))"
    own["weighted_mortgage_portfolio_rate"] = (
        f"CAST({own['note_rate_times_balance']} AS DOUBLE) / CAST({own['mortgage_principal_balance']} AS DOUBLE)")
    own["net_member_liquidity"] = f"{own['banking_available_balance']} - {own['credit_card_outstanding']}"
    places = {n: ("", _JOINED, e) for n, e in own.items()}
    fee = "sum(fee_revenue_amount)"
    for kind, n in (("overdraft", "overdraft_fee_revenue"), ("nsf", "nsf_fee_revenue"),
                    ("monthly_maintenance", "monthly_maintenance_fee_revenue"), ("atm", "atm_fee_revenue")):
        places[n] = ("", "f_transaction", f"{fee} FILTER (fee_type = '{kind}')")
    revenue = "(sum(fee_revenue_amount) + sum(interest_earned_amount))"
    for n, e in {"total_fee_revenue": fee, "total_interest_income": "sum(interest_earned_amount)",
                 "relationship_revenue": revenue, "active_members": "count(DISTINCT member_id)",
                 "member_lifetime_value": f"CAST({revenue} * 24 AS DOUBLE) / count(DISTINCT member_id)"}.items():
        places[n] = ("", "f_transaction", e)
    resolved = "sum(CAST(first_contact_resolved AS INT))"
    for n, e in {"call_volume": "sum(1)", "total_duration_seconds": "sum(duration_seconds)",
                 "average_handle_time": "sum(duration_seconds) / sum(1)",
                 "first_contact_resolved_calls": resolved,
                 "first_contact_resolution_rate": f"{resolved} / sum(1)"}.items():
        places[n] = ("", "f_interaction", e)
    for n, e in {"csat_average_score": "avg(score)", "promoters": "sum(is_promoter)",
                 "detractors": "sum(is_detractor)", "responses": "sum(1)",
                 "nps": "(sum(is_promoter) - sum(is_detractor)) / sum(1) * 100"}.items():
        places[n] = ("", "f_csat", e)
    for n, e in {"rate_locks_count": "sum(1)", "rate_lock_volume": "sum(loan_amount)",
                 "rate_locks_exercised": "sum(is_exercised)", "rate_locks_expired": "sum(is_expired)",
                 "rate_lock_fallout_pct": "sum(is_expired) / sum(1)"}.items():
        places[n] = ("", "f_rate_lock", e)
    parts = []
    for m in METRICS.values():
        _, source, expr = places[m.name]
        parts.append(f"SELECT '{m.name}' AS name, '{m.kind}' AS kind, '{m.label}' AS label, "
                     f"round(CAST({expr} AS DOUBLE), 4) AS value FROM {source}")
    return " UNION ALL ".join(parts)


def model_keys(spark, sf):
    """Each model's primary key: rows and repeated keys. A repeated key would fan a join out."""
    s = star(spark, sf)
    parts = [quality.unique(s[m.table], m.key).agg(F.count("*").alias("repeated")).select(
        F.lit(m.name).alias("model"), F.lit(m.primary).alias("entity"), "repeated")
        for m in MODELS.values()]
    return reduce(DataFrame.unionByName, parts)


def reachability(spark, sf):
    """Every join path between models, and the repeated keys that it would meet in the tables."""
    return path_fanout(join_paths(spark), model_keys(spark, sf).select("model", "repeated"))


def reached_filters(spark, sf):
    """For each filtered metric, whether its dimension is reached from its model, over how many joins, and how many rows have a value there."""
    s = star(spark, sf)
    rows = [(m.name, MEASURES[m.measure].model, m.where[0]) for m in METRICS.values() if m.kind == "simple" and m.where]
    asked = spark.createDataFrame(rows, "metric string, model string, dimension string")
    sizes = reduce(DataFrame.unionByName, (s[m.table].agg(F.count("*").alias("rows")).select(F.lit(m.name).alias("model"), "rows")
                                           for m in MODELS.values()))
    there = reachable_dimensions(spark).withColumnRenamed("start", "model")
    return asked.join(there, ["model", "dimension"], "left").join(sizes, "model").select(
        "metric", "model", "dimension", "hops", F.col("hops").isNotNull().alias("reached"), "rows")


def _keys_sql():
    return " UNION ALL ".join(
        f"SELECT '{m.name}' AS model, (SELECT count(*) FROM (SELECT {m.key} FROM {m.table} WHERE {m.key} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS repeated, "
        f"(SELECT count(*) FROM {m.table}) AS n" for m in MODELS.values())


def _walk_sql():
    """The declared hops as values, walked by a recursive query."""
    target = {m.primary: m.name for m in MODELS.values()}
    links = ", ".join(f"('{m.name}', '{target[e]}')" for m in MODELS.values() for e in m.foreign)
    names = ", ".join(f"('{m}')" for m in MODELS)
    return f"""links(model, target) AS (VALUES {links}), walk(start, target, hops, path) AS (
        SELECT m, m, 0, [m] FROM (VALUES {names}) AS t(m) UNION ALL
        SELECT w.start, l.target, w.hops + 1, list_append(w.path, l.target) FROM walk w JOIN links l ON l.model = w.target
        WHERE NOT list_contains(w.path, l.target))"""


def provenance(spark, sf):
    """The statement that produced the numbers travels with them."""
    compiled = MetricQuery(["call_volume", "nps"], ["interaction__category_code"]).compile()
    return rounded(compiled.run(star(spark, sf)).withColumn("sql_tables", F.lit(",".join(sorted(compiled.tables)))))


QUERIES = {
    "metric_call_volume_weekly": (ask("call_volume", "metric_time__week", JANUARY), check(f"""
        SELECT strftime(CAST(date_trunc('week', started_at) AS DATE), '%Y-%m-%d') AS metric_time__week, {_CALLS}
        FROM f_interaction WHERE started_at >= DATE '2024-01-01' AND started_at < DATE '2024-02-01' GROUP BY 1""")),
    "metric_weekly_by_category": (weekly_by_category, check(f"""
        SELECT strftime(CAST(date_trunc('week', started_at) AS DATE), '%Y-%m-%d') AS metric_time__week,
               category_code AS interaction__category_code, {_CALLS}, {_AHT}, {_FCR}
        FROM f_interaction WHERE started_at >= DATE '2024-01-01' AND started_at < DATE '2024-02-01'
        GROUP BY 1, 2""")),
    "metric_aht_by_category": (
        ask("average_handle_time total_duration_seconds", "interaction__category_code", None,
            {"dimension": "interaction__category_code", "op": "in", "value": ["click", "view", "error"]}),
        check(f"""SELECT category_code AS interaction__category_code, {_AHT},
            CAST(sum(duration_seconds) AS BIGINT) AS total_duration_seconds FROM f_interaction
            WHERE category_code IN ('click', 'view', 'error') GROUP BY 1""")),
    "metric_nps_and_csat_by_month": (
        ask("nps csat_average_score promoters detractors responses", "metric_time__month"), check(f"""
        SELECT strftime(CAST(date_trunc('month', surveyed_at) AS DATE), '%Y-%m-%d') AS metric_time__month, {_NPS},
               {_r('avg(score)', 'csat_average_score')}, CAST(sum(is_promoter) AS BIGINT) AS promoters,
               CAST(sum(is_detractor) AS BIGINT) AS detractors, CAST(sum(1) AS BIGINT) AS responses FROM f_csat GROUP BY 1""")),
    "metric_csat_by_call_category": (
        ask("csat_average_score responses", "interaction__category_code interaction__channel", None,
            [{"dimension": "member__home_branch", "op": "eq", "value": "Downtown"}]), check(f"""
        SELECT i.category_code AS interaction__category_code, i.channel AS interaction__channel,
               {_r('avg(score)', 'csat_average_score')}, CAST(sum(1) AS BIGINT) AS responses
        FROM f_csat c LEFT JOIN f_interaction i ON c.interaction_id = i.interaction_id
        LEFT JOIN d_member m ON c.member_id = m.member_id WHERE m.home_branch = 'Downtown' GROUP BY 1, 2""")),
    "metric_by_day": (ask("call_volume first_contact_resolved_calls", "metric_time__day"), check("""
        SELECT strftime(started_at, '%Y-%m-%d') AS metric_time__day, CAST(sum(1) AS BIGINT) AS call_volume,
               CAST(sum(CAST(first_contact_resolved AS INT)) AS BIGINT) AS first_contact_resolved_calls
        FROM f_interaction GROUP BY 1""")),
    "metric_multi_fact_combine": (
        ask("call_volume nps average_handle_time responses", "interaction__category_code member__home_branch"),
        check(f"""
        WITH calls AS (SELECT category_code, home_branch, {_CALLS}, {_AHT} FROM f_interaction i
                       LEFT JOIN d_member m ON i.member_id = m.member_id GROUP BY 1, 2),
             replies AS (SELECT i.category_code, home_branch, {_NPS}, CAST(sum(1) AS BIGINT) AS responses FROM f_csat c
                       LEFT JOIN f_interaction i ON c.interaction_id = i.interaction_id
                       LEFT JOIN d_member m ON c.member_id = m.member_id GROUP BY 1, 2)
        SELECT coalesce(c.category_code, r.category_code) AS interaction__category_code,
               coalesce(c.home_branch, r.home_branch) AS member__home_branch, call_volume, nps,
               average_handle_time, responses
        FROM calls c FULL OUTER JOIN replies r ON c.category_code IS NOT DISTINCT FROM r.category_code
             AND c.home_branch IS NOT DISTINCT FROM r.home_branch""")),
    "metric_ungrouped_combine": (
        ask("call_volume csat_average_score rate_lock_fallout_pct active_members"), check(f"""
        SELECT * FROM (SELECT {_CALLS} FROM f_interaction),
            (SELECT {_r('avg(score)', 'csat_average_score')} FROM f_csat),
            (SELECT {_r('sum(is_expired) / sum(1)', 'rate_lock_fallout_pct')} FROM f_rate_lock),
            (SELECT count(DISTINCT member_id) AS active_members FROM f_transaction)""")),
    "metric_empty_window_is_null": (
        ask("call_volume average_handle_time active_members", "", {"start": "1950-01-01", "end": "1951-01-01"}),
        check(f"""SELECT * FROM (SELECT {_CALLS}, {_AHT} FROM f_interaction WHERE started_at < DATE '1951-01-01'),
            (SELECT count(DISTINCT member_id) AS active_members FROM f_transaction
             WHERE posted_at < DATE '1951-01-01')""")),
    "metric_household_and_team": (
        ask("call_volume first_contact_resolution_rate", "household__income_band team__function_area staff__role"),
        check(f"""SELECT h.income_band AS household__income_band, t.function_area AS team__function_area,
            s.role AS staff__role, {_CALLS}, {_FCR} FROM f_interaction i
            LEFT JOIN d_member m ON i.member_id = m.member_id
            LEFT JOIN d_household h ON m.household_id = h.household_id
            LEFT JOIN d_team t ON i.team_id = t.team_id LEFT JOIN d_staff s ON i.staff_id = s.staff_id
            GROUP BY ALL""")),
    "metric_entity_hop_household": (
        ask("rate_lock_volume rate_locks_count", "household__household_label metric_time__year"), check(f"""
        SELECT h.household_label AS household__household_label,
               strftime(CAST(date_trunc('year', locked_at) AS DATE), '%Y-%m-%d') AS metric_time__year,
               {_r('sum(loan_amount)', 'rate_lock_volume')}, CAST(sum(1) AS BIGINT) AS rate_locks_count FROM f_rate_lock r
        LEFT JOIN d_member m ON r.member_id = m.member_id
        LEFT JOIN d_household h ON m.household_id = h.household_id GROUP BY ALL""")),
    "metric_snapshot_totals": (ask(" ".join(_SNAPSHOT)), check(
        f"SELECT {_snapshot_select(_SNAPSHOT)} FROM {_JOINED}")),
    "metric_snapshot_by_status": (
        ask("banking_ledger_balance mortgage_principal_balance loan_to_value", "account__account_status"), check(f"""
        SELECT s.status AS account__account_status,
               {_snapshot_select(['banking_ledger_balance', 'mortgage_principal_balance', 'loan_to_value'])}
        FROM {_JOINED} WHERE p.lob IN ('banking', 'mortgage') GROUP BY 1""")),
    "metric_weighted_rate": (
        ask("weighted_mortgage_portfolio_rate average_mortgage_note_rate note_rate_times_balance",
            "product__product_name"), check(f"""
        SELECT p.product_name AS product__product_name,
               {_r('CAST(sum(mortgage_note_rate * mortgage_principal_balance) AS DOUBLE) / nullif(CAST(sum(mortgage_principal_balance) AS DOUBLE), 0)', 'weighted_mortgage_portfolio_rate')},
               {_r('avg(mortgage_note_rate)', 'average_mortgage_note_rate')},
               {_r('sum(mortgage_note_rate * mortgage_principal_balance)', 'note_rate_times_balance')}
        FROM {_JOINED} WHERE p.lob = 'mortgage' GROUP BY 1""")),
    "metric_net_liquidity": (
        ask("net_member_liquidity banking_available_balance credit_card_outstanding", "member__home_branch"), check(f"""
        SELECT m.home_branch AS member__home_branch,
               {_r("sum(banking_available_balance) FILTER (p.lob = 'banking') - sum(card_outstanding_balance) FILTER (p.lob = 'cards')", 'net_member_liquidity')},
               {_snapshot_select(['banking_available_balance', 'credit_card_outstanding'])}
        FROM {_JOINED} LEFT JOIN d_member m ON s.member_id = m.member_id
        WHERE p.lob IN ('banking', 'cards') GROUP BY 1""")),
    "metric_lifetime_value": (
        ask("member_lifetime_value relationship_revenue active_members", "product__lob", None, None, None, 4), check(f"""
        SELECT p.lob AS product__lob,
               {_r('CAST((sum(fee_revenue_amount) + sum(interest_earned_amount)) * 24 AS DOUBLE) / nullif(count(DISTINCT member_id), 0)', 'member_lifetime_value', 4)},
               {_r('sum(fee_revenue_amount) + sum(interest_earned_amount)', 'relationship_revenue', 4)},
               count(DISTINCT member_id) AS active_members
        FROM f_transaction t LEFT JOIN d_product p ON t.product_id = p.product_id GROUP BY 1""")),
    "metric_active_members": (ask("active_members", "metric_time__month transaction__txn_type"), check("""
        SELECT strftime(CAST(date_trunc('month', posted_at) AS DATE), '%Y-%m-%d') AS metric_time__month,
               txn_type AS transaction__txn_type, count(DISTINCT member_id) AS active_members
        FROM f_transaction GROUP BY 1, 2""")),
    "metric_fee_revenue_by_kind": (
        ask("total_fee_revenue overdraft_fee_revenue nsf_fee_revenue monthly_maintenance_fee_revenue "
            "atm_fee_revenue total_interest_income", "metric_time__quarter", {"start": "1996-01-01"}), check(f"""
        SELECT strftime(CAST(date_trunc('quarter', posted_at) AS DATE), '%Y-%m-%d') AS metric_time__quarter,
               {_r('sum(fee_revenue_amount)', 'total_fee_revenue')}, {_fee('overdraft', 'overdraft_fee_revenue')},
               {_fee('nsf', 'nsf_fee_revenue')}, {_fee('monthly_maintenance', 'monthly_maintenance_fee_revenue')},
               {_fee('atm', 'atm_fee_revenue')}, {_r('sum(interest_earned_amount)', 'total_interest_income')}
        FROM f_transaction WHERE posted_at >= DATE '1996-01-01' GROUP BY 1""")),
    "metric_fee_filter": (
        ask("total_fee_revenue active_members", "transaction__fee_type", {"end": "2000-01-01"},
            {"dimension": "transaction__fee_type", "op": "in", "value": ["overdraft", "nsf"]}), check(f"""
        SELECT fee_type AS transaction__fee_type, {_r('sum(fee_revenue_amount)', 'total_fee_revenue')},
               count(DISTINCT member_id) AS active_members FROM f_transaction
        WHERE fee_type IN ('overdraft', 'nsf') AND posted_at < DATE '2000-01-01' GROUP BY 1""")),
    "metric_rate_locks": (
        ask("rate_locks_count rate_lock_volume rate_locks_exercised rate_locks_expired rate_lock_fallout_pct",
            "rate_lock__lock_period_days product__lob"), check(f"""
        SELECT r.lock_period_days AS rate_lock__lock_period_days, p.lob AS product__lob,
               CAST(sum(1) AS BIGINT) AS rate_locks_count, {_r('sum(loan_amount)', 'rate_lock_volume')},
               CAST(sum(is_exercised) AS BIGINT) AS rate_locks_exercised, CAST(sum(is_expired) AS BIGINT) AS rate_locks_expired,
               {_r('sum(is_expired) / nullif(sum(1), 0)', 'rate_lock_fallout_pct')}
        FROM f_rate_lock r LEFT JOIN d_product p ON r.product_id = p.product_id GROUP BY 1, 2""")),
    "metric_limit_and_decimals": (
        lambda spark, sf: plain(MetricQuery(["average_handle_time"], ["interaction__category_code"], limit=3,
                                            decimals=2).run(star(spark, sf))),
        check("""SELECT category_code AS interaction__category_code,
            round(sum(duration_seconds) / sum(1), 2) AS average_handle_time
            FROM f_interaction GROUP BY 1 ORDER BY 1 LIMIT 3""")),
    "metric_catalogue_values": (declared_names, check(_declared_sql())),
    "metric_provenance": (provenance, check(f"""
        SELECT coalesce(a.k, b.k) AS interaction__category_code, call_volume, nps,
               'f_csat,f_interaction' AS sql_tables
        FROM (SELECT category_code AS k, {_CALLS} FROM f_interaction GROUP BY 1) a
        FULL OUTER JOIN (SELECT i.category_code AS k, {_NPS} FROM f_csat c
            LEFT JOIN f_interaction i ON c.interaction_id = i.interaction_id GROUP BY 1) b ON a.k = b.k""")),
    "metric_join_paths": (reachability, "WITH RECURSIVE" + check(f"""WITH {_walk_sql()}, k AS ({_keys_sql()})
        SELECT start, target, hops, array_to_string(path, '>') AS path,
            CAST((SELECT coalesce(sum(repeated), 0) FROM k WHERE list_contains(path[2:], k.model)) AS BIGINT) AS repeated FROM walk""").strip()[4:]),
    "metric_reached_filters": (reached_filters, "WITH RECURSIVE" + check(f"""WITH {_walk_sql()}, k AS ({_keys_sql()}),
        d(model, dimension) AS (VALUES {", ".join(f"('{m.name}', '{m.primary}__{d}')" for m in MODELS.values() for d in m.dimensions)}),
        f(metric, model, dimension) AS (VALUES {", ".join(f"('{m.name}', '{MEASURES[m.measure].model}', '{m.where[0]}')"
                                                        for m in METRICS.values() if m.kind == 'simple' and m.where)})
        SELECT metric, f.model, f.dimension, min(hops) AS hops, count(hops) > 0 AS reached, any_value(n) AS rows
        FROM f JOIN k ON k.model = f.model LEFT JOIN (SELECT start, dimension, hops FROM walk JOIN d ON d.model = walk.target) r
            ON r.start = f.model AND r.dimension = f.dimension GROUP BY 1, 2, 3""").strip()[4:]),
    "metric_model_keys": (model_keys, check(" UNION ALL ".join(
        f"SELECT '{m.name}' AS model, '{m.primary}' AS entity, count(*) AS repeated FROM "
        f"(SELECT {m.key} FROM {m.table} WHERE {m.key} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
        for m in MODELS.values()))),
    "metric_parity_diff": (parity_diff, check("""
        WITH v AS (SELECT sum(CAST(banking_available_balance AS DOUBLE)) AS a,
                          sum(CAST(banking_ledger_balance AS DOUBLE)) AS b FROM f_account_snapshot WHERE lob = 'banking')
        SELECT metric, CASE WHEN metric = 'banking_available_balance' THEN round(abs(b - a), 4) ELSE 0.0 END AS max_diff,
               metric <> 'banking_available_balance' AS ok, CAST(NULL AS VARCHAR) AS note
        FROM v, (VALUES ('call_volume'), ('average_mortgage_note_rate'), ('banking_available_balance'),
                 ('credit_card_outstanding'), ('first_contact_resolution_rate')) AS names(metric)""")),
    "survey_summary": (survey_summary, check("""
        WITH kept AS (SELECT * FROM f_csat WHERE score BETWEEN 2 AND 4 AND category_code = 'click'
                      AND surveyed_at >= DATE '1996-01-01' AND surveyed_at < DATE '2000-01-01')
        SELECT count(*) AS responses, round(avg(score), 6) AS average_score,
               count(*) FILTER (score = 1) AS score_1, count(*) FILTER (score = 2) AS score_2,
               count(*) FILTER (score = 3) AS score_3, count(*) FILTER (score = 4) AS score_4,
               count(*) FILTER (score = 5) AS score_5,
               (SELECT coalesce(string_agg(comment, ' | ' ORDER BY survey_id), '')
                FROM (SELECT * FROM kept ORDER BY survey_id LIMIT 5) WHERE comment <> '') AS comments
        FROM kept""")),
    "count_by_columns": (
        lambda spark, sf: summaries.count_by(tables(spark, sf)["documents"], "lang", "source",
                                             keep=F.col("n_chars") >= 500),
        "SELECT lang, source, count(*) AS n FROM documents WHERE n_chars >= 500 GROUP BY 1, 2"),
}

"""The declared metric catalogue: semantic models, measures and metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SemanticModel:
    name: str
    table: str
    primary: str  # entity name
    key: str  # its column
    time: str | None = None
    foreign: dict[str, str] = field(default_factory=dict)  # entity -> column
    dimensions: dict[str, str] = field(default_factory=dict)  # dimension -> expression


@dataclass(frozen=True)
class Measure:
    name: str
    model: str
    agg: str  # sum | average | count | count_distinct
    expr: str


@dataclass(frozen=True)
class Metric:
    name: str
    label: str
    kind: str  # simple | ratio | derived
    measure: str | None = None
    where: tuple[str, str] | None = None  # (dimension, value)
    expr: str | None = None  # derived: arithmetic over `inputs`
    inputs: tuple[str, ...] = ()  # ratio: (numerator, denominator)

    @property
    def description(self) -> str:
        if self.kind == "simple":
            scope = f" where {self.where[0]} = '{self.where[1]}'" if self.where else ""
            return f"measure {self.measure}{scope}"
        if self.kind == "ratio":
            return f"{self.inputs[0]} / {self.inputs[1]}"
        return str(self.expr)


def _same(names: str) -> dict[str, str]:
    return {n: n for n in names.split()}


# Entities, dimensions, measures and metrics as declared by the data model.
MODELS = {m.name: m for m in (
    SemanticModel("products", "d_product", "product", "product_id",
                  dimensions=_same("lob product_code product_name is_active")),
    SemanticModel("members", "d_member", "member", "member_id", foreign={"household": "household_id"},
                  dimensions=_same("member_type credit_score_band residence_state home_branch")),
    SemanticModel("households", "d_household", "household", "household_id",
                  dimensions=_same("income_band household_label")),
    SemanticModel("staff", "d_staff", "staff", "staff_id", foreign={"team": "team_id"},
                  dimensions=_same("role")),
    SemanticModel("teams", "d_team", "team", "team_id", dimensions=_same("team_name function_area")),
    SemanticModel("account_snapshot", "f_account_snapshot", "account", "account_id", "snapshot_date",
                  {"member": "member_id", "product": "product_id"}, {"account_status": "status"}),
    SemanticModel("interactions", "f_interaction", "interaction", "interaction_id", "started_at",
                  {"member": "member_id", "staff": "staff_id", "team": "team_id"},
                  _same("channel direction outcome caller_type category_code hour_of_day")),
    SemanticModel("csat_surveys", "f_csat", "survey", "survey_id", "surveyed_at",
                  {"interaction": "interaction_id", "member": "member_id", "staff": "staff_id",
                   "team": "team_id"}, _same("question_code")),
    SemanticModel("transactions", "f_transaction", "transaction", "transaction_id", "posted_at",
                  {"account": "account_id", "member": "member_id", "product": "product_id"},
                  _same("txn_type status fee_type")),
    SemanticModel("rate_locks", "f_rate_lock", "rate_lock", "lock_id", "locked_at",
                  {"member": "member_id", "product": "product_id"},
                  {"lock_status": "status", "lock_period_days": "lock_period_days"}),
    SemanticModel("posted_rates", "f_rate", "product_rate", "product_rate_id", "effective_date",
                  {"product": "product_id"}, _same("rate_type is_teaser")),
)}

_SNAPSHOT_AVERAGES = ("mortgage_note_rate purchase_apr cash_advance_apr deposit_apy heloc_base_rate "
                      "heloc_margin heloc_current_rate investment_return_pct ltv_at_origination "
                      "insurance_deductible").split()
_SNAPSHOT_SUMS = ("mortgage_principal_balance banking_available_balance banking_ledger_balance "
                  "checking_ledger_balance checking_available_balance savings_balance "
                  "card_outstanding_balance card_credit_limit card_available_credit "
                  "heloc_drawn_balance heloc_credit_limit investment_market_value "
                  "investment_cash_value escrow_balance insurance_annual_premium "
                  "insurance_monthly_premium").split()

MEASURES = {m.name: m for m in (
    *(Measure(n, "account_snapshot", "average", n) for n in _SNAPSHOT_AVERAGES),
    *(Measure(n, "account_snapshot", "sum", n) for n in _SNAPSHOT_SUMS),
    Measure("note_rate_times_balance", "account_snapshot", "sum",
            "mortgage_note_rate * mortgage_principal_balance"),
    Measure("interaction_count", "interactions", "count", "1"),
    Measure("duration_seconds", "interactions", "sum", "duration_seconds"),
    Measure("escalated_calls", "interactions", "sum",
            "CASE WHEN outcome = 'escalated' THEN 1 ELSE 0 END"),
    Measure("first_contact_resolved_calls", "interactions", "sum",
            "CASE WHEN first_contact_resolved THEN 1 ELSE 0 END"),
    Measure("survey_count", "csat_surveys", "count", "1"),
    Measure("score_sum", "csat_surveys", "sum", "score"),
    Measure("score_avg", "csat_surveys", "average", "score"),
    Measure("promoters_count", "csat_surveys", "sum", "is_promoter"),
    Measure("detractors_count", "csat_surveys", "sum", "is_detractor"),
    Measure("amount", "transactions", "sum", "amount"),
    Measure("txn_count", "transactions", "count", "1"),
    Measure("fee_revenue", "transactions", "sum", "fee_revenue_amount"),
    Measure("interest_income", "transactions", "sum", "interest_earned_amount"),
    Measure("interest_expense", "transactions", "sum", "interest_paid_amount"),
    Measure("premium_paid", "transactions", "sum", "premium_paid_amount"),
    Measure("distinct_members", "transactions", "count_distinct", "member_id"),
    Measure("locks_count", "rate_locks", "count", "1"),
    Measure("lock_volume", "rate_locks", "sum", "loan_amount"),
    Measure("locks_exercised", "rate_locks", "sum", "is_exercised"),
    Measure("locks_expired", "rate_locks", "sum", "is_expired"),
    Measure("posted_rate", "posted_rates", "average", "rate_value"),
    Measure("posted_rate_count", "posted_rates", "count", "1"),
)}


def _of_line(name: str, label: str, measure: str, lob: str) -> Metric:
    return Metric(name, label, "simple", measure, ("product__lob", lob))


def _of_fee(name: str, label: str, kind: str) -> Metric:
    return Metric(name, label, "simple", "fee_revenue", ("transaction__fee_type", kind))


def _simple(name: str, label: str, measure: str) -> Metric:
    return Metric(name, label, "simple", measure)


def _ratio(name: str, label: str, numerator: str, denominator: str) -> Metric:
    return Metric(name, label, "ratio", inputs=(numerator, denominator))


def _derived(name: str, label: str, expr: str, *inputs: str) -> Metric:
    return Metric(name, label, "derived", expr=expr, inputs=inputs)


METRICS = {m.name: m for m in (
    _of_line("average_mortgage_note_rate", "Avg Mortgage Note Rate", "mortgage_note_rate", "mortgage"),
    _of_line("note_rate_times_balance", "Note Rate x Principal", "note_rate_times_balance", "mortgage"),
    _ratio("weighted_mortgage_portfolio_rate", "Weighted Mortgage Portfolio Rate",
           "note_rate_times_balance", "mortgage_principal_balance"),
    _of_line("average_heloc_current_rate", "Avg HELOC Current Rate", "heloc_current_rate", "home"),
    _of_line("average_credit_card_purchase_apr", "Avg Credit Card Purchase APR", "purchase_apr", "cards"),
    _of_line("average_credit_card_cash_advance_apr", "Avg Credit Card Cash Advance APR",
             "cash_advance_apr", "cards"),
    _of_line("average_deposit_apy", "Avg Deposit APY", "deposit_apy", "banking"),
    _of_line("average_investment_return_pct", "Avg Investment Return %", "investment_return_pct",
             "investments"),
    _of_line("banking_available_balance", "Banking Available Balance", "banking_available_balance",
             "banking"),
    _of_line("banking_ledger_balance", "Banking Ledger Balance", "banking_ledger_balance", "banking"),
    _of_line("checking_available_balance", "Checking Available Balance", "checking_available_balance",
             "banking"),
    _of_line("savings_balance", "Savings Balance", "savings_balance", "banking"),
    _of_line("credit_card_outstanding", "Credit Card Outstanding", "card_outstanding_balance", "cards"),
    _of_line("mortgage_principal_balance", "Mortgage Principal Balance", "mortgage_principal_balance",
             "mortgage"),
    _of_line("heloc_drawn_balance", "HELOC Drawn Balance", "heloc_drawn_balance", "home"),
    _of_line("investment_market_value", "Investment Market Value", "investment_market_value",
             "investments"),
    _of_line("investment_cash_value", "Investment Cash Value", "investment_cash_value", "investments"),
    _of_line("escrow_balance", "Escrow Balance", "escrow_balance", "mortgage"),
    _derived("net_member_liquidity", "Net Member Liquidity",
             "banking_available_balance - credit_card_outstanding",
             "banking_available_balance", "credit_card_outstanding"),
    _of_line("loan_to_value", "Loan to Value (LTV)", "ltv_at_origination", "mortgage"),
    _derived("member_lifetime_value", "Member Lifetime Value (LCV)",
             "relationship_revenue * 24 / active_members", "relationship_revenue", "active_members"),
    _simple("total_fee_revenue", "Total Fee Revenue", "fee_revenue"),
    _of_fee("overdraft_fee_revenue", "Overdraft Fee Revenue", "overdraft"),
    _of_fee("nsf_fee_revenue", "NSF Fee Revenue", "nsf"),
    _of_fee("monthly_maintenance_fee_revenue", "Monthly Maintenance Fee Revenue", "monthly_maintenance"),
    _of_fee("atm_fee_revenue", "ATM Fee Revenue", "atm"),
    _simple("total_interest_income", "Total Interest Income", "interest_income"),
    _derived("relationship_revenue", "Relationship Revenue", "total_fee_revenue + total_interest_income",
             "total_fee_revenue", "total_interest_income"),
    _simple("active_members", "Active Members", "distinct_members"),
    _of_line("credit_card_credit_limit", "Credit Card Credit Limit", "card_credit_limit", "cards"),
    _of_line("heloc_credit_limit", "HELOC Credit Limit", "heloc_credit_limit", "home"),
    _of_line("insurance_coverage_limit", "Insurance Coverage Limit", "insurance_deductible",
             "car_insurance"),
    _simple("call_volume", "Call Volume", "interaction_count"),
    _simple("total_duration_seconds", "Total Handle Seconds", "duration_seconds"),
    _ratio("average_handle_time", "Average Handle Time (AHT)", "total_duration_seconds", "call_volume"),
    _simple("first_contact_resolved_calls", "First Contact Resolved Calls",
            "first_contact_resolved_calls"),
    _ratio("first_contact_resolution_rate", "First Contact Resolution Rate",
           "first_contact_resolved_calls", "call_volume"),
    _simple("csat_average_score", "CSAT Average Score", "score_avg"),
    _derived("nps", "Net Promoter Score", "(promoters - detractors) / responses * 100",
             "promoters", "detractors", "responses"),
    _simple("promoters", "Promoters", "promoters_count"),
    _simple("detractors", "Detractors", "detractors_count"),
    _simple("responses", "Survey Responses", "survey_count"),
    _simple("rate_locks_count", "Rate Locks", "locks_count"),
    _simple("rate_lock_volume", "Rate Lock Volume", "lock_volume"),
    _simple("rate_locks_exercised", "Rate Locks Exercised", "locks_exercised"),
    _simple("rate_locks_expired", "Rate Locks Expired", "locks_expired"),
    _ratio("rate_lock_fallout_pct", "Rate Lock Fallout %", "rate_locks_expired", "rate_locks_count"),
)}


def require_declared(names: list[str]) -> list[str]:
    """The names, or ValueError naming the ones that are not declared."""
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"not declared: {unknown}; declared metrics: {sorted(METRICS)}")
    if not names:
        raise ValueError("at least one metric name is needed")
    return names


def model_of_entity(entity: str) -> SemanticModel | None:
    return next((m for m in MODELS.values() if m.primary == entity), None)


def leaves(name: str) -> list[str]:
    """The simple metrics a metric is computed from, in order of first use."""
    metric = METRICS[name]
    if metric.kind == "simple":
        return [name]
    return list(dict.fromkeys(leaf for i in metric.inputs for leaf in leaves(i)))


def catalogue(spark: SparkSession) -> DataFrame:
    """name, label, kind, description, and the models behind each metric."""
    rows = [(m.name, m.label, m.kind, m.description,
             ",".join(sorted({MEASURES[METRICS[x].measure].model for x in leaves(m.name)})))
            for m in METRICS.values()]
    return spark.createDataFrame(rows, "name string, label string, kind string, "
                                       "description string, models string")


def problems() -> list[str]:
    """Declaration errors: unresolved measures or inputs, filters no join path reaches."""
    from metricway.plans.compiler import find_dimension

    out = []
    for measure in MEASURES.values():
        if measure.model not in MODELS:
            out.append(f"{measure.name}: no model {measure.model}")
    for metric in METRICS.values():
        if metric.kind == "simple":
            if metric.measure not in MEASURES:
                out.append(f"{metric.name}: no measure {metric.measure}")
            elif metric.where:
                try:
                    find_dimension(MODELS[MEASURES[metric.measure].model], metric.where[0])
                except ValueError as error:
                    out.append(f"{metric.name}: {error}")
        out += [f"{metric.name}: no metric {i}" for i in metric.inputs if i not in METRICS]
    for model in MODELS.values():
        for entity in model.foreign:
            if model_of_entity(entity) is None:
                out.append(f"{model.name}: nothing has {entity} as its primary entity")
    return out


# ── reachability over entities ────────────────────────────────────────────────

def entity_links(spark: SparkSession, models: dict[str, SemanticModel] | None = None) -> DataFrame:
    """model, column, target: the many-to-one hop of each foreign entity to the model whose primary entity it is."""
    models = models or MODELS
    by_primary = {m.primary: m.name for m in models.values()}
    rows = [(m.name, column, by_primary.get(entity)) for m in models.values() for entity, column in m.foreign.items()]
    return spark.createDataFrame(rows, "model string, column string, target string")


def join_paths(spark: SparkSession, models: dict[str, SemanticModel] | None = None) -> DataFrame:
    """start, target, hops, path ARRAY: every way from a model over foreign entities, itself included, as a recursive query.

    No model is met twice on a path, so a cycle of declarations ends.
    """
    models = models or MODELS
    names = spark.createDataFrame([(n,) for n in models], "model string")
    return spark.sql("""
        WITH RECURSIVE walk(start, target, hops, path) AS (
            SELECT model, model, 0, array(model) FROM {names}
            UNION ALL
            SELECT w.start, l.target, w.hops + 1, array_append(w.path, l.target) FROM walk w JOIN {links} l ON l.model = w.target
            WHERE l.target IS NOT NULL AND NOT array_contains(w.path, l.target))
        SELECT start, target, hops, path FROM walk""", names=names, links=entity_links(spark, models).distinct())


def reachable_dimensions(spark: SparkSession, models: dict[str, SemanticModel] | None = None) -> DataFrame:
    """start, dimension (entity__name), hops: the dimensions of each model's own and reachable models by their shortest way."""
    models = models or MODELS
    own = spark.createDataFrame([(m.name, f"{m.primary}__{d}") for m in models.values() for d in m.dimensions], "target string, dimension string")
    return join_paths(spark, models).join(own, "target").groupBy("start", "dimension").agg(F.min("hops").alias("hops"))


def unreachable_filters(spark: SparkSession) -> DataFrame:
    """metric, model, dimension of simple metrics whose filter no path reaches: must be empty."""
    rows = [(m.name, MEASURES[m.measure].model, m.where[0]) for m in METRICS.values() if m.kind == "simple" and m.where]
    asked = spark.createDataFrame(rows, "metric string, model string, dimension string")
    there = reachable_dimensions(spark).select(F.col("start").alias("model"), "dimension")
    return asked.join(there, ["model", "dimension"], "left_anti").select("metric", "model", "dimension")


def path_fanout(paths: DataFrame, repeated: DataFrame) -> DataFrame:
    """start, target, hops, path (text), repeated: how many repeated keys the joins of a path meet; 0 keeps every row once.

    repeated: (model, repeated), the repeated primary keys of each model's table.
    """
    steps = paths.select("start", "target", "hops", F.array_join("path", ">").alias("path"), F.explode("path").alias("model"))
    met = steps.filter("model <> start OR hops = 0").join(repeated, "model", "left")
    return met.groupBy("start", "target", "hops", "path").agg(
        F.sum(F.when((F.col("model") != F.col("start")), F.coalesce("repeated", F.lit(0))).otherwise(0)).alias("repeated"))

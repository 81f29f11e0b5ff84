import pytest

from metricway.operators.star import Star, StoredStar
from metricway.plans import catalog
from metricway.plans.compiler import MetricQuery, checked_filters, checked_window, find_dimension
from metricway.sources.bindings import GIVEN, Tables
from registry.base import check


@pytest.fixture(scope="module")
def star(spark, sf):
    return Star(Tables(spark, sf))


def test_catalogue_is_whole():
    assert (len(catalog.METRICS), len(catalog.MEASURES), len(catalog.MODELS)) == (47, 49, 11)
    assert catalog.problems() == []
    assert not {"balance", "rate", "limit", "lcv"} & set(catalog.METRICS)


@pytest.mark.parametrize("window", [
    {"start": "April 15"}, {"start": "2026-05-27", "end": "2026-05-27"},
    {"start": "2026-05-27", "end": "2026-04-15"}, {"begin": "2026-04-15"}, "2026"])
def test_bad_windows(window):
    with pytest.raises(ValueError):
        checked_window(window)


@pytest.mark.parametrize("where", [
    {"dimension": "member__legal_name", "op": "eq", "value": "x"},
    {"dimension": "member__home_branch", "op": "gt", "value": "x"},
    {"dimension": "member__home_branch", "op": "in", "value": []},
    {"dimension": "member__home_branch", "op": "eq", "value": "a\nb"},
    {"dimension": "member__home_branch", "op": "eq", "value": "x" * 101},
    {"dimension": "member__home_branch", "op": "eq", "value": float("nan")},
    {"dimension": "member__home_branch", "op": "eq", "value": True},
    {"dimension": "member__home_branch"}])
def test_bad_filters(where):
    with pytest.raises(ValueError):
        checked_filters(where)


def test_unknown_metric_and_dimension():
    with pytest.raises(ValueError, match="not declared"):
        MetricQuery(["profit"]).compile()
    with pytest.raises(ValueError):
        find_dimension(catalog.MODELS["interactions"], "product__lob")


def test_injection_is_a_value(star):
    where = {"dimension": "member__home_branch", "op": "eq", "value": "x' OR '1'='1"}
    assert MetricQuery(["call_volume"], where=where).run(star).first().call_volume is None


@pytest.mark.parametrize("metrics, group_by, where", [
    (["call_volume", "nps"], ["interaction__category_code"], None),
    (["total_fee_revenue", "nsf_fee_revenue"], ["metric_time__year", "product__lob"], None),
    (["call_volume"], ["household__income_band"], {"dimension": "member__home_branch", "op": "eq", "value": "O'Hare"}),
    (["weighted_mortgage_portfolio_rate", "net_member_liquidity", "member_lifetime_value"], [], None)])
def test_provenance_sql_gives_the_same_numbers(spark, sf, duck, star, metrics, group_by, where):
    query = MetricQuery(metrics, group_by, {"start": "1990-01-01"}, where).compile()
    mine = query.run(star)
    cursor = duck.execute(check(query.sql))
    assert [d[0] for d in cursor.description] == mine.columns

    def same(rows):
        return sorted(tuple(str(v) if not hasattr(v, "is_signed") and not isinstance(v, float)
                            else f"{float(v):.4f}" for v in row) for row in rows)

    assert same(mine.collect()) == same(cursor.fetchall())


def test_fee_kinds_add_up(star):
    row = MetricQuery(["total_fee_revenue", "overdraft_fee_revenue", "nsf_fee_revenue",
                       "monthly_maintenance_fee_revenue", "atm_fee_revenue"]).run(star).first()
    other = star["f_transaction"].filter("fee_type = 'other'").agg({"fee_revenue_amount": "sum"}).first()[0]
    assert row.total_fee_revenue == sum(row[1:]) + other


def test_stored_star_prunes_months(spark, star, folder):
    star.write(folder, ["f_transaction", "d_product"])
    stored = StoredStar(spark, folder)
    assert stored["f_transaction"].count() == star["f_transaction"].count()
    plan = stored["f_transaction"].filter("month = '1998-01'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_columns_are_pruned_and_filters_pushed(star):
    plan = MetricQuery(["call_volume"], ["metric_time__day"], {"start": "2024-01-05"}).run(star)
    text = plan._jdf.queryExecution().toString()
    scan = [line for line in text.splitlines() if "FileScan" in line and "events.parquet" in line]
    assert scan and all("props" not in line.split("ReadSchema")[1] for line in scan)
    assert any("PushedFilters: [" in line and "ts" in line.split("PushedFilters")[1] for line in scan)


def test_given_tables_exist(spark, sf):
    tables = Tables(spark, sf)
    assert all(tables[name].columns for name in GIVEN)

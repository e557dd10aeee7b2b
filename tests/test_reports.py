"""Reports against each other: totals agree, forms agree, the cube gives what the facts give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tillwise.plans import behaviour, customer, dashboard, product, profit, retention
from tillwise.plans.cells import order_cells, roll_up

CUBE_REPORTS = [
    dashboard.monthly_revenue,
    dashboard.orders_by_status,
    dashboard.revenue_by_city,
    dashboard.top_categories,
    dashboard.weekday_hour_heatmap,
    behaviour.orders_by_hour,
    behaviour.orders_by_weekday,
    behaviour.orders_by_month,
    behaviour.device_orders,
    behaviour.gender_orders,
    behaviour.age_group_orders,
    behaviour.order_value_matrix,
    behaviour.category_behaviour,
    behaviour.spend_rating_bubbles,
    behaviour.cancel_ranking,
    behaviour.rating_distribution,
    behaviour.discount_by_age,
    behaviour.rating_by_category,
    profit.pnl_summary,
    profit.pnl_monthly,
    profit.pnl_by_category,
    retention.geo_treemap,
    product.category_matrix,
    product.category_drill_kpis,
    product.category_drill_months,
    product.category_drill_cities,
    product.shop_catalogue,
]


@pytest.fixture(scope="module")
def cells(facts):
    return order_cells(facts)


@pytest.fixture(scope="module")
def cube(cells):
    return roll_up(cells).persist()


@pytest.fixture(scope="module")
def someone(facts):
    return customer.default_customer(facts).first().customer_id


@pytest.mark.parametrize("report", CUBE_REPORTS, ids=lambda r: r.__name__)
def test_cube_gives_the_same_report(cells, cube, report):
    assert sorted(map(tuple, report(cube).collect())) == sorted(map(tuple, report(cells).collect()))


def test_statements_add_up(cells):
    whole = profit.pnl_summary(cells).first()
    for parts in (profit.pnl_monthly(cells), profit.pnl_by_category(cells)):
        sums = parts.agg(*[F.sum(c).alias(c) for c in ("revenue", "cogs", "gross_profit")]).first()
        for c in ("revenue", "cogs", "gross_profit"):
            assert sums[c] == pytest.approx(whole[c])
    assert whole.gross_profit == pytest.approx(whole.revenue - whole.cogs - whole.delivery_cost)
    assert dashboard.executive_kpis(cells).first().net_profit == whole.net_profit


def test_waterfall_totals(cells):
    summary = profit.pnl_summary(cells)
    steps = {r.label: r for r in profit.waterfall(summary).collect()}
    whole = summary.first()
    assert steps["Gross Profit"].reported_total == whole.gross_profit
    assert steps["Gross Profit"].running_total == pytest.approx(whole.gross_profit - whole.discount_cost)
    assert steps["Net Profit"].running_total == pytest.approx(whole.net_profit - whole.discount_cost)


def test_new_and_returning_are_all_orders(cells, facts):
    rows = retention.new_vs_returning(cells).collect()
    assert sum(r.orders for r in rows) == facts.count()
    new = sum(r.customers for r in rows if r.customer_type == "New")
    assert new == facts.select("customer_id").distinct().count()


def test_shares_sum_to_one(cells):
    for report in (dashboard.orders_by_status, behaviour.gender_orders, retention.geo_treemap):
        assert sum(r.share for r in report(cells).collect()) == pytest.approx(1)
    assert sum(r.share for r in profit.cost_breakdown(profit.pnl_summary(cells)).collect()) == pytest.approx(1)
    per_customer = customer.category_shares(cells).groupBy("customer_id").agg(F.sum("share").alias("s"))
    assert all(r.s == pytest.approx(1) for r in per_customer.collect())


@pytest.mark.parametrize(
    "report",
    [
        customer.home_kpis,
        customer.monthly_spend,
        customer.category_shares,
        customer.status_counts,
        customer.weekday_spend,
    ],
    ids=lambda r: r.__name__,
)
def test_one_customer_is_a_row_of_all(cells, someone, report):
    one = sorted(map(tuple, report(cells, someone).collect()))
    everyone = report(cells).where(F.col("customer_id") == someone).collect()
    assert one == sorted(map(tuple, everyone)) and one


def test_orders_of_one_customer(cells, facts, someone):
    for status in ("All", "delivered", "cancelled"):
        listed = customer.order_list(facts, someone, status).collect()
        totals = customer.order_totals(cells, someone, status).collect()
        assert len(totals) == 1 and totals[0].orders == len(listed)
        assert totals[0].total_value == pytest.approx(sum(r["Paid (₹)"] for r in listed))
        dates = [r["Date"] for r in listed]
        assert dates == sorted(dates, reverse=True)
    assert customer.order_totals(cells, -1).first().avg_order_value == 0.0


def test_profile_is_part_of_behaviour(facts, someone):
    habits = behaviour.behaviour_features(facts)
    row = customer.profile(habits, someone).first()
    assert row == customer.profile(habits).where(F.col("customer_id") == someone).first()


def test_drill_into_one_category(cells):
    for report in (product.category_drill_kpis, product.category_drill_months, product.category_drill_cities):
        one = report(cells, "PROMO").collect()
        assert one and one == report(cells).where("category = 'PROMO'").collect()


@pytest.mark.parametrize("order,column,reverse", [("Popularity", "orders", True), ("Price ↑", "avg_price", False), ("Price ↓", "avg_price", True), ("Rating", "avg_rating", True)])
def test_shop_sort_orders(cells, order, column, reverse):
    values = [r[column] for r in product.shop_catalogue(cells, sort_by=order).collect()]
    assert values == sorted(values, reverse=reverse) and len(values) == 6


def test_shop_filter_and_search(cells):
    assert [r.category for r in product.shop_catalogue(cells, category="PROMO").collect()] == ["PROMO"]
    assert {r.category for r in product.shop_catalogue(cells, search="M").collect()} == {"ECONOMY", "MEDIUM", "PROMO", "SMALL"}
    assert product.shop_catalogue(cells, search="zzz").count() == 0

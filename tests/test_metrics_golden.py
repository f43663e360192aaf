"""Metric plans on the reference's sample database, against the values
derived from its rows (FIXTURES.md)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from askwell.plans.metrics import METRICS


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def run(name, v):
    return METRICS[name].plan(v)


def test_counts(sample_views):
    v = sample_views
    assert one(run("m_customer_count", v))[0] == 10
    assert one(run("m_order_count", v))[0] == 13
    assert one(run("m_review_count", v))[0] == 8
    assert one(run("m_category_product_count", v))[0] == 6
    assert one(run("m_cheap_products", v))[0] == 6
    assert one(run("m_delivered_count", v))[0] == 7
    assert one(run("m_completed_orders", v))[0] == 10


def test_money_and_rates(sample_views):
    v = sample_views
    assert one(run("m_avg_price", v))[0] == Decimal("305.49")
    assert one(run("m_total_discount", v))[0] == Decimal("335.00")
    assert one(run("m_total_revenue", v))[0] == Decimal("9099.81")
    # exact mean 737.065 rounds half up
    assert one(run("m_avg_net_value", v))[0] == Decimal("737.07")
    assert one(run("m_fulfillment_rate", v))[0] == Decimal("58.3")
    assert one(run("m_active_customers", v))[0] == 9
    assert one(run("m_repeat_customers", v))[0] == 3
    assert one(run("m_basket_size", v))[0] == Decimal("1.6")


def test_category_revenue_and_share(sample_views):
    v = sample_views
    rev = {r["category"]: r["category_revenue"] for r in run("m_category_revenue_valid", v).collect()}
    assert rev == {"Electronics": Decimal("6099.87"), "Furniture": Decimal("2999.94")}
    share = {r["category"]: r["pct_of_total"] for r in run("m_category_share", v).collect()}
    assert share == {"Electronics": Decimal("67.0"), "Furniture": Decimal("33.0")}


def test_top_customers_by_spending(sample_views):
    rows = run("m_customer_revenue_top3", sample_views).collect()
    assert [(r["name"], r["total_spending"]) for r in rows] == [
        ("Carol Williams", Decimal("1819.97")),
        ("Jack Thomas", Decimal("1749.98")),
        ("Alice Johnson", Decimal("1419.97")),
    ]


def test_rank_keeps_ties_and_orders(sample_views):
    rows = run("m_customer_revenue_rank", sample_views).collect()
    by_name = {r["name"]: r["revenue_rank"] for r in rows}
    assert by_name["Carol Williams"] == 1 and by_name["Jack Thomas"] == 2 and by_name["Alice Johnson"] == 3
    assert sorted(by_name.values())[0] == 1


def test_monthly_valid_orders(sample_views):
    rows = run("m_monthly_valid_orders", sample_views).collect()
    assert [(r["month"], r["valid_orders"]) for r in rows] == [
        (dt.date(2025, 1, 1), 2), (dt.date(2025, 2, 1), 3), (dt.date(2025, 3, 1), 4), (dt.date(2025, 4, 1), 3)
    ]


def test_fanout_reproduced_and_fixed(sample_views):
    r = one(run("m_revenue_and_net_fanout", sample_views))
    assert (r["total_revenue"], r["total_net_value"]) == (Decimal("8349.85"), Decimal("13894.69"))
    r = one(run("m_revenue_and_net", sample_views))
    assert r["total_net_value"] == Decimal("8114.82")


def test_anti_joins(sample_views):
    assert run("m_customers_no_orders", sample_views).count() == 0
    names = [r["name"] for r in run("m_products_never_ordered", sample_views).collect()]
    assert names == ["Cable Management Kit", "Desk Lamp LED"]


def test_every_metric_runs_on_sample(sample_views):
    for name, m in METRICS.items():
        m.plan(sample_views).collect()

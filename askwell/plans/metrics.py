"""§2.13 metric catalogue: the reference's analytic SQL texts as Spark plans.

Every metric has two forms:
  * a DataFrame plan over ``Views`` (what runs on the cluster), and
  * the equivalent DuckDB SQL over the raw tables (the oracle), prefixed by
    ``ORACLE_VIEWS``.

Plan shape choices that matter at scale
  * Aggregate before joining: line items are summed per order (or per
    product) before they meet orders/products, so the big side of each join is
    already reduced and already hash-partitioned on the join key.
  * Status and date predicates go onto the raw order columns and reach the
    parquet scan (``Views.orders_where``).
  * Status-only filters on orders become LEFT SEMI joins: no order columns are
    carried through the shuffle.
  * ORDER BY .. LIMIT becomes TakeOrderedAndProject; every LIMIT has a unique
    tie-breaker so both engines return the same rows.
  * RANK over all rows uses ``global_rank`` (range partitions + offsets), not a
    single-partition window.  Share-of-total uses a scalar subquery.

Output types are fixed for both engines: counts BIGINT, money DECIMAL(38,2),
ratios DECIMAL(38,d) rounded half-up exactly (``functions.numeric``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.functions.numeric import cents, money, round_ratio, sql_round_ratio
from askwell.operators.ranking import global_rank, top_n
from askwell.sources.views import (
    CATEGORY,
    COMPLETED_STATUSES,
    COUNTRY,
    INVALID_STATUSES,
    ORACLE_VIEWS,
    PRICE_CUTOFF,
    Q1_END,
    YEAR_END,
    YEAR_START,
    Views,
)


@dataclass(frozen=True)
class Metric:
    name: str
    plan: Callable[[Views], DataFrame]
    sql: str  # DuckDB body; ORACLE_VIEWS is prepended

    @property
    def oracle(self) -> str:
        return ORACLE_VIEWS + self.sql


METRICS: dict[str, Metric] = {}


def metric(name: str, sql: str):
    def wrap(fn: Callable[[Views], DataFrame]):
        METRICS[name] = Metric(name, fn, sql)
        return fn

    return wrap


def _cnt(alias: str):
    return F.count(F.lit(1)).alias(alias)


_VALID_SQL = "o.status NOT IN ('cancelled', 'returned')"
_Y0, _Y1, _Q1 = YEAR_START.isoformat(), YEAR_END.isoformat(), Q1_END.isoformat()


# --- shared sub-plans -------------------------------------------------------


def _items_per_order(v: Views) -> DataFrame:
    """Line items reduced to one row per order (partial aggregation map-side)."""
    return v.order_items.groupBy("order_id").agg(
        F.sum("line_total").alias("rev"),
        F.sum("quantity").alias("qty"),
        _cnt("n_lines"),
    )


def _items_per_product(v: Views, orders: DataFrame) -> DataFrame:
    """Revenue and quantity per product over the line items of ``orders``."""
    items = v.order_items.join(orders.select("order_id"), "order_id", "left_semi")
    return items.groupBy("product_id").agg(
        F.sum("line_total").alias("rev"), F.sum("quantity").alias("qty")
    )


def _revenue_per_customer(v: Views) -> DataFrame:
    """Line-item revenue of valid orders, one row per customer."""
    valid = v.orders_where(exclude=INVALID_STATUSES).select("order_id", "customer_id")
    per_order = _items_per_order(v).select("order_id", "rev")
    return (
        per_order.join(valid, "order_id")
        .groupBy("customer_id")
        .agg(F.sum("rev").alias("rev"))
    )


# --- simple counts and lookups ---------------------------------------------


@metric("m_customer_count", "SELECT COUNT(*) AS customer_count FROM customers")
def m_customer_count(v: Views) -> DataFrame:
    return v.customers.agg(_cnt("customer_count"))


@metric("m_order_count", "SELECT COUNT(*) AS order_count FROM orders")
def m_order_count(v: Views) -> DataFrame:
    return v.orders.agg(_cnt("order_count"))


@metric("m_review_count", "SELECT COUNT(*) AS review_count FROM reviews")
def m_review_count(v: Views) -> DataFrame:
    return v.reviews.agg(_cnt("review_count"))


@metric(
    "m_category_product_count",
    f"SELECT COUNT(*) AS product_count FROM products WHERE category = '{CATEGORY}'",
)
def m_category_product_count(v: Views) -> DataFrame:
    return v.products.filter(F.col("category") == v.category).agg(_cnt("product_count"))


@metric(
    "m_cheap_products",
    f"SELECT COUNT(*) AS cheap_products FROM products WHERE price < {PRICE_CUTOFF}",
)
def m_cheap_products(v: Views) -> DataFrame:
    return v.products.filter(F.col("price") < v.price_cutoff).agg(_cnt("cheap_products"))


@metric(
    "m_delivered_count",
    "SELECT COUNT(*) AS delivered_count FROM orders WHERE status = 'delivered'",
)
def m_delivered_count(v: Views) -> DataFrame:
    return v.orders_where(("delivered",)).agg(_cnt("delivered_count"))


@metric(
    "m_avg_price",
    "SELECT "
    + sql_round_ratio("SUM(CAST(price * 100 AS HUGEINT))", "COUNT(price) * 100", 2)
    + " AS avg_price FROM products",
)
def m_avg_price(v: Views) -> DataFrame:
    return v.products.agg(
        round_ratio(F.sum(cents(F.col("price"))), F.count("price") * 100, 2).alias("avg_price")
    )


@metric(
    "m_total_discount",
    "SELECT CAST(SUM(discount) AS DECIMAL(38,2)) AS total_discount FROM orders",
)
def m_total_discount(v: Views) -> DataFrame:
    return v.orders.agg(money(F.sum("discount")).alias("total_discount"))


@metric(
    "m_us_customers",
    "SELECT customer_id, name, email, city, segment FROM customers "
    f"WHERE country = '{COUNTRY}' ORDER BY name, customer_id",
)
def m_us_customers(v: Views) -> DataFrame:
    return (
        v.customers.filter(F.col("country") == v.country)
        .select("customer_id", "name", "email", "city", "segment")
        .orderBy("name", "customer_id")
    )


@metric(
    "m_us_customers_brief",
    f"SELECT name, email, country FROM customers WHERE country = '{COUNTRY}' "
    "ORDER BY name, customer_id",
)
def m_us_customers_brief(v: Views) -> DataFrame:
    return (
        v.customers.filter(F.col("country") == v.country)
        .orderBy("name", "customer_id")
        .select("name", "email", "country")
    )


@metric(
    "m_cancelled_orders",
    "SELECT order_id, customer_id, order_date, total_amount FROM orders "
    "WHERE status = 'cancelled'",
)
def m_cancelled_orders(v: Views) -> DataFrame:
    return v.orders_where(("cancelled",)).select(
        "order_id", "customer_id", "order_date", "total_amount"
    )


@metric(
    "m_products_over_100",
    "SELECT product_id, name, category, price FROM products "
    f"WHERE price > {PRICE_CUTOFF} ORDER BY price DESC, product_id",
)
def m_products_over_100(v: Views) -> DataFrame:
    return (
        v.products.filter(F.col("price") > v.price_cutoff)
        .select("product_id", "name", "category", "price")
        .orderBy(F.desc("price"), "product_id")
    )


@metric("m_product_prices", "SELECT name, price FROM products ORDER BY name, product_id")
def m_product_prices(v: Views) -> DataFrame:
    return v.products.orderBy("name", "product_id").select("name", "price")


@metric("m_categories", "SELECT DISTINCT category FROM products ORDER BY category")
def m_categories(v: Views) -> DataFrame:
    return v.products.select("category").distinct().orderBy("category")


@metric(
    "m_priciest_product",
    "SELECT name, price FROM products ORDER BY price DESC, product_id LIMIT 1",
)
def m_priciest_product(v: Views) -> DataFrame:
    return top_n(v.products, [F.desc("price"), F.asc("product_id")], 1).select("name", "price")


# --- joins + aggregates ------------------------------------------------------


def _spent_not_cancelled(v: Views) -> DataFrame:
    return (
        v.orders_where(exclude=("cancelled",))
        .groupBy("customer_id")
        .agg(F.sum("total_amount").alias("spent"), _cnt("n_orders"))
    )


@metric(
    "m_top5_customers_amount",
    """SELECT c.name, c.email, CAST(SUM(o.total_amount) AS DECIMAL(38,2)) AS total_spent
FROM customers c JOIN orders o ON o.customer_id = c.customer_id
WHERE o.status != 'cancelled'
GROUP BY c.customer_id, c.name, c.email
ORDER BY total_spent DESC, c.customer_id LIMIT 5""",
)
def m_top5_customers_amount(v: Views) -> DataFrame:
    j = _spent_not_cancelled(v).join(v.customers, "customer_id")
    return top_n(j, [F.desc("spent"), F.asc("customer_id")], 5).select(
        "name", "email", money(F.col("spent")).alias("total_spent")
    )


@metric(
    "m_top5_customers_segment",
    """SELECT c.name, c.email, c.segment, CAST(SUM(o.total_amount) AS DECIMAL(38,2)) AS total_spent
FROM customers c JOIN orders o ON o.customer_id = c.customer_id
WHERE o.status != 'cancelled'
GROUP BY c.customer_id, c.name, c.email, c.segment
ORDER BY total_spent DESC, c.customer_id LIMIT 5""",
)
def m_top5_customers_segment(v: Views) -> DataFrame:
    j = _spent_not_cancelled(v).join(v.customers, "customer_id")
    return top_n(j, [F.desc("spent"), F.asc("customer_id")], 5).select(
        "name", "email", "segment", money(F.col("spent")).alias("total_spent")
    )


@metric(
    "m_category_revenue_not_cancelled",
    """SELECT p.category, CAST(SUM(oi.line_total) AS DECIMAL(38,2)) AS revenue
FROM order_items oi JOIN products p ON p.product_id = oi.product_id
JOIN orders o ON o.order_id = oi.order_id
WHERE o.status != 'cancelled'
GROUP BY p.category ORDER BY revenue DESC, p.category""",
)
def m_category_revenue_not_cancelled(v: Views) -> DataFrame:
    per_product = _items_per_product(v, v.orders_where(exclude=("cancelled",)))
    return (
        per_product.join(v.products.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(money(F.sum("rev")).alias("revenue"))
        .orderBy(F.desc("revenue"), "category")
    )


def _category_revenue_valid(v: Views) -> DataFrame:
    per_product = _items_per_product(v, v.orders_where(exclude=INVALID_STATUSES))
    return (
        per_product.join(v.products.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(money(F.sum("rev")).alias("category_revenue"))
    )


@metric(
    "m_category_revenue_valid",
    f"""SELECT p.category, CAST(SUM(oi.line_total) AS DECIMAL(38,2)) AS category_revenue
FROM order_items oi JOIN products p ON p.product_id = oi.product_id
JOIN orders o ON o.order_id = oi.order_id
WHERE {_VALID_SQL}
GROUP BY p.category ORDER BY category_revenue DESC, p.category""",
)
def m_category_revenue_valid(v: Views) -> DataFrame:
    return _category_revenue_valid(v).orderBy(F.desc("category_revenue"), "category")


@metric(
    "m_product_rating",
    """SELECT p.name, """
    + sql_round_ratio("SUM(r.rating)", "COUNT(r.rating)", 2)
    + """ AS avg_rating, COUNT(r.review_id) AS review_count
FROM products p JOIN reviews r ON r.product_id = p.product_id
GROUP BY p.product_id, p.name ORDER BY avg_rating DESC, p.product_id""",
)
def m_product_rating(v: Views) -> DataFrame:
    per_product = v.reviews.groupBy("product_id").agg(
        F.sum("rating").alias("s"), F.count("rating").alias("n"), F.count("review_id").alias("rc")
    )
    return (
        per_product.join(v.products.select("product_id", "name"), "product_id")
        .select(
            "product_id",
            "name",
            round_ratio(F.col("s"), F.col("n"), 2).alias("avg_rating"),
            F.col("rc").alias("review_count"),
        )
        .orderBy(F.desc("avg_rating"), "product_id")
        .drop("product_id")
    )


@metric(
    "m_category_rating",
    """SELECT p.category, COUNT(r.review_id) AS review_count, """
    + sql_round_ratio("SUM(r.rating)", "COUNT(r.rating)", 2)
    + """ AS avg_rating
FROM products p JOIN reviews r ON r.product_id = p.product_id
GROUP BY p.category ORDER BY avg_rating DESC, p.category""",
)
def m_category_rating(v: Views) -> DataFrame:
    per_product = v.reviews.groupBy("product_id").agg(
        F.sum("rating").alias("s"), F.count("rating").alias("n"), F.count("review_id").alias("rc")
    )
    return (
        per_product.join(v.products.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(F.sum("rc").alias("review_count"), F.sum("s").alias("s"), F.sum("n").alias("n"))
        .select(
            "category",
            "review_count",
            round_ratio(F.col("s"), F.col("n"), 2).alias("avg_rating"),
        )
        .orderBy(F.desc("avg_rating"), "category")
    )


# --- anti-joins ----------------------------------------------------------------


@metric(
    "m_customers_no_orders",
    """SELECT c.customer_id, c.name, c.email FROM customers c
LEFT JOIN orders o ON o.customer_id = c.customer_id
WHERE o.order_id IS NULL ORDER BY c.name, c.customer_id""",
)
def m_customers_no_orders(v: Views) -> DataFrame:
    return (
        v.customers.join(v.orders.select("customer_id").distinct(), "customer_id", "left_anti")
        .select("customer_id", "name", "email")
        .orderBy("name", "customer_id")
    )


@metric(
    "m_customers_no_orders_detail",
    """SELECT c.customer_id, c.name, c.email, c.city, c.segment FROM customers c
LEFT JOIN orders o ON o.customer_id = c.customer_id
WHERE o.order_id IS NULL ORDER BY c.name, c.customer_id""",
)
def m_customers_no_orders_detail(v: Views) -> DataFrame:
    return (
        v.customers.join(v.orders.select("customer_id").distinct(), "customer_id", "left_anti")
        .select("customer_id", "name", "email", "city", "segment")
        .orderBy("name", "customer_id")
    )


@metric(
    "m_customers_no_valid_orders",
    f"""SELECT c.customer_id, c.name, c.segment FROM customers c
LEFT JOIN (SELECT * FROM orders o WHERE {_VALID_SQL}) o ON o.customer_id = c.customer_id
WHERE o.order_id IS NULL ORDER BY c.name, c.customer_id""",
)
def m_customers_no_valid_orders(v: Views) -> DataFrame:
    valid = v.orders_where(exclude=INVALID_STATUSES).select("customer_id")
    return (
        v.customers.join(valid, "customer_id", "left_anti")
        .select("customer_id", "name", "segment")
        .orderBy("name", "customer_id")
    )


@metric(
    "m_products_never_ordered_id",
    """SELECT p.product_id, p.name, p.category FROM products p
LEFT JOIN order_items oi ON oi.product_id = p.product_id
WHERE oi.order_id IS NULL ORDER BY p.name, p.product_id""",
)
def m_products_never_ordered_id(v: Views) -> DataFrame:
    return (
        v.products.join(v.order_items.select("product_id").distinct(), "product_id", "left_anti")
        .select("product_id", "name", "category")
        .orderBy("name", "product_id")
    )


@metric(
    "m_products_never_ordered",
    """SELECT p.name, p.category, p.price FROM products p
LEFT JOIN order_items oi ON oi.product_id = p.product_id
WHERE oi.order_id IS NULL ORDER BY p.name, p.product_id""",
)
def m_products_never_ordered(v: Views) -> DataFrame:
    return (
        v.products.join(v.order_items.select("product_id").distinct(), "product_id", "left_anti")
        .orderBy("name", "product_id")
        .select("name", "category", "price")
    )


@metric(
    "m_products_never_bulk_ordered",
    """SELECT p.product_id, p.name, p.category FROM products p
LEFT JOIN (SELECT * FROM order_items WHERE quantity > 40) oi ON oi.product_id = p.product_id
WHERE oi.order_id IS NULL ORDER BY p.name, p.product_id""",
)
def m_products_never_bulk_ordered(v: Views) -> DataFrame:
    bulk = v.order_items.filter(F.col("quantity") > 40).select("product_id")
    return (
        v.products.join(bulk, "product_id", "left_anti")
        .select("product_id", "name", "category")
        .orderBy("name", "product_id")
    )


@metric(
    "m_orders_without_items",
    """SELECT o.order_id, o.customer_id, o.status FROM orders o
LEFT JOIN order_items oi ON oi.order_id = o.order_id
WHERE oi.order_id IS NULL ORDER BY o.order_id""",
)
def m_orders_without_items(v: Views) -> DataFrame:
    return (
        v.orders.join(v.order_items.select("order_id").distinct(), "order_id", "left_anti")
        .select("order_id", "customer_id", "status")
        .orderBy("order_id")
    )


# --- monthly series -----------------------------------------------------------



def _month():
    return F.trunc("order_date", "month").alias("month")

_MONTH_SQL = "CAST(DATE_TRUNC('month', o.order_date) AS DATE)"
_YEAR_SQL = f"o.order_date >= DATE '{_Y0}' AND o.order_date < DATE '{_Y1}'"


@metric(
    "m_monthly_amount_2025",
    f"""SELECT {_MONTH_SQL} AS month, CAST(SUM(o.total_amount) AS DECIMAL(38,2)) AS revenue
FROM orders o WHERE {_VALID_SQL} AND {_YEAR_SQL}
GROUP BY month ORDER BY month""",
)
def m_monthly_amount_2025(v: Views) -> DataFrame:
    o = v.orders_where(exclude=INVALID_STATUSES, start=v.year_start, end=v.year_end)
    return (
        o.groupBy(_month()).agg(money(F.sum("total_amount")).alias("revenue")).orderBy("month")
    )


@metric(
    "m_monthly_amount_orders",
    f"""SELECT {_MONTH_SQL} AS month, COUNT(DISTINCT o.order_id) AS order_count,
       CAST(SUM(o.total_amount) AS DECIMAL(38,2)) AS revenue
FROM orders o WHERE {_VALID_SQL} AND {_YEAR_SQL}
GROUP BY month ORDER BY month""",
)
def m_monthly_amount_orders(v: Views) -> DataFrame:
    o = v.orders_where(exclude=INVALID_STATUSES, start=v.year_start, end=v.year_end)
    return (
        o.groupBy(_month())
        .agg(
            F.countDistinct("order_id").alias("order_count"),
            money(F.sum("total_amount")).alias("revenue"),
        )
        .orderBy("month")
    )


@metric(
    "m_monthly_orders",
    f"""SELECT {_MONTH_SQL} AS month, COUNT(*) AS order_count
FROM orders o GROUP BY month ORDER BY month""",
)
def m_monthly_orders(v: Views) -> DataFrame:
    return v.orders.groupBy(_month()).agg(_cnt("order_count")).orderBy("month")


@metric(
    "m_monthly_valid_orders",
    f"""SELECT {_MONTH_SQL} AS month, COUNT(*) AS valid_orders
FROM orders o WHERE {_VALID_SQL} AND {_YEAR_SQL}
GROUP BY month ORDER BY month""",
)
def m_monthly_valid_orders(v: Views) -> DataFrame:
    o = v.orders_where(exclude=INVALID_STATUSES, start=v.year_start, end=v.year_end)
    return o.groupBy(_month()).agg(_cnt("valid_orders")).orderBy("month")


@metric(
    "m_monthly_revenue_completed",
    f"""SELECT {_MONTH_SQL} AS month, CAST(SUM(oi.line_total) AS DECIMAL(38,2)) AS monthly_revenue
FROM orders o JOIN order_items oi ON oi.order_id = o.order_id
WHERE o.status IN ('shipped', 'delivered') AND {_YEAR_SQL}
GROUP BY month ORDER BY month""",
)
def m_monthly_revenue_completed(v: Views) -> DataFrame:
    o = v.orders_where(COMPLETED_STATUSES, start=v.year_start, end=v.year_end).select(
        "order_id", _month()
    )
    return (
        _items_per_order(v)
        .join(o, "order_id")
        .groupBy("month")
        .agg(money(F.sum("rev")).alias("monthly_revenue"))
        .orderBy("month")
    )


# --- margins -------------------------------------------------------------------

_MARGIN_SQL = sql_round_ratio(
    "(CAST(p.price * 100 AS HUGEINT) - CAST(p.cost * 100 AS HUGEINT)) * 100",
    "CAST(p.price * 100 AS HUGEINT)",
    1,
)


def _margins(v: Views) -> DataFrame:
    p = v.products.filter(F.col("cost").isNotNull() & (F.col("cost") > 0))
    return p.withColumn(
        "margin_pct",
        round_ratio(
            (cents(F.col("price")) - cents(F.col("cost"))) * 100, cents(F.col("price")), 1
        ),
    )


@metric(
    "m_margin_top10",
    f"""SELECT p.name, p.category, p.price, p.cost, {_MARGIN_SQL} AS margin_pct
FROM products p WHERE p.cost IS NOT NULL AND p.cost > 0
ORDER BY margin_pct DESC, p.product_id LIMIT 10""",
)
def m_margin_top10(v: Views) -> DataFrame:
    return top_n(_margins(v), [F.desc("margin_pct"), F.asc("product_id")], 10).select(
        "name", "category", "price", "cost", "margin_pct"
    )


@metric(
    "m_margin_all",
    f"""SELECT p.name, p.price, p.cost, {_MARGIN_SQL} AS margin_pct
FROM products p WHERE p.cost IS NOT NULL AND p.cost > 0
ORDER BY margin_pct DESC, p.product_id""",
)
def m_margin_all(v: Views) -> DataFrame:
    return (
        _margins(v)
        .orderBy(F.desc("margin_pct"), "product_id")
        .select("name", "price", "cost", "margin_pct")
    )


# --- per-segment / per-country ----------------------------------------------


@metric(
    "m_aov_by_segment",
    """SELECT c.segment, """
    + sql_round_ratio("SUM(CAST(o.total_amount * 100 AS HUGEINT))", "COUNT(o.total_amount) * 100", 2)
    + """ AS avg_order_value, COUNT(o.order_id) AS order_count
FROM customers c JOIN orders o ON o.customer_id = c.customer_id
WHERE o.status != 'cancelled'
GROUP BY c.segment ORDER BY avg_order_value DESC, c.segment""",
)
def m_aov_by_segment(v: Views) -> DataFrame:
    per_customer = v.orders_where(exclude=("cancelled",)).groupBy("customer_id").agg(
        F.sum(cents(F.col("total_amount"))).alias("c"), _cnt("n")
    )
    return (
        per_customer.join(v.customers.select("customer_id", "segment"), "customer_id")
        .groupBy("segment")
        .agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
        .select(
            "segment",
            round_ratio(F.col("c"), F.col("n") * 100, 2).alias("avg_order_value"),
            F.col("n").alias("order_count"),
        )
        .orderBy(F.desc("avg_order_value"), "segment")
    )


@metric(
    "m_top3_products_qty",
    """SELECT p.name, p.category, CAST(SUM(oi.quantity) AS BIGINT) AS total_qty
FROM order_items oi JOIN products p ON p.product_id = oi.product_id
JOIN orders o ON o.order_id = oi.order_id
WHERE o.status != 'cancelled'
GROUP BY p.product_id, p.name, p.category
ORDER BY total_qty DESC, p.product_id LIMIT 3""",
)
def m_top3_products_qty(v: Views) -> DataFrame:
    per_product = _items_per_product(v, v.orders_where(exclude=("cancelled",)))
    j = per_product.join(v.products.select("product_id", "name", "category"), "product_id")
    return top_n(j, [F.desc("qty"), F.asc("product_id")], 3).select(
        "name", "category", F.col("qty").cast("bigint").alias("total_qty")
    )


@metric(
    "m_top_country_amount",
    """SELECT c.country, CAST(SUM(o.total_amount) AS DECIMAL(38,2)) AS revenue
FROM customers c JOIN orders o ON o.customer_id = c.customer_id
WHERE o.status != 'cancelled'
GROUP BY c.country ORDER BY revenue DESC, c.country LIMIT 1""",
)
def m_top_country_amount(v: Views) -> DataFrame:
    per_country = (
        _spent_not_cancelled(v)
        .join(v.customers.select("customer_id", "country"), "customer_id")
        .groupBy("country")
        .agg(money(F.sum("spent")).alias("revenue"))
    )
    return top_n(per_country, [F.desc("revenue"), F.asc("country")], 1)


@metric(
    "m_multi_order_customers",
    """SELECT c.name, c.email, COUNT(o.order_id) AS order_count
FROM customers c JOIN orders o ON o.customer_id = c.customer_id
GROUP BY c.customer_id, c.name, c.email
HAVING COUNT(o.order_id) > 1 ORDER BY order_count DESC, c.customer_id""",
)
def m_multi_order_customers(v: Views) -> DataFrame:
    per_customer = (
        v.orders.groupBy("customer_id").agg(_cnt("order_count")).filter(F.col("order_count") > 1)
    )
    return (
        per_customer.join(v.customers, "customer_id")
        .orderBy(F.desc("order_count"), "customer_id")
        .select("name", "email", "order_count")
    )


# --- business conventions (moderate set) ----------------------------------------


@metric(
    "m_total_revenue",
    f"""SELECT CAST(SUM(oi.line_total) AS DECIMAL(38,2)) AS total_revenue
FROM order_items oi JOIN orders o ON o.order_id = oi.order_id
WHERE {_VALID_SQL}""",
)
def m_total_revenue(v: Views) -> DataFrame:
    valid = v.orders_where(exclude=INVALID_STATUSES).select("order_id")
    return (
        v.order_items.join(valid, "order_id", "left_semi")
        .agg(money(F.sum("line_total")).alias("total_revenue"))
    )


@metric(
    "m_total_revenue_q1",
    f"""SELECT CAST(SUM(oi.line_total) AS DECIMAL(38,2)) AS revenue
FROM order_items oi JOIN orders o ON o.order_id = oi.order_id
WHERE {_VALID_SQL} AND o.order_date >= DATE '{_Y0}' AND o.order_date < DATE '{_Q1}'""",
)
def m_total_revenue_q1(v: Views) -> DataFrame:
    valid = v.orders_where(exclude=INVALID_STATUSES, start=v.year_start, end=v.q1_end)
    return (
        v.order_items.join(valid.select("order_id"), "order_id", "left_semi")
        .agg(money(F.sum("line_total")).alias("revenue"))
    )


@metric(
    "m_completed_orders",
    "SELECT COUNT(*) AS completed_orders FROM orders WHERE status IN ('shipped', 'delivered')",
)
def m_completed_orders(v: Views) -> DataFrame:
    return v.orders_where(COMPLETED_STATUSES).agg(_cnt("completed_orders"))


_NET_SQL = "CAST((o.total_amount - o.discount) * 100 AS HUGEINT)"


@metric(
    "m_avg_net_value",
    "SELECT "
    + sql_round_ratio(f"SUM({_NET_SQL})", "COUNT(*) * 100", 2)
    + f" AS avg_net_value FROM orders o WHERE {_VALID_SQL}",
)
def m_avg_net_value(v: Views) -> DataFrame:
    o = v.orders_where(exclude=INVALID_STATUSES)
    net = cents(F.col("total_amount") - F.col("discount"))
    return o.agg(round_ratio(F.sum(net), F.count(F.lit(1)) * 100, 2).alias("avg_net_value"))


@metric(
    "m_active_customers",
    f"""SELECT COUNT(DISTINCT c.customer_id) AS active_customers
FROM customers c JOIN orders o ON o.customer_id = c.customer_id
WHERE {_VALID_SQL}""",
)
def m_active_customers(v: Views) -> DataFrame:
    valid = v.orders_where(exclude=INVALID_STATUSES).select("customer_id")
    return (
        v.customers.select("customer_id")
        .join(valid.select("customer_id").distinct(), "customer_id", "left_semi")
        .agg(F.countDistinct("customer_id").alias("active_customers"))
    )


@metric(
    "m_active_by_segment",
    f"""SELECT c.segment, COUNT(DISTINCT c.customer_id) AS active_customers
FROM customers c JOIN orders o ON o.customer_id = c.customer_id
WHERE {_VALID_SQL}
GROUP BY c.segment ORDER BY active_customers DESC, c.segment""",
)
def m_active_by_segment(v: Views) -> DataFrame:
    valid = v.orders_where(exclude=INVALID_STATUSES).select("customer_id")
    return (
        v.customers.select("customer_id", "segment")
        .join(valid.select("customer_id").distinct(), "customer_id", "left_semi")
        .groupBy("segment")
        .agg(F.countDistinct("customer_id").alias("active_customers"))
        .orderBy(F.desc("active_customers"), "segment")
    )


def _baskets(v: Views) -> DataFrame:
    """SUM(quantity) per valid order that has line items, with its customer."""
    valid = v.orders_where(exclude=INVALID_STATUSES).select("order_id", "customer_id")
    return _items_per_order(v).select("order_id", "qty").join(valid, "order_id")


@metric(
    "m_basket_size",
    "SELECT "
    + sql_round_ratio("SUM(item_count)", "COUNT(item_count)", 1)
    + f""" AS avg_basket_size FROM (
    SELECT o.order_id, SUM(oi.quantity) AS item_count
    FROM orders o JOIN order_items oi ON oi.order_id = o.order_id
    WHERE {_VALID_SQL} GROUP BY o.order_id) sub""",
)
def m_basket_size(v: Views) -> DataFrame:
    return _baskets(v).agg(
        round_ratio(F.sum("qty"), F.count("qty"), 1).alias("avg_basket_size")
    )


@metric(
    "m_basket_size_by_segment",
    "SELECT c.segment, "
    + sql_round_ratio("SUM(sub.item_count)", "COUNT(sub.item_count)", 1)
    + f""" AS avg_basket_size FROM (
    SELECT o.order_id, o.customer_id, SUM(oi.quantity) AS item_count
    FROM orders o JOIN order_items oi ON oi.order_id = o.order_id
    WHERE {_VALID_SQL} GROUP BY o.order_id, o.customer_id) sub
JOIN customers c ON c.customer_id = sub.customer_id
GROUP BY c.segment ORDER BY avg_basket_size DESC, c.segment""",
)
def m_basket_size_by_segment(v: Views) -> DataFrame:
    per_customer = _baskets(v).groupBy("customer_id").agg(
        F.sum("qty").alias("q"), _cnt("n")
    )
    return (
        per_customer.join(v.customers.select("customer_id", "segment"), "customer_id")
        .groupBy("segment")
        .agg(F.sum("q").alias("q"), F.sum("n").alias("n"))
        .select("segment", round_ratio(F.col("q"), F.col("n"), 1).alias("avg_basket_size"))
        .orderBy(F.desc("avg_basket_size"), "segment")
    )


@metric(
    "m_repeat_customers",
    f"""SELECT COUNT(*) AS repeat_customers FROM (
    SELECT c.customer_id FROM customers c JOIN orders o ON o.customer_id = c.customer_id
    WHERE {_VALID_SQL} GROUP BY c.customer_id HAVING COUNT(o.order_id) > 1) sub""",
)
def m_repeat_customers(v: Views) -> DataFrame:
    per_customer = (
        v.orders_where(exclude=INVALID_STATUSES)
        .groupBy("customer_id")
        .agg(_cnt("n"))
        .filter(F.col("n") > 1)
    )
    return (
        per_customer.join(v.customers.select("customer_id"), "customer_id", "left_semi")
        .agg(_cnt("repeat_customers"))
    )


_CUST_REV_SQL = f"""FROM customers c JOIN orders o ON o.customer_id = c.customer_id
JOIN order_items oi ON oi.order_id = o.order_id
WHERE {_VALID_SQL}"""


@metric(
    "m_customer_revenue_top3",
    f"""SELECT c.name, CAST(SUM(oi.line_total) AS DECIMAL(38,2)) AS total_spending
{_CUST_REV_SQL}
GROUP BY c.customer_id, c.name ORDER BY total_spending DESC, c.customer_id LIMIT 3""",
)
def m_customer_revenue_top3(v: Views) -> DataFrame:
    j = _revenue_per_customer(v).join(v.customers.select("customer_id", "name"), "customer_id")
    return top_n(j, [F.desc("rev"), F.asc("customer_id")], 3).select(
        "name", money(F.col("rev")).alias("total_spending")
    )


@metric(
    "m_customer_revenue_all",
    f"""SELECT c.name, c.segment, CAST(SUM(oi.line_total) AS DECIMAL(38,2)) AS total_revenue
{_CUST_REV_SQL}
GROUP BY c.customer_id, c.name, c.segment ORDER BY total_revenue DESC, c.customer_id""",
)
def m_customer_revenue_all(v: Views) -> DataFrame:
    j = _revenue_per_customer(v).join(
        v.customers.select("customer_id", "name", "segment"), "customer_id"
    )
    return j.orderBy(F.desc("rev"), "customer_id").select(
        "name", "segment", money(F.col("rev")).alias("total_revenue")
    )


@metric(
    "m_customer_revenue_rank",
    f"""SELECT c.name, c.segment, CAST(SUM(oi.line_total) AS DECIMAL(38,2)) AS total_revenue,
       CAST(RANK() OVER (ORDER BY SUM(oi.line_total) DESC) AS BIGINT) AS revenue_rank
{_CUST_REV_SQL}
GROUP BY c.customer_id, c.name, c.segment ORDER BY total_revenue DESC, c.customer_id""",
)
def m_customer_revenue_rank(v: Views) -> DataFrame:
    j = _revenue_per_customer(v).join(
        v.customers.select("customer_id", "name", "segment"), "customer_id"
    )
    ranked = global_rank(j, [F.desc("rev")], "revenue_rank")
    return ranked.select(
        "name", "segment", money(F.col("rev")).alias("total_revenue"), "revenue_rank"
    )


@metric(
    "m_fulfillment_rate",
    "SELECT "
    + sql_round_ratio(
        "COUNT(*) FILTER (WHERE status = 'delivered') * 100",
        "COUNT(*) FILTER (WHERE status != 'cancelled')",
        1,
    )
    + " AS fulfillment_rate_pct FROM orders",
)
def m_fulfillment_rate(v: Views) -> DataFrame:
    s = F.col("status")
    return v.orders.agg(
        round_ratio(
            F.count(F.when(s == "delivered", 1)) * 100, F.count(F.when(s != "cancelled", 1)), 1
        ).alias("fulfillment_rate_pct")
    )


@metric(
    "m_revenue_and_net_fanout",
    """SELECT CAST(SUM(oi.line_total) AS DECIMAL(38,2)) AS total_revenue,
       CAST(SUM(o.total_amount - o.discount) AS DECIMAL(38,2)) AS total_net_value
FROM orders o JOIN order_items oi ON oi.order_id = o.order_id
WHERE o.status IN ('shipped', 'delivered')""",
)
def m_revenue_and_net_fanout(v: Views) -> DataFrame:
    """The reference's text sums order-level amounts once per line item (D16);
    reproduced as net * number of lines after a per-order pre-aggregation."""
    done = v.orders_where(COMPLETED_STATUSES)
    j = _items_per_order(v).join(done, "order_id")
    return j.agg(
        money(F.sum("rev")).alias("total_revenue"),
        money(F.sum((F.col("total_amount") - F.col("discount")) * F.col("n_lines"))).alias(
            "total_net_value"
        ),
    )


@metric(
    "m_revenue_and_net",
    """SELECT CAST(SUM(sub.rev) AS DECIMAL(38,2)) AS total_revenue,
       CAST(SUM(o.total_amount - o.discount) AS DECIMAL(38,2)) AS total_net_value
FROM orders o JOIN (SELECT order_id, SUM(line_total) AS rev FROM order_items GROUP BY order_id) sub
  ON sub.order_id = o.order_id
WHERE o.status IN ('shipped', 'delivered')""",
)
def m_revenue_and_net(v: Views) -> DataFrame:
    done = v.orders_where(COMPLETED_STATUSES)
    j = _items_per_order(v).join(done, "order_id")
    return j.agg(
        money(F.sum("rev")).alias("total_revenue"),
        money(F.sum(F.col("total_amount") - F.col("discount"))).alias("total_net_value"),
    )


@metric(
    "m_category_share",
    "SELECT p.category, CAST(SUM(oi.line_total) AS DECIMAL(38,2)) AS category_revenue, "
    + sql_round_ratio(
        "SUM(CAST(oi.line_total * 100 AS HUGEINT)) * 100",
        "SUM(SUM(CAST(oi.line_total * 100 AS HUGEINT))) OVER ()",
        1,
    )
    + f""" AS pct_of_total
FROM order_items oi JOIN products p ON p.product_id = oi.product_id
JOIN orders o ON o.order_id = oi.order_id
WHERE {_VALID_SQL}
GROUP BY p.category ORDER BY category_revenue DESC, p.category""",
)
def m_category_share(v: Views) -> DataFrame:
    per_category = _category_revenue_valid(v)
    # total as a scalar subquery over the (small) aggregated rows — no
    # single-partition window, no cross join
    total = per_category.agg(F.sum(cents(F.col("category_revenue")))).scalar()
    return per_category.select(
        "category",
        "category_revenue",
        round_ratio(cents(F.col("category_revenue")) * 100, total, 1).alias("pct_of_total"),
    ).orderBy(F.desc("category_revenue"), "category")


@metric(
    "m_net_value_by_country",
    "SELECT c.country, "
    + sql_round_ratio(f"SUM({_NET_SQL})", "COUNT(*) * 100", 2)
    + f""" AS avg_net_value
FROM orders o JOIN customers c ON c.customer_id = o.customer_id
WHERE {_VALID_SQL}
GROUP BY c.country ORDER BY avg_net_value DESC, c.country""",
)
def m_net_value_by_country(v: Views) -> DataFrame:
    per_customer = (
        v.orders_where(exclude=INVALID_STATUSES)
        .groupBy("customer_id")
        .agg(F.sum(cents(F.col("total_amount") - F.col("discount"))).alias("c"), _cnt("n"))
    )
    return (
        per_customer.join(v.customers.select("customer_id", "country"), "customer_id")
        .groupBy("country")
        .agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
        .select("country", round_ratio(F.col("c"), F.col("n") * 100, 2).alias("avg_net_value"))
        .orderBy(F.desc("avg_net_value"), "country")
    )


@metric(
    "m_valid_rate_per_customer",
    f"""SELECT c.name, COUNT(*) AS total_orders,
       COUNT(*) FILTER (WHERE {_VALID_SQL}) AS valid_orders, """
    + sql_round_ratio(f"COUNT(*) FILTER (WHERE {_VALID_SQL}) * 100", "COUNT(*)", 1)
    + """ AS valid_rate_pct
FROM customers c JOIN orders o ON o.customer_id = c.customer_id
GROUP BY c.customer_id, c.name ORDER BY valid_rate_pct ASC, c.customer_id""",
)
def m_valid_rate_per_customer(v: Views) -> DataFrame:
    is_valid = ~F.col("status").isin(*INVALID_STATUSES)
    per_customer = v.orders.groupBy("customer_id").agg(
        _cnt("total_orders"), F.count(F.when(is_valid, 1)).alias("valid_orders")
    )
    return (
        per_customer.join(v.customers.select("customer_id", "name"), "customer_id")
        .select(
            "customer_id",
            "name",
            "total_orders",
            "valid_orders",
            round_ratio(F.col("valid_orders") * 100, F.col("total_orders"), 1).alias(
                "valid_rate_pct"
            ),
        )
        .orderBy("valid_rate_pct", "customer_id")
        .drop("customer_id")
    )

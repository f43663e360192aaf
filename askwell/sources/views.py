"""S5 business_views: the e-commerce shape the metric SQL texts read.

The driver tables are TPC-H-like; the metric catalogue speaks of customers,
products, orders, order_items and reviews.  The adapter below is defined once
as DataFrame expressions and once as DuckDB SQL (``ORACLE_VIEWS``) with the
same arithmetic, so both engines see identical rows.

Scale notes
  * nation (25 rows) and region (5 rows) are fixed-size TPC-H dimensions, so
    broadcasting them is bounded regardless of scale factor.
  * Money is cast to DECIMAL before any SUM: double sums are order-dependent.
  * Date-range filters are applied to the raw ``o_orderdate`` column so the
    predicate reaches the parquet scan (a filter on ``cast(.. as date)`` is
    not pushed down).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwell.sources.tables import Tables

# ---------------------------------------------------------------------------
# The reference's literals mapped onto the driver tables.
#   year 2025 (2025-01-01 .. 2026-01-01)  -> 2000 (2000-01-01 .. 2001-01-01)
#   Q1 2025 end 2025-04-01                -> 2000-04-01
#   country 'US'                          -> 'AMERICA' (r_name)
#   category 'Electronics'                -> 'STANDARD' (p_type)
#   price threshold 100                   -> 950 (prices run 900..1000)
#   valid order     = status NOT IN ('cancelled', 'returned')
#   completed order = status IN ('shipped', 'delivered')
# Order status from (o_orderstatus, o_orderpriority):
#   P and 5-LOW -> cancelled; F and 4-NOT SPECIFIED -> returned;
#   F -> delivered; O -> shipped; P -> pending
# Discount: 5 % of the total for priority 2-HIGH, else 0.
# ---------------------------------------------------------------------------
YEAR_START = dt.date(2000, 1, 1)
YEAR_END = dt.date(2001, 1, 1)
Q1_END = dt.date(2000, 4, 1)
COUNTRY = "AMERICA"
CATEGORY = "STANDARD"
PRICE_CUTOFF = 950
INVALID_STATUSES = ("cancelled", "returned")
COMPLETED_STATUSES = ("shipped", "delivered")


ALL_STATUSES = ("pending", "shipped", "delivered", "cancelled", "returned")



def _raw_status(name: str) -> Column:
    """status -> predicate on the raw columns (same rules as _status below)."""
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return {
        "cancelled": (s == "P") & (p == "5-LOW"),
        "returned": (s == "F") & (p == "4-NOT SPECIFIED"),
        "delivered": (s == "F") & (p != "4-NOT SPECIFIED"),
        "shipped": s == "O",
        "pending": (s == "P") & (p != "5-LOW"),
    }[name]


def _status(status: Column, priority: Column) -> Column:
    return (
        F.when((status == "P") & (priority == "5-LOW"), "cancelled")
        .when((status == "F") & (priority == "4-NOT SPECIFIED"), "returned")
        .when(status == "F", "delivered")
        .when(status == "O", "shipped")
        .when(status == "P", "pending")
    )


class Views:
    """The five business views over one scale-factor folder."""

    # literals the metric plans use (see "Fixed values" above)
    year_start, year_end, q1_end = YEAR_START, YEAR_END, Q1_END
    country, category, price_cutoff = COUNTRY, CATEGORY, PRICE_CUTOFF

    def __init__(self, tables: Tables):
        self.t = tables

    # -- customers ---------------------------------------------------------
    @property
    def customers(self) -> DataFrame:
        geo = F.broadcast(
            self.t.nation.join(
                F.broadcast(self.t.region), F.col("n_regionkey") == F.col("r_regionkey")
            ).select("n_nationkey", "n_name", "r_name")
        )
        return self.t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("country"),
            F.col("c_mktsegment").alias("segment"),
        )

    # -- products ----------------------------------------------------------
    @property
    def products(self) -> DataFrame:
        price = F.col("p_retailprice").cast("decimal(10,2)")
        cost = F.round(
            price
            * (F.lit(100) - F.col("p_size")).cast("decimal(5,0)")
            * F.lit(0.01).cast("decimal(3,2)"),
            2,
        ).cast("decimal(10,2)")
        return self.t.part.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("subcategory"),
            price.alias("price"),
            cost.alias("cost"),
        )

    # -- orders ------------------------------------------------------------
    def orders_in(
        self,
        start: dt.date | None = None,
        end: dt.date | None = None,
        raw_filter: Column | None = None,
    ) -> DataFrame:
        """Orders, optionally restricted to ``start <= order_date < end``.

        The bound is applied to the raw timestamp column so it is pushed into
        the parquet scan; ``cast(ts as date) >= d`` is equivalent to
        ``ts >= d 00:00`` for a zone-less timestamp.
        """
        o = self.t.orders
        if raw_filter is not None:
            o = o.filter(raw_filter)
        if start is not None:
            o = o.filter(F.col("o_orderdate") >= F.lit(dt.datetime.combine(start, dt.time())))
        if end is not None:
            o = o.filter(F.col("o_orderdate") < F.lit(dt.datetime.combine(end, dt.time())))
        total = F.col("o_totalprice").cast("decimal(18,2)")
        discount = F.when(
            F.col("o_orderpriority") == "2-HIGH",
            F.round(total * F.lit(0.05).cast("decimal(4,2)"), 2).cast("decimal(18,2)"),
        ).otherwise(F.lit(0).cast("decimal(18,2)"))
        return o.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            _status(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("status"),
            total.alias("total_amount"),
            discount.alias("discount"),
        )

    @property
    def orders(self) -> DataFrame:
        return self.orders_in()

    def orders_where(
        self,
        statuses: tuple[str, ...] | None = None,
        exclude: tuple[str, ...] = (),
        start: dt.date | None = None,
        end: dt.date | None = None,
    ) -> DataFrame:
        """Orders whose status is in ``statuses`` (all if None) and not in
        ``exclude``.  The status test is rewritten onto the raw columns
        (``o_orderstatus``, ``o_orderpriority``) so it is pushed into the
        parquet scan instead of running after the CASE projection."""
        wanted = [s for s in (statuses or ALL_STATUSES) if s not in exclude]
        if set(wanted) == set(ALL_STATUSES):
            return self.orders_in(start, end)
        raw = _raw_status(wanted[0])
        for s in wanted[1:]:
            raw = raw | _raw_status(s)
        return self.orders_in(start, end, raw)

    # -- order_items -------------------------------------------------------
    @property
    def order_items(self) -> DataFrame:
        """quantity * unit_price is carried as ``line_total`` (exact cents)."""
        return self.t.lineitem.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("line_total"),
        )

    # -- reviews -----------------------------------------------------------
    @property
    def reviews(self) -> DataFrame:
        """A review is a 'view' event: product = event_id mod |part|,
        rating = 1 + k mod 5 with k from the event's JSON props."""
        n_parts = self.t.part.select(F.count(F.lit(1))).scalar()
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.t.events.filter(F.col("event_type") == "view").select(
            F.col("event_id").alias("review_id"),
            (F.col("event_id") % n_parts).alias("product_id"),
            F.col("user_id").alias("customer_id"),
            (F.lit(1) + k % 5).cast("int").alias("rating"),
        )


# DuckDB form of the same views; prefixed to every metric oracle as CTEs.
ORACLE_VIEWS = """WITH customers AS (
  SELECT c.c_custkey AS customer_id, c.c_name AS name,
         lower(c.c_name) || '@example.com' AS email,
         n.n_name AS city, r.r_name AS country, c.c_mktsegment AS segment
  FROM customer c
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
), products AS (
  SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_brand AS subcategory,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price,
         CAST(ROUND(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(100 - p_size AS DECIMAL(5,0))
                    * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(10,2)) AS cost
  FROM part
), orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CAST(o_orderdate AS DATE) AS order_date,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'cancelled'
              WHEN o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'returned'
              WHEN o_orderstatus = 'F' THEN 'delivered'
              WHEN o_orderstatus = 'O' THEN 'shipped'
              WHEN o_orderstatus = 'P' THEN 'pending' END AS status,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
         CASE WHEN o_orderpriority = '2-HIGH'
              THEN CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.05 AS DECIMAL(4,2)), 2)
                        AS DECIMAL(18,2))
              ELSE CAST(0 AS DECIMAL(18,2)) END AS discount
  FROM orders
), order_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id,
         CAST(l_quantity AS BIGINT) AS quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total
  FROM lineitem
), reviews AS (
  SELECT event_id AS review_id,
         event_id % (SELECT COUNT(*) FROM part) AS product_id,
         user_id AS customer_id,
         CAST(1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS INTEGER) AS rating
  FROM events WHERE event_type = 'view'
)
"""


# Column types of the five views (Spark simpleString), for DDL text that is
# needed without a session (oracle SQL); a test checks them against the views.
VIEW_FIELDS: dict[str, list[tuple[str, str]]] = {
    "customers": [("customer_id", "bigint"), ("name", "string"), ("email", "string"),
                  ("city", "string"), ("country", "string"), ("segment", "string")],
    "products": [("product_id", "bigint"), ("name", "string"), ("category", "string"),
                 ("subcategory", "string"), ("price", "decimal(10,2)"), ("cost", "decimal(10,2)")],
    "orders": [("order_id", "bigint"), ("customer_id", "bigint"), ("order_date", "date"),
               ("status", "string"), ("total_amount", "decimal(18,2)"), ("discount", "decimal(18,2)")],
    "order_items": [("order_id", "bigint"), ("product_id", "bigint"), ("quantity", "bigint"),
                    ("line_total", "decimal(18,2)")],
    "reviews": [("review_id", "bigint"), ("product_id", "bigint"), ("customer_id", "bigint"),
                ("rating", "int")],
}


class FrameViews:
    """The same interface over e-commerce tables given as DataFrames (for
    example the reference's sample database), with the reference's own
    literals.  ``order_items`` needs quantity and unit_price; line_total is
    derived."""

    year_start, year_end, q1_end = dt.date(2025, 1, 1), dt.date(2026, 1, 1), dt.date(2025, 4, 1)
    country, category, price_cutoff = "US", "Electronics", 100

    def __init__(self, customers: DataFrame, products: DataFrame, orders: DataFrame,
                 order_items: DataFrame, reviews: DataFrame):
        self.customers = customers
        self.products = products
        self._orders = orders
        self.order_items = order_items.withColumn(
            "line_total", (F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)")
        )
        self.reviews = reviews

    def orders_in(self, start=None, end=None, raw_filter=None) -> DataFrame:
        o = self._orders
        if start is not None:
            o = o.filter(F.col("order_date") >= F.lit(start))
        if end is not None:
            o = o.filter(F.col("order_date") < F.lit(end))
        return o

    @property
    def orders(self) -> DataFrame:
        return self._orders

    def orders_where(self, statuses=None, exclude=(), start=None, end=None) -> DataFrame:
        wanted = [s for s in (statuses or ALL_STATUSES) if s not in exclude]
        return self.orders_in(start, end).filter(F.col("status").isin(*wanted))

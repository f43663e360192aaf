from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from askwell.session import build_session

    s = build_session("local[4]", shuffle_partitions=4, app_name="askwell-tests")
    yield s
    s.stop()


# The reference's sample database (10 customers, 10 products, 13 orders,
# 20 items, 8 reviews) — fixed values used for golden tests.
_CUSTOMERS = [
    (1, "Alice Johnson", "alice@example.com", "New York", "US", "consumer"),
    (2, "Bob Smith", "bob@example.com", "London", "UK", "corporate"),
    (3, "Carol Williams", "carol@example.com", "San Francisco", "US", "enterprise"),
    (4, "David Brown", "david@example.com", "Toronto", "CA", "consumer"),
    (5, "Eve Davis", "eve@example.com", "Berlin", "DE", "corporate"),
    (6, "Frank Miller", "frank@example.com", "New York", "US", "enterprise"),
    (7, "Grace Wilson", "grace@example.com", "Sydney", "AU", "consumer"),
    (8, "Henry Taylor", "henry@example.com", "London", "UK", "consumer"),
    (9, "Ivy Anderson", "ivy@example.com", "Chicago", "US", "corporate"),
    (10, "Jack Thomas", "jack@example.com", "Vancouver", "CA", "enterprise"),
]
_PRODUCTS = [
    (1, "Laptop Pro 15", "Electronics", "Laptops", "1299.99", "900.00"),
    (2, "Wireless Mouse", "Electronics", "Accessories", "29.99", "12.00"),
    (3, "USB-C Hub", "Electronics", "Accessories", "49.99", "22.00"),
    (4, "Standing Desk", "Furniture", "Desks", "599.99", "350.00"),
    (5, "Ergonomic Chair", "Furniture", "Chairs", "449.99", "280.00"),
    (6, 'Monitor 27"', "Electronics", "Monitors", "399.99", "250.00"),
    (7, "Keyboard Mechanical", "Electronics", "Accessories", "89.99", "45.00"),
    (8, "Webcam HD", "Electronics", "Accessories", "69.99", "30.00"),
    (9, "Desk Lamp LED", "Furniture", "Lighting", "39.99", "18.00"),
    (10, "Cable Management Kit", "Furniture", "Accessories", "24.99", "10.00"),
]
_ORDERS = [
    (1, 1, "2025-01-15", "delivered", "1329.98", "0"),
    (2, 2, "2025-01-20", "delivered", "599.99", "50.00"),
    (3, 3, "2025-02-01", "shipped", "1749.97", "0"),
    (4, 1, "2025-02-10", "delivered", "89.99", "0"),
    (5, 4, "2025-02-14", "delivered", "449.99", "25.00"),
    (6, 5, "2025-03-01", "pending", "129.97", "0"),
    (7, 6, "2025-03-05", "shipped", "1299.99", "100.00"),
    (8, 7, "2025-03-10", "cancelled", "399.99", "0"),
    (9, 2, "2025-03-15", "delivered", "159.97", "10.00"),
    (10, 8, "2025-03-20", "pending", "599.99", "0"),
    (11, 3, "2025-04-01", "delivered", "69.99", "0"),
    (12, 9, "2025-04-05", "shipped", "949.98", "0"),
    (13, 10, "2025-04-10", "delivered", "1749.97", "150.00"),
]
_ITEMS = [
    (1, 1, 1, "1299.99"), (1, 2, 1, "29.99"), (2, 4, 1, "599.99"), (3, 1, 1, "1299.99"),
    (3, 5, 1, "449.99"), (4, 7, 1, "89.99"), (5, 5, 1, "449.99"), (6, 2, 1, "29.99"),
    (6, 3, 1, "49.99"), (6, 8, 1, "69.99"), (7, 1, 1, "1299.99"), (8, 6, 1, "399.99"),
    (9, 7, 1, "89.99"), (9, 8, 1, "69.99"), (10, 4, 1, "599.99"), (11, 8, 1, "69.99"),
    (12, 6, 1, "399.99"), (12, 5, 1, "449.99"), (13, 1, 1, "1299.99"), (13, 5, 1, "449.99"),
]
_REVIEWS = [(1, 1, 1, 5), (2, 1, 3, 4), (3, 4, 2, 5), (4, 5, 5, 4), (5, 2, 1, 3), (6, 6, 8, 5), (7, 7, 4, 4), (8, 5, 3, 5)]


@pytest.fixture(scope="session")
def sample_views(spark):
    from askwell.sources.views import FrameViews

    c = spark.createDataFrame(_CUSTOMERS, "customer_id long, name string, email string, city string, country string, segment string")
    p = spark.createDataFrame(
        [(a, b, cat, s, Decimal(pr), Decimal(co)) for a, b, cat, s, pr, co in _PRODUCTS],
        "product_id long, name string, category string, subcategory string, price decimal(10,2), cost decimal(10,2)",
    )
    o = spark.createDataFrame(
        [(a, b, dt.date.fromisoformat(d), s, Decimal(t), Decimal(x)) for a, b, d, s, t, x in _ORDERS],
        "order_id long, customer_id long, order_date date, status string, total_amount decimal(12,2), discount decimal(5,2)",
    )
    i = spark.createDataFrame(
        [(a, b, q, Decimal(u)) for a, b, q, u in _ITEMS],
        "order_id long, product_id long, quantity long, unit_price decimal(10,2)",
    )
    r = spark.createDataFrame(_REVIEWS, "review_id long, product_id long, customer_id long, rating int")
    return FrameViews(c, p, o, i, r)

"""The declared 23-column sales schema (fixed up front, never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order of the reference's sales table.
SALES_COLUMNS = (
    "row_id",
    "order_id",
    "order_date",
    "ship_date",
    "ship_mode",
    "customer_id",
    "customer_name",
    "segment",
    "city",
    "state",
    "country",
    "market",
    "region",
    "product_id",
    "category",
    "subcategory",
    "product_name",
    "sales",
    "quantity",
    "discount",
    "profit",
    "shipping_cost",
    "order_priority",
)

# Declared character limits of the text columns (NVARCHAR(n) in the source).
TEXT_LIMITS = {
    "order_id": 70,
    "ship_mode": 30,
    "customer_id": 30,
    "customer_name": 70,
    "segment": 30,
    "city": 100,
    "state": 100,
    "country": 100,
    "market": 30,
    "region": 30,
    "product_id": 100,
    "category": 30,
    "subcategory": 30,
    "product_name": 255,
    "order_priority": 30,
}

# Value ranges of the numeric columns whose source type is narrower than the
# Spark type holding them. quantity is an unsigned byte (0..255) in the source;
# Spark's tinyint is signed, so it is held as smallint and range-checked.
NUMERIC_RANGES = {"quantity": (0, 255)}


def sales_schema(row_id_type: T.DataType | None = None) -> T.StructType:
    """All 23 columns, all nullable, no key (the source declares none)."""
    text = T.StringType()
    money = T.DecimalType(10, 2)
    types = {
        "row_id": row_id_type or T.IntegerType(),
        "order_date": T.DateType(),
        "ship_date": T.DateType(),
        "sales": money,
        "quantity": T.ShortType(),
        "discount": T.DecimalType(5, 3),
        "profit": money,
        "shipping_cost": money,
    }
    return T.StructType([T.StructField(c, types.get(c, text), True) for c in SALES_COLUMNS])

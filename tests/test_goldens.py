"""FIXTURES.md section 2.3 goldens at sf0.01, through the registered queries."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def q():
    return queries()


def test_hierarchy_goldens(spark, q):
    assert tuple(q["hierarchy_check_market_country"](spark, SF).first())[:2] == (25, 27)
    assert tuple(q["hierarchy_check_market_country_corrected"](spark, SF).first())[:2] == (25, 25)
    assert tuple(q["hierarchy_check_subcategory_product"](spark, SF).first())[:2] == (64, 382)
    assert tuple(q["hierarchy_check_subcategory_product_corrected"](spark, SF).first())[:2] == (64, 377)
    assert tuple(q["hierarchy_check_category_subcategory"](spark, SF).first())[:2] == (6, 6)


def test_correction_and_row_goldens(spark, q):
    assert q["market_correction_map"](spark, SF).count() == 800
    assert q["subcategory_correction_map"](spark, SF).count() == 1101
    assert q["duplicate_rows"](spark, SF).count() == 0
    fact = q["sales_dirty"](spark, SF)
    assert fact.count() == 60000 and fact.select("row_id").distinct().count() == 45832
    rep = q["reporting_fact"](spark, SF)
    assert rep.filter(F.col("Shipping Days").isNull()).count() == 29157
    assert rep.filter("`Discount Applied` = 1").count() == 57059
    assert q["negative_profit_rows"](spark, SF).count() == 13999
    assert q["date_dimension"](spark, SF).count() == 2405


def test_market_performance_golden(spark, q):
    got = {r.market: (r.revenue, r.order_count) for r in q["market_performance"](spark, SF).collect()}
    assert got == {
        "ASIA": (Decimal("655044390.79"), 12367),
        "EUROPE": (Decimal("650243721.12"), 12176),
        "AMERICA": (Decimal("638350598.89"), 12102),
        "AFRICA": (Decimal("619843420.42"), 11672),
        "MIDDLE EAST": (Decimal("619774140.41"), 11683),
    }

"""Business literals, as parameter defaults.

Fixed values: the reference's own literals. They must stay exactly as written
for an operator run with defaults to give the reference's results.
"""

from __future__ import annotations

# ---- Fixed values (reference literals, natural order) ----------------------
REFERENCE_CORE_MARKETS = ("APAC", "EU", "US", "LATAM")
REFERENCE_SEGMENT_YEARS = (2013, 2014)
REFERENCE_EXCLUDED_SEGMENT = "Home Office"
# (wrong market, country, correct market)
REFERENCE_MARKET_RULES = (("EMEA", "Austria", "EU"), ("EMEA", "Mongolia", "APAC"))
# (product name, correct subcategory, correct category)
REFERENCE_PRODUCT_RULE = ("Staples", "Fasteners", "Office Supplies")
REFERENCE_RANGE_COLUMNS = ("sales", "quantity", "discount", "profit", "shipping_cost")
REFERENCE_EXCLUDED_FIELDS = ("region", "customer_name", "product_id", "profit")
REFERENCE_SNAPSHOT_COLUMNS = (
    "market",
    "country",
    "sales",
    "discount",
    "category",
    "ship_mode",
    "order_date",
    "ship_date",
    "shipping_cost",
    "segment",
)
REFERENCE_MULTI_MARKET_COUNTRIES = ("Austria", "Mongolia")
# ----------------------------------------------------------------------------

# Stand-ins for the reference literals on the driver's test tables
# (see FIXTURES.md section 2.1). Values present in those tables.
FIXTURE_CORE_MARKETS = ("ASIA", "EUROPE", "AMERICA", "AFRICA")
FIXTURE_SEGMENT_YEARS = (1999, 2000)
FIXTURE_EXCLUDED_SEGMENT = "HOUSEHOLD"
FIXTURE_MARKET_RULES = (("MIDDLE EAST", "NATION_3", "EUROPE"), ("MIDDLE EAST", "NATION_2", "ASIA"))
FIXTURE_PRODUCT_RULE = ("red plate", "STANDARD", "CORE")
FIXTURE_MULTI_MARKET_COUNTRIES = ("NATION_2", "NATION_3")

# A side is broadcast only when an explicit check proves it within both bounds.
BROADCAST_ROW_LIMIT = 1_000_000
BROADCAST_BYTE_LIMIT = 256_000_000

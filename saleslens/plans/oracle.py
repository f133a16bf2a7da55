"""SQL (DuckDB dialect) for every registered query, written from the operators' definitions.

The formulations use what DuckDB offers and the operators do not use (rollups
with their total row, as-of joins, filtered aggregates, unpivoting), so
agreement is a real check and not the same plan twice. The pre-registered
views are the driver's tables; the fixture fact is a CTE.

Type alignment with Spark: sums of decimal(10,2) are cast to DECIMAL(20,2),
year/month to INTEGER, ratios computed in DOUBLE and rounded to 6 digits.
"""

from __future__ import annotations

from saleslens.constants import (
    FIXTURE_CORE_MARKETS,
    FIXTURE_EXCLUDED_SEGMENT,
    FIXTURE_MARKET_RULES,
    FIXTURE_MULTI_MARKET_COUNTRIES,
    FIXTURE_PRODUCT_RULE,
    FIXTURE_SEGMENT_YEARS,
)
from saleslens.functions.formatting import REPORT_FORMATS
from saleslens.sources.fixtures import (
    DIRTY_MARKET_EXPRESSION,
    GROWING_SALES_EXPRESSION,
    MIXED_CASE_EXPRESSIONS,
    SALES_FACT_EXPRESSIONS,
    SPARSE_EXPRESSIONS,
    sales_fact_sql,
)

# Spark type names of the fixture fact's columns (column_profile's data_type).
FACT_TYPES = {
    "row_id": "bigint",
    "order_date": "date",
    "ship_date": "date",
    "sales": "decimal(10,2)",
    "quantity": "smallint",
    "discount": "decimal(5,3)",
    "profit": "decimal(10,2)",
    "shipping_cost": "decimal(10,2)",
}
FACT_COLUMNS = [c for c, _ in SALES_FACT_EXPRESSIONS]


def _lst(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


CORE = _lst(FIXTURE_CORE_MARKETS)
YEARS = ", ".join(str(y) for y in FIXTURE_SEGMENT_YEARS)
MARKET_RULES = ", ".join(f"('{w}', '{c}', '{m}')" for w, c, m in FIXTURE_MARKET_RULES)
PRODUCT, PRODUCT_SUB, PRODUCT_CAT = FIXTURE_PRODUCT_RULE


# A fact is a list of CTEs ending in one named ``fact``.
Fact = str


def fact_of(expression: str = "SELECT * FROM clean") -> Fact:
    return f"WITH clean AS (\n{sales_fact_sql()}\n), fact AS ({expression})"


CLEAN = fact_of()
DIRTY = fact_of(f"SELECT * REPLACE ({DIRTY_MARKET_EXPRESSION} AS market) FROM clean")
SPARSE = fact_of(
    "SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in SPARSE_EXPRESSIONS.items()) + ") FROM clean"
)
TWINS = fact_of("SELECT * FROM clean UNION ALL SELECT * FROM clean WHERE row_id % 10 = 3")
GROWING = fact_of(f"SELECT * REPLACE ({GROWING_SALES_EXPRESSION} AS sales) FROM clean")


def per(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def r6(x: str, exact: bool) -> str:
    return x if exact else f"ROUND({x}, 6)"


def money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(20,2))"


# ------------------------------------------------------------------ audits --


def profile() -> str:
    kinds = ", ".join(f"('{c}', '{FACT_TYPES.get(c, 'string')}')" for c in FACT_COLUMNS)
    return f"""{CLEAN}, cells AS (
    SELECT column_name, cell FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM fact)
    UNPIVOT INCLUDE NULLS (cell FOR column_name IN (COLUMNS(*)))
), kinds(column_name, data_type) AS (VALUES {kinds})
SELECT column_name, any_value(data_type) AS data_type, count(*) - count(cell) AS null_count,
       count(DISTINCT cell) AS count_distinct
FROM cells JOIN kinds USING (column_name) GROUP BY column_name"""


def ranges() -> str:
    cols = ("sales", "quantity", "discount", "profit", "shipping_cost")
    cast = ", ".join(f"CAST({c} AS DECIMAL(18,3)) AS {c}" for c in cols)
    return f"""{CLEAN}
SELECT column_name, CAST(min(v) AS DOUBLE) AS "min", ROUND({per("sum(v)", "count(v)")}, 6) AS "avg",
       CAST(max(v) AS DOUBLE) AS "max"
FROM (UNPIVOT (SELECT {cast} FROM fact) ON {", ".join(cols)} INTO NAME column_name VALUE v) GROUP BY column_name"""


def duplicates(fact: Fact, cols: list[str]) -> str:
    names = ", ".join(cols)
    return f"""{fact}, counted AS (SELECT {names}, count(*) AS duplicate_counter FROM fact GROUP BY ALL)
SELECT duplicate_counter, {names} FROM counted WHERE duplicate_counter > 1"""


def spread(fact: Fact, name: str, ident: str, as_name: str, as_ident: str) -> str:
    return f"""{fact}
SELECT (SELECT count(*) FROM (SELECT DISTINCT {name} FROM fact WHERE {name} IS NOT NULL)) AS {as_name},
       (SELECT count(*) FROM (SELECT DISTINCT {ident} FROM fact WHERE {ident} IS NOT NULL)) AS {as_ident}"""


def children(fact: Fact, parents: str, child: str, alias: str, having: str = "") -> str:
    return f"""{fact}, pairs AS (SELECT DISTINCT {parents}, {child} FROM fact)
SELECT {parents}, count({child}) AS {alias} FROM pairs GROUP BY {parents} {having}"""


def hierarchy(fact: Fact, parent: str, child: str, child_alias: str, map_alias: str) -> str:
    return f"""{fact}, pairs AS (SELECT DISTINCT {parent} AS p, {child} AS c FROM fact)
SELECT count(DISTINCT c) AS {child_alias}, count(*) AS {map_alias},
       count(DISTINCT coalesce(p, '') || coalesce(c, '')) AS {map_alias}_concat FROM pairs"""


def products_with_parents() -> str:
    return f"""{CLEAN}, listed AS (SELECT DISTINCT category, subcategory, product_name FROM fact)
SELECT category, subcategory, product_name FROM listed AS here
WHERE EXISTS (SELECT 1 FROM listed AS a, listed AS b
              WHERE a.product_name = here.product_name AND b.product_name = here.product_name
                AND a.subcategory < b.subcategory)"""


def profit_by_year(exact: bool = False) -> str:
    return f"""{CLEAN}, signs AS (
    SELECT CAST(year(order_date) AS INTEGER) AS order_year, sum(profit) FILTER (profit < 0) AS lost,
           sum(profit) FILTER (profit > 0) AS won
    FROM fact GROUP BY ALL)
SELECT order_year, {money("lost")} AS negative_profit, {money("won")} AS positive_profit,
       {r6(per("abs(lost)", "won"), exact)} AS negative_positive_ratio
FROM signs WHERE lost IS NOT NULL AND won IS NOT NULL"""


# ------------------------------------------------------------- corrections --

MARKET_FIXED = fact_of(
    f"""SELECT d.* REPLACE (CASE WHEN r.m IS NULL THEN d.market ELSE r.m END AS market)
    FROM (SELECT * REPLACE ({DIRTY_MARKET_EXPRESSION} AS market) FROM clean) AS d
    LEFT JOIN (VALUES {MARKET_RULES}) AS r(w, c, m) ON d.market = r.w AND d.country = r.c"""
)
_MISFILED = f"product_name = '{PRODUCT}' AND subcategory <> '{PRODUCT_SUB}'"
PRODUCT_FIXED = fact_of(
    f"""SELECT * REPLACE (if({_MISFILED}, '{PRODUCT_SUB}', subcategory) AS subcategory,
                     if({_MISFILED}, '{PRODUCT_CAT}', category) AS category) FROM clean"""
)


# ------------------------------------------------------------------- gates --


def rolled(fact: Fact, by: str, measures: str, where: str = "") -> str:
    """CTEs ``one`` (a row for each group) and ``whole`` (the total row) from one rollup."""
    return f"""{fact}, rolled AS (
    SELECT {by}, grouping({by}) AS is_whole, {measures} FROM fact {where} GROUP BY ROLLUP ({by})
), one AS (SELECT * FROM rolled WHERE is_whole = 0), whole AS (SELECT * FROM rolled WHERE is_whole = 1)"""


IN_CORE = f"WHERE market IN ({CORE})"
_LINES = "sum(sales) AS rev, count(sales) AS valued, count(*) AS lines"


def market_performance(exact: bool = False) -> str:
    return f"""{rolled(CLEAN, "market", "count(DISTINCT country) AS lands, " + _LINES)}
SELECT one.market, one.lands AS country_count, {money("one.rev")} AS revenue,
       {r6(per("one.rev", "whole.rev"), exact)} AS revenue_pct, {r6(per("one.rev", "one.valued"), exact)} AS aov,
       one.lines AS order_count, {r6(per("one.lines", "whole.lines"), exact)} AS order_count_pct
FROM one, whole"""


def yearly(fact: Fact) -> str:
    """CTE ``steps``: each market's years with the previous year that has rows."""
    return f"""{fact}, years AS (
    SELECT market, CAST(year(order_date) AS INTEGER) AS y, sum(sales) AS r FROM fact {IN_CORE} GROUP BY ALL
), steps AS (
    SELECT now.market, now.y, now.r, CASE WHEN was.y IS NULL THEN 0 ELSE was.r END AS before
    FROM years AS now ASOF LEFT JOIN years AS was ON now.market = was.market AND now.y > was.y
)"""


def growth(exact: bool = False) -> str:
    return f"""{yearly(CLEAN)}
SELECT y AS order_year, market, {money("r")} AS revenue, {money("before")} AS lag_revenue,
       {r6(per("r - before", "before"), exact)} AS revenue_growth_yoy
FROM steps"""


def verdict(fact: Fact) -> str:
    return f"""{yearly(fact)}, falls AS (
    SELECT market, y, coalesce(before <> 0 AND (r - before) * sign(before) < 0, false) AS fell FROM steps
), runs AS (
    SELECT now.market, now.fell, now.fell AND coalesce(was.fell, false) AS again
    FROM falls AS now ASOF LEFT JOIN falls AS was ON now.market = was.market AND now.y > was.y
)
SELECT market, count(*) FILTER (fell) AS negative_yoy_years, bool_or(again) AS consecutive_decline,
       count(*) FILTER (fell) < 2 AND NOT bool_or(again) AS stable
FROM runs GROUP BY market"""


def totals() -> str:
    return f"""{CLEAN}
SELECT {money(f"sum(sales) FILTER (market IN ({CORE}))")} AS total_revenue,
       count(*) FILTER (market IN ({CORE})) AS total_order_count FROM fact"""


def category_performance(fact: Fact = CLEAN, exact: bool = False) -> str:
    return f"""{rolled(fact, "category", _LINES, IN_CORE)}
SELECT one.category, {money("one.rev")} AS revenue, {r6(per("one.rev", "whole.rev"), exact)} AS revenue_pct,
       one.lines AS order_count, {r6(per("one.lines", "whole.lines"), exact)} AS order_count_pct
FROM one, whole"""


def discount_over_index(fact: Fact = CLEAN, exact: bool = False) -> str:
    cut = "coalesce(sum(sales) FILTER (discount > 0), 0)"
    return f"""{rolled(fact, "market", f"sum(sales) AS rev, {cut} AS cut", IN_CORE)}, shares AS (
    SELECT one.market, one.rev, one.cut, {per("one.rev", "whole.rev")} AS s,
           if(one.cut = 0, 0.0, {per("one.cut", "whole.cut")}) AS d FROM one, whole)
SELECT market, {money("rev")} AS revenue, {money("cut")} AS discounted_revenue, {r6("s", exact)} AS market_revenue_pct,
       {r6("d", exact)} AS discounted_revenue_pct, if(d > s, 'Yes', 'No') AS discount_over_indexes_scale
FROM shares"""


def ship_mode_performance(fact: Fact = CLEAN, exact: bool = False) -> str:
    days = "(ship_date - order_date)"
    measures = f"sum({days}) AS days, count({days}) AS timed, sum(shipping_cost) AS cost, count(shipping_cost) AS costed, "
    return f"""{rolled(fact, "ship_mode", measures + _LINES, IN_CORE)}
SELECT one.ship_mode, CAST(trunc({per("one.days", "one.timed")}) AS BIGINT) AS avg_ship_day,
       {r6(per("one.days", "one.timed"), exact)} AS avg_ship_day_exact,
       {r6(per("one.cost", "one.costed"), exact)} AS avg_shipping_cost, {money("one.rev")} AS revenue,
       {r6(per("one.rev", "whole.rev"), exact)} AS revenue_pct, one.lines AS order_count,
       {r6(per("one.lines", "whole.lines"), exact)} AS order_count_pct
FROM one, whole"""


def monthly(fact: Fact) -> str:
    return f"""{fact}, months AS (
    SELECT CAST(year(order_date) AS INTEGER) AS order_year, CAST(month(order_date) AS INTEGER) AS order_month, segment,
           sum(sales) AS earned, sum(sum(sales)) OVER (PARTITION BY year(order_date), month(order_date)) AS month_sum
    FROM fact {IN_CORE} AND year(order_date) IN ({YEARS})
    GROUP BY year(order_date), month(order_date), segment)"""


def monthly_share() -> str:
    return f"""{monthly(CLEAN)}
SELECT order_year, order_month, segment, {money("earned")} AS monthly_revenue,
       ROUND({per("earned", "month_sum")}, 6) AS contribution_pct FROM months"""


def contribution(fact: Fact = CLEAN, exact: bool = False) -> str:
    return f"""{monthly(fact)}, stats AS (
    SELECT segment, avg({per("earned", "month_sum")}) AS m, stddev_samp({per("earned", "month_sum")}) AS sd
    FROM months GROUP BY segment)
SELECT segment, {r6("m", exact)} AS mean_pct, {r6("sd", exact)} AS std_dev, {r6("sd / NULLIF(m, 0)", exact)} AS cv_pct
FROM stats"""


def organic_demand(fact: Fact = CLEAN, exact: bool = False) -> str:
    share = per("count(*) FILTER (discount > 0)", "count(*)")
    return f"""{fact}
SELECT segment, count(*) FILTER (discount > 0) AS discounted_order_count, count(*) AS order_count,
       {r6(share, exact)} AS discounted_order_pct
FROM fact {IN_CORE} AND segment <> '{FIXTURE_EXCLUDED_SEGMENT}' GROUP BY segment"""


# ----------------------------------------------------------------- reports --


def shown(column: str, spec: str) -> str:
    digits = int(spec[1:])
    scaled, sign = (f"{column} * 100", "%") if spec[0] == "P" else (column, "")
    return f"format('{{:,.{digits}f}}', CAST(ROUND({scaled}, {digits}) AS DOUBLE)) || '{sign}'"


def report(exact_query: str, spec: dict[str, str]) -> str:
    """A gate's numbers with display strings made from the unrounded values."""
    base = f"({exact_query})"
    if "revenue_millions" in spec:
        base = f"(SELECT *, CAST(revenue AS DOUBLE) / 1e6 AS revenue_millions FROM {base})"
    numbers = ", ".join(f"ROUND({c}, 6) AS {c}" for c, f in spec.items() if f[0] == "P")
    strings = ", ".join(f"{shown(c, f)} AS {c}_fmt" for c, f in spec.items())
    return f"SELECT * REPLACE ({numbers}), {strings} FROM {base}"


REPORTING_FACT = f"""{CLEAN}
SELECT market AS "Market", CAST(market IN ({CORE}) AS INTEGER) AS "Is Core Market", country AS "Country", sales AS "Sales",
       discount AS "Discount", CAST(coalesce(discount > 0, false) AS INTEGER) AS "Discount Applied",
       category AS "Category", ship_mode AS "Ship Mode", order_date AS "Order Date",
       CAST(if(ship_date >= order_date, ship_date - order_date, NULL) AS INTEGER) AS "Shipping Days",
       shipping_cost AS "Shipping Cost", segment AS "Segment"
FROM fact"""

CALENDAR = f"""{CLEAN}, days AS (
    SELECT CAST(unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS DATE) AS d FROM fact)
SELECT d AS "Date", CAST(year(d) AS INTEGER) AS "Year", CAST(month(d) AS INTEGER) AS "Month",
       monthname(d) AS "Month Name", strftime(d, '%Y-%m') AS "Year Month"
FROM days"""


# -------------------------------------------------- shared states of the fact --

ROLLUP = f"""{CLEAN}
SELECT market, country, category, ship_mode, segment, CAST(year(order_date) AS INTEGER) AS order_year,
       CAST(month(order_date) AS INTEGER) AS order_month, coalesce(discount > 0, false) AS discounted, count(*) AS lines,
       {money("sum(sales)")} AS sum_sales, count(sales) AS n_sales, {money("sum(shipping_cost)")} AS sum_shipping_cost,
       count(shipping_cost) AS n_shipping_cost, CAST(sum(ship_date - order_date) AS BIGINT) AS sum_ship_days,
       count(ship_date - order_date) AS n_ship_days
FROM fact GROUP BY ALL"""


def tuples() -> str:
    kinds = {
        "market_country": ("market", "country"),
        "market_region": ("market", "region"),
        "category_subcategory_product": ("category", "subcategory", "product_name"),
        "product_names": ("product_id", "product_name"),
        "customers": ("customer_name", "customer_id", "region"),
    }
    parts = []
    for tag, columns in kinds.items():
        cells = [*columns, "NULL"][:3]
        names = ", ".join(f"CAST({c} AS VARCHAR) AS c{i}" for i, c in enumerate(cells))
        parts.append(f"SELECT '{tag}' AS tuple_of, {names}, count(*) AS n_lines FROM fact GROUP BY ALL")
    return f"{CLEAN} " + " UNION ALL ".join(parts)


def _shared_state_oracles(q: dict[str, str]) -> dict[str, str]:
    """Other forms of the operators give the rows that their plain forms give."""
    kinds = ", ".join(f"('{c}', '{FACT_TYPES.get(c, 'string')}')" for c in FACT_COLUMNS)
    out = {
        "load_sales_csv_lines": f"""{CLEAN} SELECT * REPLACE (product_name || chr(10) || '"a", b' || chr(10) AS product_name) FROM fact""",
        "sample_rows_seeded": f"""{CLEAN} SELECT * FROM fact
ORDER BY md5('7|' || coalesce(CAST(row_id AS VARCHAR), '~') || '|' || coalesce(product_id, '~')) LIMIT 25""",
        "column_profile_sketched": f"""{CLEAN}, cells AS (
    SELECT column_name, cell FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM fact)
    UNPIVOT INCLUDE NULLS (cell FOR column_name IN (COLUMNS(*)))
), kinds(column_name, data_type) AS (VALUES {kinds})
SELECT column_name, any_value(data_type) AS data_type, count(*) - count(cell) AS null_count, true AS within_bound
FROM cells JOIN kinds USING (column_name) GROUP BY column_name""",
        "audit_tuples": tuples(),
        "hierarchy_check_market_country_shared": hierarchy(
            CLEAN, "market", "country", "country_count_distinct", "market_country_map_count"
        ),
        "gate_rollup": ROLLUP,
        "gate_rollup_merged": ROLLUP,
        "segment_monthly_share_by_date": q["segment_monthly_share"],
        "reporting_fact_core_table": q["reporting_fact"],
        "apply_by_key": f"""{CLEAN}, orders_of AS (
    SELECT order_id, min(market) AS market, min(segment) AS segment FROM fact GROUP BY order_id)
SELECT order_id, market, CASE CAST(order_id AS BIGINT) % 10 WHEN 0 THEN upper(segment) WHEN 5 THEN NULL ELSE segment END AS segment
FROM orders_of""",
        # corrected rows take the rule's spelling, the others keep their own
        "apply_market_correction_no_case": f"""{fact_of(f"SELECT * REPLACE ({DIRTY_MARKET_EXPRESSION} AS market) FROM clean")},
mixed AS (SELECT * REPLACE ({", ".join(f"{e} AS {c}" for c, e in MIXED_CASE_EXPRESSIONS.items())}) FROM fact)
SELECT mixed.* REPLACE (CASE WHEN r.m IS NULL THEN mixed.market ELSE r.m END AS market)
FROM mixed LEFT JOIN (VALUES {MARKET_RULES}) AS r(w, c, m) ON lower(mixed.market) = lower(r.w) AND lower(mixed.country) = lower(r.c)""",
        "apply_subcategory_correction_no_case": f"""{CLEAN} SELECT lower('{PRODUCT}') AS product_name,
       lower('{PRODUCT_SUB}') AS correct_subcategory, lower('{PRODUCT_CAT}') AS correct_category, count(*) AS rows_changed
FROM fact WHERE {_MISFILED} HAVING count(*) > 0""",
    }
    for name in ("subcategory_product_count", "products_multi_subcategory", "region_reuses_market", "product_name_multi_id",
                 "customer_name_fanout"):
        out[f"{name}_shared"] = q[name]
    for name in ("market_performance", "market_yoy", "core_totals", "category_performance", "discount_over_index",
                 "ship_mode_performance", "segment_monthly_share", "segment_contribution", "organic_demand"):
        # upper case comes before lower case, so the least spelling is the fact's own
        out[f"{name}_rollup"] = out[f"{name}_no_case"] = q[name]
        if name != "market_performance":
            out[f"{name}_core_table"] = q[name]
    for name in ("discount_over_index", "ship_mode_performance", "segment_contribution", "organic_demand"):
        out[f"{name}_sparse_rollup"] = q[f"{name}_sparse"]
    return out


def oracle_queries() -> dict[str, str]:
    multi = "HAVING count({}) > 1"
    q = {
        "sales_fact": f"{CLEAN} SELECT * FROM fact",
        "sales_dirty": f"{DIRTY} SELECT * FROM fact",
        "load_sales_csv": f"{CLEAN} SELECT * FROM fact",
        "load_sales_csv_rejects": f"""{CLEAN}
SELECT row_id, CASE WHEN row_id % 17 = 0 THEN 'market longer than 30' WHEN row_id % 11 = 0 THEN 'unparsable cell'
                    ELSE 'quantity out of range' END AS reject_reason
FROM fact WHERE row_id % 11 = 0 OR row_id % 13 = 0 OR row_id % 17 = 0""",
        "column_profile": profile(),
        "duplicate_rows": duplicates(CLEAN, FACT_COLUMNS),
        "duplicate_rows_twins": duplicates(TWINS, FACT_COLUMNS),
        "duplicate_row_ids": duplicates(CLEAN, ["row_id"]),
        "identifier_cardinality_customer": spread(
            CLEAN, "customer_name", "customer_id", "customer_count_distinct", "customer_id_count_distinct"
        ),
        "identifier_cardinality_product": spread(
            CLEAN, "product_name", "product_id", "product_count_distinct", "product_id_count_distinct"
        ),
        "market_country_count": children(CLEAN, "market", "country", "country_count"),
        "category_subcategory_count": children(CLEAN, "category", "subcategory", "subcategory_count"),
        "subcategory_product_count": children(CLEAN, "category, subcategory", "product_name", "product_name_count"),
        "market_region_pairs": f"{CLEAN} SELECT market, region FROM fact GROUP BY ALL",
        "hierarchy_check_market_country": hierarchy(
            DIRTY, "market", "country", "country_count_distinct", "market_country_map_count"
        ),
        "hierarchy_check_category_subcategory": hierarchy(
            CLEAN, "category", "subcategory", "subcategory_count_distinct", "category_subcategory_map_count"
        ),
        "hierarchy_check_category_subcategory_sparse": hierarchy(
            SPARSE, "category", "subcategory", "subcategory_count_distinct", "category_subcategory_map_count"
        ),
        "hierarchy_check_subcategory_product": hierarchy(
            CLEAN, "subcategory", "product_name", "product_count_distinct", "subcategory_product_map_count"
        ),
        "numeric_range_stats": ranges(),
        "countries_multi_market": children(DIRTY, "country", "market", "market_count_distinct", multi.format("market")),
        "product_name_multi_id": children(
            CLEAN, "product_name", "product_id", "product_id_count_distinct", multi.format("product_id")
        ),
        "country_market_pairs": f"{DIRTY} SELECT country, market FROM fact "
        f"WHERE country IN ({_lst(FIXTURE_MULTI_MARKET_COUNTRIES)}) GROUP BY ALL",
        "products_multi_subcategory": products_with_parents(),
        "region_reuses_market": f"{CLEAN}, pairs AS (SELECT DISTINCT market, region FROM fact) "
        "SELECT DISTINCT a.market, a.region FROM pairs AS a JOIN pairs AS b ON a.region = b.market",
        "customer_name_fanout": f"{CLEAN}, ids AS (SELECT DISTINCT customer_name, customer_id, region FROM fact) "
        "SELECT customer_name, count(DISTINCT customer_id) AS customer_id_count_distinct, "
        "count(DISTINCT region) AS registered_region_count_distinct FROM ids GROUP BY customer_name",
        "negative_profit_rows": f"{CLEAN} SELECT * FROM fact WHERE sign(profit) = -1",
        "profit_ratio_by_year": profit_by_year(),
        "market_correction_map": f"""{DIRTY} SELECT row_id, m AS correct_market
FROM fact JOIN (VALUES {MARKET_RULES}) AS r(w, c, m) ON (market, country) = (w, c)""",
        # the dirty rows corrected back must give the clean fact exactly
        "apply_market_correction": f"{CLEAN} SELECT * FROM fact",
        "market_correction_report": f"""{DIRTY} SELECT w AS wrong_market, c AS country, m AS correct_market,
       count(*) AS rows_changed
FROM fact JOIN (VALUES {MARKET_RULES}) AS r(w, c, m) ON (market, country) = (w, c) GROUP BY ALL""",
        "hierarchy_check_market_country_corrected": hierarchy(
            MARKET_FIXED, "market", "country", "country_count_distinct", "market_country_map_count"
        ),
        "subcategory_correction_map": f"""{CLEAN} SELECT row_id, subcategory, product_name,
       '{PRODUCT_SUB}' AS correct_subcategory, '{PRODUCT_CAT}' AS correct_category FROM fact WHERE {_MISFILED}""",
        "apply_subcategory_correction": f"{PRODUCT_FIXED} SELECT * FROM fact",
        "subcategory_correction_report": f"""{CLEAN} SELECT any_value(product_name) AS product_name,
       '{PRODUCT_SUB}' AS correct_subcategory, '{PRODUCT_CAT}' AS correct_category, count(*) AS rows_changed
FROM fact WHERE {_MISFILED} HAVING count(*) > 0""",
        "hierarchy_check_subcategory_product_corrected": hierarchy(
            PRODUCT_FIXED, "subcategory", "product_name", "product_count_distinct", "subcategory_product_map_count"
        ),
        "analysis_columns": f"{CLEAN} SELECT * EXCLUDE (region, customer_name, product_id, profit) FROM fact",
        "analysis_snapshot": f"{CLEAN} SELECT market, country, sales, discount, category, ship_mode, order_date, "
        "ship_date, shipping_cost, segment FROM fact",
        "market_performance": market_performance(),
        "market_yoy": growth(),
        "market_stability_verdict": verdict(CLEAN),
        "market_stability_verdict_growing": verdict(GROWING),
        "core_totals": totals(),
        "category_performance": category_performance(),
        "discount_over_index": discount_over_index(),
        "ship_mode_performance": ship_mode_performance(),
        "segment_monthly_share": monthly_share(),
        "segment_contribution": contribution(),
        "organic_demand": organic_demand(),
        "category_performance_sparse": category_performance(SPARSE),
        "discount_over_index_sparse": discount_over_index(SPARSE),
        "ship_mode_performance_sparse": ship_mode_performance(SPARSE),
        "segment_contribution_sparse": contribution(SPARSE),
        "organic_demand_sparse": organic_demand(SPARSE),
        "reporting_fact": REPORTING_FACT,
        # the CSV round trip of the report fact must give the report fact back
        "export_csv": REPORTING_FACT,
        "date_dimension": CALENDAR,
    }
    exact = {
        "market_performance": market_performance(exact=True),
        "market_yoy": growth(exact=True),
        "category_performance": category_performance(exact=True),
        "discount_over_index": discount_over_index(exact=True),
        "ship_mode_performance": ship_mode_performance(exact=True),
        "segment_contribution": contribution(exact=True),
        "organic_demand": organic_demand(exact=True),
        "profit_ratio_by_year": profit_by_year(exact=True),
    }
    for base, spec in REPORT_FORMATS.items():
        name = "profit_ratio_report" if base == "profit_ratio_by_year" else f"{base}_report"
        q[name] = report(exact[base], spec)
    return q | _shared_state_oracles(q)

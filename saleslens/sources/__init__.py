"""Schema, ingestion, sinks and test-table fixtures."""

from saleslens.sources.csv_source import land_parquet, land_sales_csv, load_sales_csv
from saleslens.sources.fixtures import landed_sales_fact, sales_dirty, sales_fact, sales_fact_sql
from saleslens.sources.schema import SALES_COLUMNS, sales_schema
from saleslens.sources.sinks import export

__all__ = [
    "SALES_COLUMNS",
    "sales_schema",
    "load_sales_csv",
    "land_sales_csv",
    "land_parquet",
    "export",
    "sales_fact",
    "sales_dirty",
    "sales_fact_sql",
    "landed_sales_fact",
]

"""the sales fact built from the driver's TPC-H-style tables.

The column expressions are kept as SQL text because the same text defines the
fixture on DuckDB (the oracle) and on Spark; see FIXTURES.md section 2.1.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.constants import BROADCAST_BYTE_LIMIT, BROADCAST_ROW_LIMIT
from saleslens.session import shared_dir, shuffles_dropped

FIXTURE_VERSION = "f0-v2"

# Bytes of a joined dimension row: its key columns, a date and the names it carries.
DIM_ROW_BYTES = 250

# (column, SQL expression over lineitem/orders/customer/nation/region/part columns)
SALES_FACT_EXPRESSIONS = (
    ("row_id", "l_orderkey * 10 + l_linenumber"),
    ("order_id", "cast(o_orderkey as string)"),
    ("order_date", "cast(o_orderdate as date)"),
    ("ship_date", "cast(l_shipdate as date)"),
    ("ship_mode", "concat(l_returnflag, '-', l_linestatus)"),
    ("customer_id", "cast(c_custkey as string)"),
    ("customer_name", "c_name"),
    ("segment", "c_mktsegment"),
    ("city", "cast(null as string)"),
    ("state", "cast(null as string)"),
    ("country", "n_name"),
    ("market", "r_name"),
    (
        "region",
        "case when n_nationkey < 10 then r_name else concat(r_name, ' ', cast(n_nationkey % 2 as string)) end",
    ),
    ("product_id", "cast(p_partkey as string)"),
    (
        "category",
        "case when p_type in ('ECONOMY', 'STANDARD') then 'CORE' "
        "when p_type in ('SMALL', 'MEDIUM', 'LARGE') then 'SIZED' else 'PROMO' end",
    ),
    ("subcategory", "p_type"),
    ("product_name", "p_name"),
    ("sales", "cast(l_extendedprice as decimal(10,2))"),
    ("quantity", "cast(l_quantity as smallint)"),
    ("discount", "cast(l_discount as decimal(5,3))"),
    (
        "profit",
        "cast(cast(l_extendedprice as decimal(10,2)) * (1 - cast(l_discount as decimal(5,3))) "
        "- cast(l_quantity as decimal(5,0)) * cast(p_retailprice as decimal(10,2)) as decimal(10,2))",
    ),
    ("shipping_cost", "cast(cast(l_extendedprice as decimal(10,2)) * cast(l_tax as decimal(5,3)) as decimal(10,2))"),
    ("order_priority", "o_orderpriority"),
)

# Rows whose market is overwritten in the dirty variant (FIXTURES.md 2.2).
DIRTY_MARKET_EXPRESSION = (
    "case when country in ('NATION_2', 'NATION_3') and row_id % 7 = 0 then 'MIDDLE EAST' else market end"
)

# A variant with NULLs in measures, dates and group columns.
SPARSE_EXPRESSIONS = {
    "sales": "case when row_id % 5 = 0 then null else sales end",
    "discount": "case when row_id % 7 = 0 then null else discount end",
    "ship_date": "case when row_id % 11 = 0 then null else ship_date end",
    "shipping_cost": "case when row_id % 3 = 0 then null else shipping_cost end",
    "segment": "case when row_id % 13 = 0 then null else segment end",
    "category": "case when row_id % 17 = 0 then null else category end",
    "subcategory": "case when row_id % 19 = 0 then null else subcategory end",
}

# A variant in which one market grows every year, so that verdicts differ.
GROWING_SALES_EXPRESSION = (
    "case when market = 'ASIA' then cast(power(100, year(order_date) - 1990) as decimal(28,2)) "
    "else cast(sales as decimal(28,2)) end"
)


# A variant whose markets, segments, ship modes and categories are spelled in two ways.
MIXED_CASE_EXPRESSIONS = {
    c: f"case when row_id % {k} = 0 then lower({c}) else {c} end"
    for c, k in (("market", 2), ("segment", 3), ("ship_mode", 5), ("category", 7))
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Size-check outcomes per (application, input tables, bound): the inputs are
# keyed by file size and mtime, so a changed table is checked again.
_SMALL: dict[tuple[str, str, int], dict[str, bool]] = {}


def _fill_slots(df: DataFrame) -> DataFrame:
    """Round-robin redistribute a scan that has fewer splits than task slots.

    A file written as one row group can only be read by one task; with
    broadcast joins nothing downstream would re-partition it, so the whole
    join would run in that task. A large table has many more splits than
    slots and is returned untouched (no shuffle).
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def _dated(table: DataFrame, column: str) -> DataFrame:
    return table.withColumn(column, F.col(column).cast("date"))


#: The fact is landed in shares of so many bytes of lineitem at least, and in so many shares at most.
SHARE_BYTES, SHARES = 128 << 20, 4


def _share(table: DataFrame, key: str, share: tuple[int, int]) -> DataFrame:
    """The rows of ``table`` whose ``key`` falls to the share (number, of how many)."""
    number, shares = share
    return table.filter(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(shares)) == number) if shares > 1 else table


def sales_fact(
    spark: SparkSession, sf_dir: str, broadcast_rows: int = BROADCAST_ROW_LIMIT, share: tuple[int, int] = (0, 1)
) -> DataFrame:
    """Star join lineitem - orders - customer - nation - region - part, all inner.

    Every join looks up a dimension by its primary key, so a joined side has
    at most as many rows as its base table. Each side is broadcast only when
    that base table's row count (read from Parquet footers, no data scan) is
    at most ``broadcast_rows``; otherwise the join is pinned to sort-merge on
    the key, and AQE splits skewed partitions (a key holding a third of the
    rows) into several tasks. The fact side (lineitem) is never broadcast.
    Join order keeps the lineitem-sized data to two joins at most, and its
    rows narrow in them: the part, with the fewest and shortest columns, comes
    first, and the customer's texts, which meet orders (a quarter of lineitem)
    before, come with the last join. Times of day, which the fact does not
    have, are cut off before anything is moved. ``share`` (number, of how
    many) gives the lines of a share of the orders.
    """
    lineitem = _fill_slots(_dated(_share(_table(spark, sf_dir, "lineitem"), "l_orderkey", share), "l_shipdate"))
    orders = _dated(_share(_table(spark, sf_dir, "orders"), "o_orderkey", share), "o_orderdate")
    customer = _table(spark, sf_dir, "customer")
    nation = _table(spark, sf_dir, "nation")
    region = _table(spark, sf_dir, "region")
    part = _table(spark, sf_dir, "part")

    # One job counts every dimension table (Parquet counts come from footers).
    key = (spark.sparkContext.applicationId, _landing_key(spark, sf_dir, "dims"), broadcast_rows)
    if key not in _SMALL:
        every = _table(spark, sf_dir, "orders")  # of all shares
        dims = {"region": region, "nation": nation, "customer": customer, "orders": every, "part": part}
        counts = reduce(
            DataFrame.unionAll,
            [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n") for name, t in dims.items()],
        ).collect()
        # The joined columns of a dimension row (a few ids and short names) take DIM_ROW_BYTES at most.
        bound = min(broadcast_rows, BROADCAST_BYTE_LIMIT // DIM_ROW_BYTES)
        _SMALL[key] = {r["t"]: r["n"] <= bound for r in counts}
    proven_small = _SMALL[key]

    def small(side: DataFrame, name: str) -> DataFrame:
        # Proven small: broadcast it. Otherwise pin a sort-merge join, so the
        # planner's estimates can never pick the fact side to broadcast.
        return F.broadcast(side) if proven_small[name] else side.hint("merge")

    geo = nation.join(small(region, "region"), nation.n_regionkey == region.r_regionkey)
    cust = customer.join(small(geo, "nation"), customer.c_nationkey == geo.n_nationkey)
    order_cust = orders.join(small(cust, "customer"), orders.o_custkey == cust.c_custkey)
    lines = lineitem.join(small(part, "part"), lineitem.l_partkey == part.p_partkey)
    joined = lines.join(small(order_cust, "orders"), lines.l_orderkey == order_cust.o_orderkey)
    return joined.select(*[F.expr(e).alias(c) for c, e in SALES_FACT_EXPRESSIONS])


def sales_dirty(fact: DataFrame) -> DataFrame:
    """The fact with a broken market-country hierarchy injected (FIXTURES.md 2.2)."""
    return fact.withColumn("market", F.expr(DIRTY_MARKET_EXPRESSION))


def sales_sparse(fact: DataFrame) -> DataFrame:
    """The fact with NULLs strewn by row number."""
    return fact.withColumns({c: F.expr(e) for c, e in SPARSE_EXPRESSIONS.items()})


def sales_mixed_case(fact: DataFrame) -> DataFrame:
    """The fact with some texts in lower case."""
    return fact.withColumns({c: F.expr(e) for c, e in MIXED_CASE_EXPRESSIONS.items()})


def sales_twins(fact: DataFrame) -> DataFrame:
    """The fact with every row whose number ends in 3 twice."""
    return fact.unionAll(fact.filter("row_id % 10 = 3"))


def sales_growing(fact: DataFrame) -> DataFrame:
    """The fact with one market that grows every year."""
    return fact.withColumn("sales", F.expr(GROWING_SALES_EXPRESSION))


def sales_fact_sql() -> str:
    """The fixture as one SELECT over the driver's table names (DuckDB and Spark SQL)."""
    cols = ",\n    ".join(f"{e} AS {c}" for c, e in SALES_FACT_EXPRESSIONS)
    return (
        f"SELECT\n    {cols}\n"
        "FROM lineitem\n"
        "JOIN orders ON l_orderkey = o_orderkey\n"
        "JOIN customer ON o_custkey = c_custkey\n"
        "JOIN nation ON c_nationkey = n_nationkey\n"
        "JOIN region ON n_regionkey = r_regionkey\n"
        "JOIN part ON l_partkey = p_partkey"
    )


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, modification time) of a file, or of the files of a folder, on any file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p))


def _landing_key(spark: SparkSession, sf_dir: str, variant: str) -> str:
    """Identity of the inputs: every file of every table, by the file system's own listing."""
    parts = [FIXTURE_VERSION, variant, sf_dir.rstrip("/")]
    for name in ("lineitem", "orders", "customer", "nation", "region", "part"):
        parts.append(f"{name}:{_files(spark, f'{sf_dir.rstrip('/')}/{name}.parquet')}")
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def finished(spark: SparkSession, folder: str) -> str | None:
    """The first complete table under ``folder`` (a writer's attempt that reached its success mark)."""
    for name, _, _ in _files(spark, folder):
        if any(f == "_SUCCESS" for f, _, _ in _files(spark, f"{folder}/{name}")):
            return f"{folder}/{name}"
    return None


def write_once(spark: SparkSession, folder: str, write) -> str:
    """The complete table under ``folder``; ``write(path)`` makes it, on a path of its own, if there is none.

    A half-written attempt is never read, and repeated calls leave one copy.
    """
    path = finished(spark, folder)
    if path is None:
        path = f"{folder}/{uuid.uuid4().hex}"
        write(path)
    return path


def file_groups(spark: SparkSession, path: str, least: int, most: int) -> list[list[str]]:
    """The files of the table in ``path`` in groups of ``least`` bytes or more (the last may be smaller), ``most`` groups at most."""
    files = [(name, size) for name, size, _ in _files(spark, path) if not name.startswith(("_", "."))]
    enough = max(least, -(-sum(size for _, size in files) // most))
    groups: list[list[str]] = []
    room = 0
    for name, size in files:
        if room <= 0:
            groups.append([])
            room = enough
        groups[-1].append(f"{path}/{name}")
        room -= size
    return groups


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder, on any file system; there need not be one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def mark_finished(spark: SparkSession, path: str) -> None:
    """Puts the success mark on a table that several jobs wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True).close()


# Landed tables opened in this application, by path: a finished path never
# changes, so the DataFrame is reused without listing the folder again.
_OPENED: dict[tuple[str, str], DataFrame] = {}


def landed_sales_fact(spark: SparkSession, sf_dir: str, dirty: bool = False, refresh: bool = False) -> DataFrame:
    """The fact written once as Parquet in the shared folder, then scanned.

    This mirrors the source system, where the fact is a stored table: the
    star join runs once, and every audit or gate reads only the columns it
    needs from columnar storage (pruned ReadSchema, pushed filters). The
    written table also cuts lineage, so a lost executor never replays the join.
    The folder is keyed by the inputs' files (name, size, time, on any file
    system) and the fixture version; each landing has a path of its own there
    and counts only with its success mark. ``refresh=True`` lands it again.
    """
    variant = "dirty" if dirty else "clean"
    folder = landing_folder(spark, sf_dir, variant)

    def write(path: str) -> None:
        # Cap rows per file so the landed table has at least as many files as
        # there are task slots (more parallel scans later) without a shuffle:
        # each writing task just rolls over to a new file. The lineitem count
        # comes from Parquet footers. At 100 TB this gives files of tens of
        # millions of rows, each with many row groups.
        rows = _table(spark, sf_dir, "lineitem").count()
        per_file = max(1, -(-rows // max(1, spark.sparkContext.defaultParallelism)))
        # Shares of the fact are joined one after the other, each by itself, and what
        # a share has shuffled is deleted before the next; only the last makes the table count.
        size = sum(n for _, n, _ in _files(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet"))
        shares = 1 if dirty else max(1, min(SHARES, -(-size // SHARE_BYTES)))
        for i in range(shares):
            # The dirty variant is derived from the landed clean fact (scan + CASE),
            # so the star join runs once for both.
            fact = sales_dirty(landed_sales_fact(spark, sf_dir)) if dirty else sales_fact(spark, sf_dir, share=(i, shares))
            writer = fact.write.mode("append").option("maxRecordsPerFile", per_file)
            with shuffles_dropped(spark):
                writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(i == shares - 1).lower()).parquet(path)

    if refresh:
        path = f"{folder}/{uuid.uuid4().hex}"
        write(path)
    else:
        path = write_once(spark, folder, write)
    key = (spark.sparkContext.applicationId, path)
    if key not in _OPENED:
        _OPENED[key] = spark.read.parquet(path)
    return _OPENED[key]


def landing_folder(spark: SparkSession, sf_dir: str, variant: str) -> str:
    """Folder of what is derived from the tables of ``sf_dir`` as they are now."""
    return f"{shared_dir(spark)}/saleslens/landed/{_landing_key(spark, sf_dir, variant)}"

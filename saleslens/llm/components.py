"""Connected components of a link table, as DataFrame joins and minima.

Alternating star contraction: each round links a node's larger neighbours to
the smallest node it knows, then its smaller ones; the rounds end when every
link points at the smallest node of its component. Tables between rounds are
written to the shared folder, nothing is collected, and hub nodes are
pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import through_storage

#: Rounds needed grow with the logarithm of the longest chain; this bound only guards against a fault.
MAX_ROUNDS = 100


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return (
        both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(
        least.select("a", F.col("low").alias("b"))
    )


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b): the smallest node that links reach.

    Self-links, repeated links and both directions are fine; an empty table
    gives an empty result; rows with a null end are ignored.
    """
    links = links.select("a", "b").filter("a <> b").distinct()
    links = through_storage(links, "links")
    before = None
    for _ in range(MAX_ROUNDS):
        links = _small_star(_large_star(links)).filter("a <> b").distinct()
        links = through_storage(links, "links")
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the links did not settle")
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

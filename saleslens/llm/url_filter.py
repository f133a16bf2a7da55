"""Operator 2, URL filters.

Listed keys (a host and a path prefix) go into a blocked Bloom filter. Every
URL asks it for each of its own host suffixes with each path prefix of a
listed length; only possible hits reach an exact hash join with the list,
which removes the false positives. The longest rule that fits decides.

All steps are DataFrame operations. The filter is a table of 256-bit blocks
(four longs); its size has a fixed bound, whatever the length of the list: a
list beyond it fills the filter, so more candidates pass to the exact join
and the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import ascii_lower

#: Bits of the filter for each listed key.
BITS_PER_KEY = 16
#: Largest number of 256-bit blocks; about 10 MB of longs when broadcast.
MAX_BLOCKS = 1 << 18
#: The list itself is broadcast up to this many rows and characters, else joined by shuffle.
MAX_BROADCAST_RULES = 100_000
MAX_BROADCAST_CHARS = 8_000_000

#: The rules of the registered query: (verdict, host and path).
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased;
    path: from there up to ``?``, ``#`` or end. Both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    """Labels of a host: one more than it has dots."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def rule_table(rules: DataFrame) -> DataFrame:
    """key, rule, action: one row for each distinct rule; of two actions for one rule, block wins.

    ``rules``: rule (host and path prefix, like ``example.net/en/``) and action
    (allow or block). Rows with a null rule or action are ignored. ``plen`` and
    ``labels`` are the length of its path and the number of its host's labels.
    """
    parts = F.regexp_extract("rule", r"^([^/]*)", 1), F.regexp_extract("rule", r"^[^/]*(.*)$", 1)
    return (
        rules.filter(F.col("rule").isNotNull() & F.col("action").isNotNull())
        .select(ascii_lower(parts[0]).alias("h"), parts[1].alias("p"), "rule", "action")
        .groupBy(F.concat_ws(" ", "h", "p").alias("key"))
        .agg(F.min("rule").alias("rule"), F.max("action").alias("action"), F.max(F.length("p")).alias("plen"), F.max(_labels(F.col("h"))).alias("labels"))
    )


def _block_and_masks(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and two bits in each of its four words."""
    bits = F.xxhash64(key, F.lit("bits"))

    def bit(at: int) -> Column:
        return F.call_function(
            "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, at).bitwiseAND(63).cast("int")
        )

    masks = [bit(12 * word).bitwiseOR(bit(12 * word + 6)) for word in range(4)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)), masks


def bloom_blocks(keys: DataFrame, count: int) -> tuple[DataFrame, int]:
    """The filter of ``keys.key``: block, w0..w3; and its number of blocks."""
    wanted = max(1, -(-count * BITS_PER_KEY // 256))
    blocks = min(MAX_BLOCKS, 1 << (wanted - 1).bit_length())
    block, masks = _block_and_masks(F.col("key"), blocks)
    table = (
        keys.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])
    )
    return table, blocks


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    A rule fits its host and all subdomains if the url's path starts with the
    rule's; the longest wins, and a URL without a rule is not listed: allow.
    Null, empty or odd URLs have an empty host and path and are allowed unless
    a rule with an empty host fits; repeated rows are judged each on its own;
    a null page_id is kept; an empty rule table allows everything. Other
    columns of ``pages`` are not read.
    """
    table = rule_table(rules)
    size = table.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("key")).alias("chars"), F.collect_set("plen").alias("lens"),
        F.collect_set("labels").alias("labels"),
    ).first()  # lengths of a list's paths and hosts are few: they are lengths, not texts
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "rid", F.monotonically_increasing_id()
    )
    if not size["n"]:
        return urls.select(
            "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")
        )
    lens = F.array(*[F.lit(int(x)) for x in sorted(size["lens"])])
    # suffixes of as many labels as listed hosts have, however many the URL's host has
    counts = F.array(*[F.lit(int(x)) for x in sorted(size["labels"])])
    suffixes = F.transform(
        F.filter(counts, lambda n: n <= _labels(F.col("host"))),
        lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n),
    )
    prefixes = F.transform(
        F.filter(lens, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat_ws(" ", h, p))))
    # the null key keeps every URL, with or without a candidate
    asked = urls.withColumn("key", F.explode(F.array_append(keys, F.lit(None).cast("string"))))

    blocks, n_blocks = bloom_blocks(table, size["n"])
    block, masks = _block_and_masks(F.col("key"), n_blocks)
    passed = asked.withColumn("block", F.when(F.col("key").isNotNull(), block)).join(
        F.broadcast(blocks), "block", "left"  # at most MAX_BLOCKS rows
    )
    hit = F.lit(True)
    for i, mask in enumerate(masks):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    possible = passed.filter(F.col("key").isNull() | F.coalesce(hit, F.lit(False))).select(
        "rid", "page_id", "host", "path", "key"
    )
    listed = table.select("key", "rule", "action")
    if size["n"] <= MAX_BROADCAST_RULES and (size["chars"] or 0) <= MAX_BROADCAST_CHARS:
        listed = F.broadcast(listed)  # proven small just above; else adaptive execution splits hot keys
    verified = possible.join(listed, "key", "left")
    best = F.max(
        F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("action")))
    )
    return (
        verified.groupBy("rid", "page_id", "host", "path")
        .agg(best.alias("best"))
        .select(
            "page_id",
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.action", F.lit("allow")).alias("verdict"),
        )
    )

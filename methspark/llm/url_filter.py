"""URL filter: a blocked Bloom filter of listed canonical URLs, an exact hash join behind it, and path rules over both.

The filter is an ordinary table: ``block`` and eight 32-bit words, made by hashing every listed URL to one block and
eight bits of it, and OR-ing them by block. A URL needs one block, so probing is one equi-join on the block number and
eight bit tests, all in generated code. What passes goes to an exact join on the URL itself, which removes the false
positives. The filter is broadcast while its blocks are at most ``BROADCAST_BLOCKS``; beyond that the probe shuffles on
the block number. Rules are found the same way: a rule is listed under its host and path, and a URL is looked up under
each suffix of its host with each rule-path length that occurs.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is not listed, so it is
allowed. Repeated rows are judged one by one. Null and repeated list entries count once or not at all. Columns of the
input other than the id and the URL are not read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, written

#: Bits set for a key, one in each 32-bit word of its block; odd multipliers of a split-block Bloom filter as in the
#: Parquet specification (fixed values).
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: Listed URLs to a block of 256 bits: 16 bits a URL, about 0.1 % false positives.
KEYS_PER_BLOCK = 16
#: At 72 bytes a block, and a row's overhead, this bounds the broadcast filter to about 100 MB.
BROADCAST_BLOCKS = 1 << 20
#: Rules are a policy file; more than this many go by a shuffled join.
BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.``, and path without closing slashes and ``.html``; scheme, query and fragment play no part."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(?:\.html|/+)\z", ""))


def _bits(key: Column) -> list[Column]:
    """The bit of each of the eight words."""
    low = F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.lit(1).cast("long") * F.pow(F.lit(2.0), F.shiftrightunsigned((low * F.lit(s & 0x7FFFFFFF)).bitwiseAND(F.lit(0xFFFFFFFF)), 27)).cast("long") for s in SALTS]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(blocks))


def bloom_table(keys: DataFrame, blocks: int) -> DataFrame:
    """``block, w0 .. w7`` of the column ``key``."""
    bits = _bits(F.col("key"))
    with_bits = keys.select(_block(F.col("key"), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
    return with_bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(len(SALTS))])


def probably_in(probes: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``probes`` whose ``key`` the filter may hold."""
    side = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom
    met = probes.withColumn("block", _block(F.col("key"), blocks)).join(side, "block")
    for i, b in enumerate(_bits(F.col("key"))):
        met = met.filter(F.col(f"w{i}").bitwiseAND(b) != 0)
    return met.drop("block", *[f"w{i}" for i in range(len(SALTS))])


def listed_hits(probes: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct ``key`` values of ``probes`` that are in ``listed`` (column ``key``), by filter and exact join."""
    keys = written(listed.filter(F.col("key").isNotNull()).select("key").distinct(), "listed")
    blocks = max(1, -(-keys.count() // KEYS_PER_BLOCK))
    wanted = probes.select("key").distinct()
    return probably_in(wanted, bloom_table(keys, blocks), blocks).join(keys, "key", "left_semi")


def rule_table(rules: DataFrame) -> DataFrame:
    """``rule_host, rule_path, rule, rule_verdict`` from rows ``rule`` (host, then path) and ``verdict``."""
    at = F.instr("rule", "/")
    return rules.filter("rule is not null").select(
        F.when(at > 0, F.substring(F.col("rule"), F.lit(1), at - 1)).otherwise(F.col("rule")).alias("rule_host"),
        F.when(at > 0, F.col("rule").substr(at, F.length("rule"))).otherwise("").alias("rule_path"),
        "rule",
        F.col("verdict").alias("rule_verdict"),
    )


def rule_hits(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url`` and the longest fitting rule (ties: the smaller string) of the distinct URLs that any rule fits."""
    small = rules.count() <= BROADCAST_RULES
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    spread = urls.select("url", "path", F.explode(suffixes).alias("rule_host"))
    met = spread.join(F.broadcast(rules) if small else rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    best = F.min(F.struct((-F.length("rule")).alias("o"), F.col("rule"), F.col("rule_verdict"))).alias("b")
    return met.groupBy("url").agg(best).select("url", "b.rule", "b.rule_verdict")


def judge(pages: DataFrame, listed: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict, canonical_url, listed`` for every row.

    ``listed`` holds the canonical URLs to block (column ``key``), ``rules`` the rows ``rule, verdict``. A fitting rule
    decides; else a listed URL is blocked and any other allowed.
    """
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    parts = rows.select("url").filter("url is not null").distinct().select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    parts = parts.withColumn("key", canonical(F.col("host"), F.col("path")))
    hits = listed_hits(parts.filter("host <> ''"), listed).withColumn("listed", F.lit(True))
    ruled = rule_hits(parts.filter("host <> ''"), rule_table(rules))
    found = parts.join(ruled, "url", "left").join(hits, "key", "left").select("url", "rule", "rule_verdict", "listed")
    found = found.filter("rule is not null or listed")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    return rows.join(found, "url", "left").select(
        id_col,
        host.alias("host"),
        path.alias("path"),
        "rule",
        F.coalesce("rule_verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        canonical(host, path).alias("canonical_url"),
        F.coalesce("listed", F.lit(False)).alias("listed"),
    )

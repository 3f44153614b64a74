"""Exact dedup by a tree-merge of sorted digest runs, with DataFrame functions only.

Every input partition forms a run: its rows' digests, each with the identifier kept so far and a count. Runs then merge in
binomial rounds. In each round the runs whose numbers agree without their lowest ``FAN_BITS`` bits exchange their
digests, and each of those partners takes one more slice of the digest space, so that a round merges 2^``FAN_BITS`` runs
and the number of partitions at work stays the same: after the last round one run is left, spread over all
partitions, and no task ever holds more than its share. A sort-based aggregate does the merging: equal digests lie side
by side in the sorted input, and only the identifier to keep survives, at every level. Each level pre-aggregates before it
exchanges, so a group of any size leaves one row in a run.

An entry is verified: byte length and a second, independent 64-bit hash are part of its key, so texts that agree in the
SHA-256 digest but in neither of the others stay apart at every level.

Defined results: a null text counts as an empty one; rows without an id (null) are grouped like others, and such a row is
kept only if its whole group has no id; of rows that repeat an id within a group, each is kept. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_width, written

#: log2 of the runs that one round merges.
FAN_BITS = 3
KEY = ("digest", "n_bytes", "check")


def digests(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``id, digest, n_bytes, check`` of every row: SHA-256, byte length and a second hash of the text."""
    full = F.coalesce(text, F.lit(""))
    return df.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(full, 256)).alias("digest"),
        F.octet_length(full).cast("long").alias("n_bytes"),
        F.xxhash64(full).alias("check"),
        F.spark_partition_id().alias("part"),
    )


def _slice(bits: int) -> Column:
    """The first ``bits`` (up to 24) bits of the digest."""
    return F.shiftright(F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int"), 24 - bits)


def _level(runs: DataFrame, rounds_bits: int, keep: str) -> DataFrame:
    """One round: the runs that share ``run`` merge within their slice; the identifier to keep survives."""
    known = F.col("id").isNotNull()
    best = (F.max(F.struct(known.alias("known"), "id", "check")) if keep == "largest" else F.min(F.struct((~known).alias("unknown"), "id", "check"))).alias("best")
    merged = runs.withColumn("slice", _slice(rounds_bits)).groupBy("run", "slice", *KEY).agg(best, F.sum("n").alias("n"))
    return merged.select("run", *KEY, F.col("best.id").alias("id"), "n")


def merged_runs(digest_rows: DataFrame, keep: str = "largest") -> DataFrame:
    """``digest, n_bytes, check, keep_id, group_size``: the single run left by the tree."""
    width = max(1, math.ceil(math.log2(max(2, shuffle_width(digest_rows.sparkSession)))))
    runs = digest_rows.select(F.pmod("part", F.lit(1 << width)).alias("run"), *KEY, "id", F.lit(1).cast("long").alias("n"))
    done = 0
    while done < width:
        step = min(FAN_BITS, width - done)
        done += step
        runs = _level(runs.withColumn("run", F.shiftright("run", step)), done, keep)
    return runs.select(*KEY, F.col("id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` for every row; of equal texts the ``keep`` id stays."""
    rows = written(digests(df, id_col, F.col(text_col)), "digests")
    groups = written(merged_runs(rows, keep), "runs")
    return rows.join(groups, list(KEY)).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

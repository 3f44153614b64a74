"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Three levels. Targets: the sources' weights share the budget, no source beyond ``MAX_EPOCHS`` times its size, the excess
going to the others by weight. Blocks: the whole target is cut into equal blocks of ``block`` tokens, which Sainte-Lague
gives to the sources by their highest quotients, target / 1, target / 3, target / 5 and so on; a source's blocks go to its
shards in the same way, by tokens, so each shard has an integer quota. Selection: a shard lays its documents in a
seeded order, end to end, and takes its quota in whole passes and then blocks from the start of that order.

Quotients are not handed out one by one: for a divisor d, party i has floor(v_i / d + 1/2) seats, so the divisor is found by
bisection and the seats still open go by the next quotients, ties to the first party. That costs the same for three
blocks and for billions.

A shard's seats end at ``MAX_EPOCHS`` times its tokens; what it can't take goes to the source's other shards by the same quotients, so
no seat is lost.

What stays small: the sources (at most ``MAX_SOURCES``, checked) and, in one task a source, the token totals of its shards,
of which each covers about ``shard_docs`` documents, and more if there were over ``MAX_SHARDS`` of them. A shard is a hash bucket of the documents' ids and texts, so a hot source
only has more shards, repeated or null ids are spread,, and windows run within a shard.

Defined results: a null text has size 0 and gets 0; a null source is a source of its own, last in order; rows that
repeat an id are spread by a hash of their texts, and within a shard taken by size and then by that hash, so reruns agree; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import words, written

MAX_EPOCHS = 2
MAX_SOURCES = 1_000_000
#: Shards of a source at most; one task shares its blocks out to them. A larger source has larger shards.
MAX_SHARDS = 200_000
#: Weights in order of the sources, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5


def targets(sizes: list[float], weights: list[float], share: float, epochs: float = MAX_EPOCHS) -> list[float]:
    """Shares of ``share`` times all sizes by weight, none above ``epochs`` times its size; the excess is shared anew."""
    budget, open_ = share * sum(sizes), [i for i, s in enumerate(sizes)]
    out = [0.0] * len(sizes)
    while open_:
        each = budget / sum(weights[i] for i in open_)
        full = [i for i in open_ if each * weights[i] >= epochs * sizes[i]]
        if not full:
            for i in open_:
                out[i] = each * weights[i]
            break
        for i in full:
            out[i] = float(epochs * sizes[i])
            budget -= out[i]
        left = set(full)
        open_ = [i for i in open_ if i not in left]
    return out


def sainte_lague(votes: list[float] | np.ndarray, seats: int, most: list[int] | np.ndarray | None = None) -> list[int]:
    """Seats of each party by the highest quotients v / (2 s + 1), none above its ``most``; ties go to the first party."""
    v = np.asarray(votes, dtype=float)
    if seats <= 0 or not len(v) or v.max() <= 0:
        return [0] * len(v)
    cap = np.full(len(v), seats, dtype=np.int64) if most is None else np.minimum(np.asarray(most, dtype=np.int64), seats)
    if cap[v > 0].sum() <= seats:
        return [int(x) for x in np.where(v > 0, cap, 0)]
    low, high = 0.0, float(v.max()) * 2 + 1  # more seats than wanted by low, at most so many by high
    for _ in range(200):
        mid = (low + high) / 2
        if mid > 0 and np.minimum(np.floor(v / mid + 0.5), cap).sum() <= seats:
            high = mid
        else:
            low = mid
    got = np.minimum(np.floor(v / high + 0.5), cap).astype(np.int64)
    while (left := int(seats - got.sum())) > 0:  # parties whose next quotients are equal
        following = np.where((got < cap) & (v > 0), v / (2 * got + 1), -1.0)
        first = np.argsort(-following, kind="stable")[:left]
        got[first[following[first] > 0]] += 1
    return [int(x) for x in got]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, size, tie``: the words of every text, and a hash that orders rows with equal ids."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), F.xxhash64(F.col(text_col)).alias("tie"))


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("id"))


def source_plan(sizes: DataFrame, block: int | None, weights: tuple[float, ...], share: float) -> list[dict]:
    """For each source in order: its size, documents, target and quota of blocks. One row a source is collected, checked to be few."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    got = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share)
    size = block or 1
    quotas = sainte_lague(got, round(sum(got) / size))
    return [{"source": r["source"], "source_size": r["size"], "docs": r["docs"], "target": t, "quota": q} for r, t, q in zip(rows, got, quotas, strict=True)]


def shard_quotas(shards: DataFrame, block: int) -> DataFrame:
    """``source_no, shard, quota`` (blocks) from ``source_no, quota, shard, tokens``: one source's shards in one small task."""

    def share_out(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        most = [math.ceil(MAX_EPOCHS * t / block) for t in rows["tokens"]]
        seats = np.array(sainte_lague(rows["tokens"].to_numpy(), int(rows["quota"].iloc[0]), most), dtype="int64")
        return pd.DataFrame({"source_no": rows["source_no"], "shard": rows["shard"], "blocks": seats})

    return shards.groupBy("source_no").applyInPandas(share_out, "source_no int, shard long, blocks long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    block: int = 64,
    shard_docs: int = 5_000,
    seed: int = 20_011,
) -> DataFrame:
    """``id, size, source_size, target, taken, quota_blocks, shard`` for every document; ``taken`` counts repeats."""
    spark = docs.sparkSession
    rows = written(sized(docs, id_col, text_col, source_col), "sized")
    plan = source_plan(rows, block, weights, share)
    table = spark.createDataFrame(
        [(i, p["source"], int(p["source_size"]), float(p["target"]), int(p["quota"]), int(min(MAX_SHARDS, max(1, -(-p["docs"] // shard_docs))))) for i, p in enumerate(plan)],
        "source_no int, source string, source_size long, target double, quota long, shards long",
    )
    met = rows.alias("r").join(F.broadcast(table).alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.id", "r.size", "r.tie", "t.source_no", "t.source_size", "t.target", "t.quota", "t.shards")
    met = met.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "tie"), "shards"))
    totals = met.groupBy("source_no", "quota", "shard").agg(F.sum("size").alias("tokens"))
    quotas = shard_quotas(totals, block)
    line = Window.partitionBy("source_no", "shard").orderBy(_order(seed), "id", "size", "tie")
    whole = Window.partitionBy("source_no", "shard")
    laid = met.join(quotas, ["source_no", "shard"]).withColumn("upto", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("tokens", F.sum("size").over(whole))
    want = F.least(F.col("blocks") * F.lit(block), F.lit(MAX_EPOCHS) * F.col("tokens"))
    passes = F.when(F.col("tokens") > 0, F.expr(f"least(blocks * {block}, {MAX_EPOCHS} * tokens) div tokens")).otherwise(0)
    rest = want - passes * F.col("tokens")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("upto") - F.col("size"))))
    return laid.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (passes * F.col("size") + part).cast("long").alias("taken"),
        F.col("blocks").alias("quota_blocks"),
        "shard",
    )

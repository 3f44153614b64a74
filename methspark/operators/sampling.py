"""Reproducible sampling: seeded orders, subsampling to a coverage, balanced samples and oversampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kinetics import has_kinetics

#: A seeded order has so many places.
MODULUS = 1 << 32
LEAST_LENGTH = 5000
TARGET_SAMPLES = 100_000
ORDER_BUCKETS = 1024


def seeded_order(id_: Column, *seed: int | Column) -> Column:
    """A place below MODULUS by a hash of seeds and id, of any type; each seed has an order of its own."""
    named = F.concat_ws(":", *[F.lit(s).cast("string") if isinstance(s, int) else s.cast("string") for s in seed], id_.cast("string"))
    return F.conv(F.md5(named.cast("binary")).substr(1, 8), 16, 10).cast("long")


def _free(rows: DataFrame, name: str) -> str:
    """``name``, with underscores until no column has it."""
    while name.lower() in (c.lower() for c in rows.columns):
        name += "_"
    return name


def running_total(rows: DataFrame, value: str, order: Column, tie: str, buckets: int = ORDER_BUCKETS) -> DataFrame:
    """``rows`` with ``upto``, the sum of ``value`` up to the row in the order (0 .. MODULUS), without one global window.

    The order is cut to equal ranges; each range's total is summed first, and the running sum within a range starts from the
    totals before it. The totals are ``buckets`` rows, hence broadcast.
    """
    place, part, total, start = (_free(rows, name) for name in ("place", "part", "total", "start"))
    keyed = rows.withColumn(place, order).withColumn(part, F.floor(F.col(place) / (MODULUS // buckets)).cast("int"))
    totals = keyed.groupBy(part).agg(F.sum(value).alias(total))
    starts = totals.withColumn(start, F.coalesce(F.sum(total).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(part, start)
    within = Window.partitionBy(part).orderBy(place, tie).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.join(F.broadcast(starts), part).withColumn("upto", F.col(start) + F.sum(value).over(within)).drop(place, part, start)


def eligible(reads: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """Reads ``seq, fi, fp, ri, rp`` of at least so many bases and with whole kinetics of both strands."""
    return reads.filter((F.length("seq") >= least) & has_kinetics(F.col("seq"), *[F.col(k) for k in ("fi", "fp", "ri", "rp")]))


def to_coverage(reads: DataFrame, target: int, seed: int, id_col: str = "read_id", length: str = "length") -> DataFrame:
    """Reads in seeded order until their bases reach the target, the one that reaches it included; at least one."""
    return running_total(reads, length, seeded_order(F.col(id_col), seed), id_col).filter(F.col("upto") - F.col(length) < F.greatest(F.lit(target), F.lit(1)))


def target_bases(genome_size: Column, coverage: float) -> Column:
    return F.floor(genome_size * coverage).cast("long")


def replication(n: Column, target: int = TARGET_SAMPLES) -> Column:
    """How often a bag of n is repeated: 2 floor(2 target / n) times if it is smaller than the target, else once."""
    return F.when((n > 0) & (n < target), 2 * F.floor(F.lit(2 * target) / n)).otherwise(1).cast("long")


def oversampled(rows: DataFrame, keys: tuple[str, ...], target: int = TARGET_SAMPLES) -> DataFrame:
    """Each small group repeated; ``copy`` numbers the repeats. Only groups under the target are met, by a join that Spark chooses."""
    times = _free(rows, "times")
    few = rows.groupBy(*keys).agg(replication(F.count(F.lit(1)), target).alias(times)).alias("few")
    same = reduce(Column.__and__, [F.col(f"rows.{k}").eqNullSafe(F.col(f"few.{k}")) for k in keys])
    met = rows.alias("rows").join(few, same).select("rows.*", F.col(f"few.{times}"))
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop(times)


def balanced(rows: DataFrame, keys: tuple[str, ...], id_col: str, replicates: int, size: int, seed: int) -> DataFrame:
    """``size`` rows of each group in each of the replicates, each by a seeded order of its own; ties by id.

    Counts by group, replicate and range of the order tell in which range the last row lies, so only rows up to that range are
    sorted: ``size`` and one range's rows for each group, however large it is. The counts are ``ORDER_BUCKETS`` rows a group and replicate.
    """
    place, part, last, rank = (_free(rows, name) for name in ("place", "part", "last", "rank"))
    spread = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    spread = spread.withColumn(place, seeded_order(F.col(id_col), seed, F.col("replicate"))).withColumn(part, F.floor(F.col(place) / (MODULUS // ORDER_BUCKETS)).cast("int"))
    group = [*keys, "replicate"]
    counts = spread.groupBy(*group, part).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy(part))
    ends = counts.withColumn("upto", upto).groupBy(*group).agg(F.coalesce(F.min(F.when(F.col("upto") >= size, F.col(part))), F.lit(ORDER_BUCKETS)).alias(last)).alias("ends")
    same = reduce(Column.__and__, [F.col(f"spread.{k}").eqNullSafe(F.col(f"ends.{k}")) for k in group])
    near = spread.alias("spread").join(ends, same & (F.col(f"spread.{part}") <= F.col(f"ends.{last}"))).select("spread.*")
    ranked = near.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(place, id_col)))
    return ranked.filter(F.col(rank) <= size).drop(rank, place, part)


def thinned(rows: DataFrame, id_: Column, seed: int, share: float = 0.1) -> DataFrame:
    """About a share of the rows, by a seeded hash rather than a random number."""
    return rows.filter(seeded_order(id_, seed) <= share * MODULUS)

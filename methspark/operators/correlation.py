"""Locus-level correlation of two site tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_LOCI = 5


def covered(sites: DataFrame, min_cov: int) -> DataFrame:
    return sites.filter(F.col("pcov") + F.col("ncov") >= min_cov)


def with_frequency(sites: DataFrame) -> DataFrame:
    return sites.withColumn("f", F.col("pcov") / (F.col("pcov") + F.col("ncov")))


def paired(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("chrom", "soff", "context"), order: tuple[str, ...] = ("pcov", "ncov"), unique: bool = False) -> DataFrame:
    """``keys, fa, fb``: an inner join in which the n-th row of a key meets the other side's n-th, by ``order``.

    With ``unique`` keys the numbering, and its sort, is left out.
    """
    joined = list(keys)
    if not unique:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        nth = "nth"
        while nth in {c.lower() for c in (*a.columns, *b.columns)}:
            nth += "_"
        a, b, joined = a.withColumn(nth, number), b.withColumn(nth, number), [*keys, nth]
    one = with_frequency(a).select(*joined, F.col("f").alias("fa"))
    two = with_frequency(b).select(*joined, F.col("f").alias("fb"))
    return one.join(two, joined).select(*keys, "fa", "fb")


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r; 0 if a side doesn't vary."""
    spread = F.var_pop(x) * F.var_pop(y)
    return F.when((F.var_pop(x) == 0) | (F.var_pop(y) == 0), 0.0).otherwise(F.try_divide(F.covar_pop(x, y), F.sqrt(spread)))


def correlation(a: DataFrame, b: DataFrame, min_cov: int = 5, by: tuple[str, ...] = (), unique: bool = False) -> DataFrame:
    """``n_loci, r`` (by group): null with fewer than five loci. ``unique``: no site stands twice on a side, as with counted sites."""
    both = paired(covered(a, min_cov), covered(b, min_cov), unique=unique)
    n = F.count(F.lit(1))
    return both.groupBy(*by).agg(n.alias("n_loci"), F.when(n >= LEAST_LOCI, pearson(F.col("fa"), F.col("fb"))).alias("r"))

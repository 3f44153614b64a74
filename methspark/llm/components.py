"""Connected components of a link table, by hooking to the smallest neighbour and pointer jumping.

Nothing is collected: links and parents are tables, written to the shared folder after each round. A round
hooks every label to its smallest neighbouring label, jumps three times along the parents, and relabels the links; links
within a label go. Stars are done in one round, chains in a number of rounds that grows with the logarithm of their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

JUMPS = 3


def components(links: DataFrame) -> DataFrame:
    """``v, comp`` of every node of ``links`` (columns ``a``, ``b``); ``comp`` is the smallest node of the component."""
    left = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    labels = left.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("comp", F.col("v"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hooked = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        parents = hooked
        for _ in range(JUMPS):
            above = hooked.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            parents = parents.join(above, "up").select("node", F.col("upper").alias("up"))
        parents = written(parents, "parents")
        labels = labels.join(parents.select(F.col("node").alias("comp"), "up"), "comp", "left").select("v", F.coalesce("up", "comp").alias("comp"))
        for end in ("a", "b"):
            left = left.join(parents.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("up", end)
        left = written(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    return written(labels, "labels")

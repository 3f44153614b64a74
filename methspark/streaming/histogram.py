"""Site counts over streams of calls, with state that survives and scales.

The state is a count for each site, context and probability, which adds up in any order; the threshold needs the whole histogram,
so it is applied when the counts are read. Counts are kept by Spark's state store, in partitions on the executors (RocksDB, so they needn't fit
in memory) and in the checkpoint. Each batch writes the counts that changed to a folder of its own, ``batch=<number>``, which a repeated batch
replaces; the counts are each key's latest row. ``compacted`` folds the folders into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import pileup

COUNT_KEYS = ("chrom", "soff", "context", "scaled_prob", "primary")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def counts(obs: DataFrame) -> DataFrame:
    """Batch or streaming: the mergeable form of the observations."""
    return obs.groupBy(*COUNT_KEYS).agg(F.count(F.lit(1)).alias("n"))


def keep_counts(obs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """A running query that counts the streamed observations into ``target``; started anew with the same folders it goes on where it was.

    It takes what is there and ends.
    """
    spark = obs.sparkSession

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    held = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps the provider that it was started with
    try:
        writer = counts(obs).writeStream.outputMode("update").foreachBatch(put)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, held)


def stream_counts(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """``keep_counts`` of new Parquet files of a folder."""
    return keep_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder), target, checkpoint)


def read_counts(spark: SparkSession, target: str) -> DataFrame:
    """The counts so far: of each key the row of its last batch."""
    rows = spark.read.parquet(target)
    return rows.groupBy(*COUNT_KEYS).agg(F.max_by("n", "batch").alias("n"))


def compacted(spark: SparkSession, target: str, to: str) -> None:
    """The counts so far as one folder, ``batch=-1`` of ``to``; later batches of the query may go there."""
    read_counts(spark, target).write.mode("overwrite").parquet(f"{to}/batch=-1")


def sites_from_counts(counted: DataFrame) -> DataFrame:
    """The pileup of what the counts stand for."""
    hist = counted.filter("primary").groupBy("context", "scaled_prob").agg(F.sum("n").alias("n"))
    met = counted.join(F.broadcast(pileup.adaptive_threshold(hist)), "context")
    hit = F.col("scaled_prob") >= F.col("threshold")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return pileup.frequencies(met.groupBy("chrom", "soff", "context").agg(total(hit).alias("pcov"), total(~hit).alias("ncov")))

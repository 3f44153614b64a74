"""Genomic views derived from the star-schema tables, with integer and ``translate`` expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z in order, each mapped to the next of A, C, G, T.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGT" * 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_bases(text: Column) -> Column:
    """Letters as bases; everything else goes."""
    return F.regexp_replace(F.translate(text, LETTERS, BASES), "[^ACGT]", "")


def reads_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``read_id, seq`` from the documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), to_bases(F.col("text")).alias("seq"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chrom, seq`` from the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chrom"), to_bases(F.col("text")).alias("seq"))


def site_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per observed cytosine: ``chrom, soff, context, scaled_prob, mapq, primary, half``."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("chrom"),
        (F.col("l_partkey") % 40).alias("soff"),
        (F.col("l_linenumber") % 3).alias("context"),
        (F.floor(F.col("l_extendedprice") * 100) % 256).cast("int").alias("scaled_prob"),
        F.floor("l_quantity").cast("int").alias("mapq"),
        (F.col("l_returnflag") != "R").alias("primary"),
        (F.col("l_orderkey") % 2).alias("half"),
    )

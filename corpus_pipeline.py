"""The corpus pipeline: five stages over ``documents``, each the next one's input, written and read again between them.

1. ``language_id``: a document goes if its language can't be determined (no text, no letter) or only with a probability
   under 0.3.
2. ``exact_dedup``: of documents with the same text the one with the largest id stays.
3. ``ngram_join``: documents link at a Jaccard similarity of at least 0.8 over five-word shingles; of each connected group
   the one with the smallest id stays, and every document without a link.
4. ``decontaminate``: a document goes if it holds at least 0.8 of a benchmark item's five-word shingles.
5. ``mixing``: the sources' documents are taken to their target weights; the result has a row for each document left.

Stages 1 to 4 return the columns of their input. Null columns, repeated rows and empty tables: a null or empty text goes in the
first stage; a document without an id is judged like any other, and stays only if no other of its group has an id; rows that
repeat id and text stay once, and of rows with the same id each is judged by its own text. Further columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methspark.llm import decontaminate, exact_dedup, language_id, mixing, ngram_join
from methspark.llm.shared import written

#: The result of the language classifier has no SQL form.
ORACLE_SQL = None
#: Under this the text is as good as none: little over what one of four languages has by chance.
LEAST_PROBABILITY = 0.3
#: Rows that go to Python at a time.
BATCH_ROWS = 1000


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column has it."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _small_batches(spark: SparkSession) -> None:
    """Texts may be long, so fewer rows than usual go to Python at a time; this bounds the memory of executors, not the result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return language_id.accepted(docs, language_id.fit(docs), least=LEAST_PROBABILITY)


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = exact_dedup.exact_dedup(docs, keep="largest").filter("kept")
    digest, kept = _free(docs, "digest"), _free(docs, "kept")
    counted = judged.groupBy(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias(kept)).agg(F.count(F.lit(1)).alias("n"))
    keys = written(counted, "kept").alias("k")
    hashed = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).alias("d")
    met = hashed.join(keys, (F.col(digest) == F.col(kept)) & F.col("d.doc_id").eqNullSafe(F.col("k.id")), "left_semi")
    if keys.filter("n > 1").isEmpty():  # no row repeats both, so texts needn't move again
        return met.select(docs.columns)
    return met.dropDuplicates(["doc_id", digest]).select(docs.columns)


def _ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    row = _free(docs, "row")
    of = F.struct(F.col("doc_id").isNull().alias("unknown"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))
    named = docs.select(of.alias(row), "text")
    linked = ngram_join.ngram_components(named, id_col=row, n=5, num=4, den=5).filter(F.col(row) != F.col("component_id"))
    gone = written(linked.select(f"{row}.*").distinct(), "linked").alias("g")
    same = (F.coalesce("d.doc_id", F.lit(0)) == F.col("g.id")) & (F.col("d.doc_id").isNull() == F.col("g.unknown")) & (F.xxhash64("d.text") == F.col("g.text"))
    return docs.alias("d").join(gone, same, "left_anti").select(docs.columns)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", _language_id),
    ("exact_dedup", _exact_dedup),
    ("ngram_join", _ngram_join),
    ("decontaminate", _decontaminate),
    ("mixing", _mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs

"""The shared folder of a cluster, and tables written there to cut lineage.

Driver and executors share only the folder named in ``spark.checkpoint.dir``, so whatever one stage leaves for another
goes there. Where the setting is absent, a temporary folder is used if the session runs on one machine (as tests do), and it is an
error on a cluster.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_FOLDERS: set[str] = set()
_OWN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only if the setting is unset and all is on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="methspark-"))
    return _LOCAL[0]


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path that nobody else uses, in a folder of this process, which goes when the process ends."""
    folder = f"{shared_dir(spark)}/methspark/{_OWN}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, folder)
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def _remove(folder: str) -> None:
    with contextlib.suppress(OSError, pa.ArrowException):  # it may be out of reach by then
        system, local = fs.FileSystem.from_uri(folder) if ":" in folder.split("/", 1)[0] else (fs.LocalFileSystem(), folder)
        system.delete_dir(local)


def written(df: DataFrame, what: str, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and not lost with an executor.

    With columns ``by`` (the last ones), it has a folder for each of their values, and filters on them read no other.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path, partitionBy=list(by) or None)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space (space, 0x09-0x0D); empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, whatever the locale; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

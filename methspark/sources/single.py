"""One named file out of many parts, written by tasks: each part is copied to its own range of the file, planned from the parts' sizes.

The driver lists and adds up sizes and moves no rows. The target's file system has to allow writes at any place of a file, as local and mounted
shared folders do; other targets are an error. A copy that is made twice writes the same bytes to the same range.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import listed, open_input
from .tables import fresh_path

#: Bytes copied by a row of the plan.
PIECE = 64 << 20


def _local(path: str) -> str:
    """The path of a local or mounted file."""
    if ":" not in path.split("/", 1)[0]:
        return path
    system, local = fs.FileSystem.from_uri(path)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError(f"{path}: named files need a file system with writes at any place; write a folder instead")
    return local


def join_parts(spark: SparkSession, targets: dict[str, list[tuple[str, int]]]) -> None:
    """Every target as its parts (path and size), end to end; a target without parts becomes an empty file."""
    plan = []
    for target, parts in targets.items():
        at = 0
        for path, size in parts:
            plan += [(path, low, min(PIECE, size - low), _local(target), at + low) for low in range(0, size, PIECE)]
            at += size
        with open(_local(target), "wb") as out:
            out.truncate(at)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, low, n, target, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_input(path) as source:
                    source.seek(low)
                    out = os.open(target, os.O_WRONLY)
                    try:
                        while n:
                            data = source.read(min(n, 4 << 20))
                            if not data:
                                raise ValueError(f"{path} is shorter than planned")
                            os.pwrite(out, data, at)
                            n, at = n - len(data), at + len(data)
                    finally:
                        os.close(out)
            yield batch.select(["at"])

    if plan:
        rows = spark.createDataFrame(plan, "path string, low long, n long, target string, at long")
        rows.repartition(min(len(plan), 10_000)).mapInArrow(copy, "at long").agg(F.count("at")).collect()


def write_named(lines: DataFrame, prefix: str, names: list[str], order: list) -> None:
    """Lines (``file, value`` and the columns of ``order``) as the files ``prefix + name``, each in the given order; a name without lines becomes an empty file."""
    spark = lines.sparkSession
    folder = fresh_path(spark, "parts")
    # one global sort: the number of a part tells its place, within each file's folder
    lines.orderBy("file", *order).select("file", "value").write.partitionBy("file").text(folder)
    known = set(names)
    targets: dict[str, list[tuple[str, int]]] = {f"{prefix}{n}": [] for n in names}
    system, local = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    for info in system.get_file_info(fs.FileSelector(local)):
        if info.type == fs.FileType.Directory:
            name = unquote(info.base_name.removeprefix("file="))
            if name not in known:
                raise ValueError(f"no file was named {name!r}")
            parts = listed(f"{folder}/{info.base_name}", ".txt")
            sizes = system.get_file_info([f"{local}/{info.base_name}/{p.rsplit('/', 1)[1]}" for p in parts])
            targets[f"{prefix}{name}"] = [(p, s.size) for p, s in zip(parts, sizes, strict=True)]
    join_parts(spark, targets)

"""The training layout: a file of fixed-size records of reads, a table of their places, and samples that name a read and a base of it.

``features`` holds five bytes a base, read by read and plane by plane: bases (A, C, G, T as 0-3, others 4), then interval and width codes of the base's own
strand, then those of the other strand, all in order of the bases. ``offsets`` has lines of place (in bases), read id, size, and passes of either strand;
samples have lines of read id, base and label.

Reads are found by ranges of the offset table: samples, which are small, are brought to their read's line, the lines are dealt out by place, and a task
reads its stretch of the file in order and cuts the windows there. No bases are exchanged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinetics import FEATURES_PER_BASE, MOST_FRAMES, decode_array
from ..functions.motifs import OTHER, C, G, codes
from .files import make_folder, open_input, open_output
from .single import join_parts, write_named
from .tables import fresh_path, written

PLANES = 5
#: Windows that leave a task together.
AT_ONCE = 4096
KINETICS = ("fi", "fp", "ri", "rp")


def write_blob(reads: DataFrame, folder: str) -> None:
    """``features`` and ``offsets`` of reads ``read_id, seq, fi, fp, ri, rp`` (8-bit codes; the other strand's run from the read's end) and, if there, ``fn, rn``.

    Reads are in order of their ids, which are unique; those without whole kinetics are left out.
    """
    spark = reads.sparkSession
    parts = fresh_path(spark, "features")
    passes = [F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) if c in reads.columns else F.lit(0).alias(c) for c in ("fn", "rn")]
    whole = F.lit(True)
    for k in KINETICS:
        whole = whole & F.coalesce(F.size(k) == F.length("seq"), F.lit(False))
    rows = reads.filter(whole).select(F.col("read_id").cast("long").alias("read_id"), "seq", *KINETICS, *passes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, at = f"{parts}/{uuid.uuid4().hex}", 0  # of this attempt alone
        make_folder(parts)
        with open_output(path) as out:
            for batch in batches:
                places, sizes = [], []
                lists = [batch.column(k) for k in range(2, 6)]
                spans = [(x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)) for x in lists]
                for k, seq in enumerate(batch.column(1)):
                    seq = seq.as_py()
                    fi, fp, ri, rp = (values[offsets[k] : offsets[k + 1]] for offsets, values in spans)
                    out.write(np.concatenate([codes(seq), fi, fp, ri[::-1], rp[::-1]]).astype(np.uint8).tobytes())
                    places.append(at)
                    sizes.append(len(seq))
                    at += len(seq)
                columns = [pa.array([path] * len(sizes)), pa.array(places, type=pa.int64()), batch.column(0), pa.array(sizes, type=pa.int32()), batch.column(6), batch.column(7)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "at", "id", "size", "fn", "rn"])

    ordered = rows.repartitionByRange("read_id").sortWithinPartitions("read_id")
    lines = written(ordered.mapInArrow(write, "part string, at long, id long, size int, fn int, rn int"), "offsets")
    own = lines.groupBy("part").agg(F.min("id").alias("first"), F.sum("size").alias("n")).orderBy("first").collect()  # one row a partition
    base = np.concatenate([[0], np.cumsum([r["n"] for r in own])]).astype(int).tolist()
    make_folder(folder)
    join_parts(spark, {f"{folder}/features": [(r["part"], PLANES * r["n"]) for r in own if r["n"]]})
    begins = spark.createDataFrame([(r["part"], b) for r, b in zip(own, base, strict=False)], "part string, base long")
    placed = lines.join(F.broadcast(begins), "part").withColumn("offset", F.col("at") + F.col("base"))
    text = placed.select(F.lit("offsets").alias("file"), F.concat_ws("\t", "offset", "id", "size", "fn", "rn").alias("value"), "offset", "id")
    write_named(text, f"{folder}/", ["offsets"], ["offset", "id"])


def read_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """``offset, id, size, fn, rn``."""
    return spark.read.csv(f"{folder}/offsets", sep="\t", schema="offset long, id long, size int, fn int, rn int")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """``id, qoff, label`` of lines with these fields between white space."""
    fields = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return spark.read.text(path).filter("trim(value) != ''").select(F.get(fields, F.lit(0)).cast("long").alias("id"), F.get(fields, F.lit(1)).cast("int").alias("qoff"), F.get(fields, F.lit(2)).cast("int").alias("label"))


def _oriented(planes: np.ndarray, at: np.ndarray, kmer: int) -> np.ndarray:
    """(samples, 5, kmer) bytes around each base, as the strand of its cytosine runs; beyond the read no base and zeros."""
    half, n = kmer // 2, planes.shape[1]
    padded = np.zeros((PLANES, n + 2 * half), dtype=np.uint8)
    padded[0] = OTHER
    padded[:, half : half + n] = planes
    out = padded[:, at[:, None] + np.arange(kmer)].transpose(1, 0, 2).copy()
    turned = planes[0, at] == G
    other = out[turned][:, [0, 3, 4, 1, 2], ::-1]
    other[:, 0] = np.where(other[:, 0] < OTHER, 3 - other[:, 0], OTHER)
    out[turned] = other
    return out


def training_windows(spark: SparkSession, folder: str, samples: DataFrame, kmer: int) -> DataFrame:
    """``id, qoff, label, window`` of samples ``id, qoff, label`` on the reads of a folder: 5 x ``kmer`` bytes each, with label 0 or 1.

    A sample whose base is neither C nor G, or lies outside its read, is an error, and so is one whose read is unknown.
    """
    if kmer % 2 == 0:
        raise ValueError("windows have an odd number of bases")
    wanted = samples.groupBy("id").agg(F.collect_list(F.struct("qoff", (F.col("label") > 0).cast("int").alias("label"))).alias("samples"))
    unknown = F.raise_error(F.concat(F.lit("no read "), F.col("id").cast("string"))).cast("long")
    met = wanted.join(read_offsets(spark, folder), "id", "left").withColumn("offset", F.when(F.col("offset").isNull(), unknown).otherwise(F.col("offset")))
    dealt = met.repartitionByRange("offset").sortWithinPartitions("offset").select("offset", "id", "size", "samples")
    path = f"{folder}/features"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_input(path) as f:
            for batch in batches:
                for offset, name, size, own in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                    f.seek(PLANES * offset)
                    data = f.read(PLANES * size)
                    if len(data) < PLANES * size:
                        raise ValueError(f"{path} ends within read {name}")
                    planes = np.frombuffer(data, dtype=np.uint8).reshape(PLANES, size)
                    at, labels = (own.values.field(k).to_numpy() for k in range(2))
                    if len(at) and (at.min() < 0 or at.max() >= size or not np.isin(planes[0, at], (C, G)).all()):
                        raise ValueError(f"a sample of read {name} is no C or G")
                    for low in range(0, len(at), AT_ONCE):
                        part = _oriented(planes, at[low : low + AT_ONCE], kmer)
                        n = len(part)
                        windows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PLANES * kmer), n, [None, pa.py_buffer(np.ascontiguousarray(part))]).cast(pa.binary())
                        columns = [pa.array([name] * n, type=pa.int64()), pa.array(at[low : low + AT_ONCE], type=pa.int32()), pa.array(labels[low : low + AT_ONCE], type=pa.int32()), windows]
                        yield pa.RecordBatch.from_arrays(columns, names=["id", "qoff", "label", "window"])

    return dealt.mapInArrow(cut, "id long, qoff int, label int, window binary")


def expanded(windows: np.ndarray, kmer: int) -> np.ndarray:
    """(samples, kmer, 8) floats of windows as bytes: one-hot bases, and normalised frames of the own and the other strand."""
    planes = windows.reshape(-1, PLANES, kmer)
    out = np.zeros((len(planes), kmer, FEATURES_PER_BASE), dtype=np.float32)
    out[:, :, :4] = np.eye(5, 4, dtype=np.float32)[planes[:, 0]]
    frames = decode_array(np.arange(256)).astype(np.float32) / np.float32(MOST_FRAMES)
    for k in range(4):
        out[:, :, 4 + k] = frames[planes[:, 1 + k]]
    return out

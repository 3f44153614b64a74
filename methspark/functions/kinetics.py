"""Polymerase kinetics: the 8-bit frame codec, normalisation and k-mer feature windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .motifs import CONTEXTS, chosen_contexts, codes, site_masks

#: Largest frame count that the codec can hold (fixed value).
MOST_FRAMES = 952
FEATURES_PER_BASE = 8


def decode_frames(code: Column) -> Column:
    """Frames of an 8-bit code: steps of 1, 2, 4 and 8 in quarters of the code range."""
    return F.when(code < 64, code).when(code < 128, (code - 64) * 2 + 64).when(code < 192, (code - 128) * 4 + 192).otherwise((code - 192) * 8 + 448)


def encode_frames(frames: Column) -> Column:
    """The 8-bit code of a frame count, rounded down; beyond the range it is the last."""
    f = F.least(frames, F.lit(MOST_FRAMES))
    step = lambda base, code, width: (F.floor((f - base) / width) + code).cast("int")
    return F.when(f < 64, f.cast("int")).when(f < 192, step(64, 64, 2)).when(f < 448, step(192, 128, 4)).otherwise(step(448, 192, 8))


def normalised(frames: Column) -> Column:
    return frames / MOST_FRAMES


def decode_array(codes_: np.ndarray) -> np.ndarray:
    """The same codec over arrays."""
    quarter = np.minimum(codes_.astype(np.int64) // 64, 3)
    return (codes_ - 64 * quarter) * (1 << quarter) + np.array([0, 64, 192, 448])[quarter]


def encode_array(frames: np.ndarray) -> np.ndarray:
    f = np.minimum(frames.astype(np.int64), MOST_FRAMES)
    quarter = np.searchsorted(np.array([64, 192, 448]), f, side="right")
    return (f - np.array([0, 64, 192, 448])[quarter]) // (1 << quarter) + 64 * quarter


def has_kinetics(seq: Column, *arrays: Column) -> Column:
    """All arrays are there and as long as the read."""
    out = F.lit(True)
    for a in arrays:
        out = out & F.coalesce(F.size(a) == F.length(seq), F.lit(False))
    return out


def base_features(seq: str, fi: np.ndarray, fp: np.ndarray, ri: np.ndarray, rp: np.ndarray) -> np.ndarray:
    """Per base: one-hot A, C, G, T (none for other letters), then normalised interval and width of its strand and of the other.

    The other strand's arrays run from the read's end.
    """
    c, n = codes(seq), len(seq)
    out = np.zeros((n, FEATURES_PER_BASE), dtype=np.float32)
    known = np.flatnonzero(c < 4)
    out[known, c[known]] = 1
    for k, a in enumerate((fi, fp, ri[::-1], rp[::-1])):
        out[:, 4 + k] = a / np.float32(MOST_FRAMES)
    return out


def windows(features: np.ndarray, sites: np.ndarray, kmer: int) -> np.ndarray:
    """(sites, kmer, features) around each site, zero beyond the read's ends."""
    half = kmer // 2
    padded = np.concatenate([np.zeros((half, features.shape[1]), np.float32), features, np.zeros((kmer, features.shape[1]), np.float32)])
    return padded[sites[:, None] + np.arange(kmer)[None, :]]


def read_features(row: dict) -> np.ndarray:
    """``base_features`` of a read row; its arrays are frames."""
    return base_features(row["seq"], *[np.asarray(row[k], dtype=np.float32) for k in ("fi", "fp", "ri", "rp")])


#: The four arrays of a read (fi, fp, ri, rp), made from its number and length.
Frames = Callable[[int, int], list[np.ndarray]]


def reads_of(batch: pa.RecordBatch, frames: Frames | None = None) -> Iterator[tuple[int, str, list[np.ndarray]]]:
    """Number, bases and the four arrays of each read of ``read_id, seq, fi, fp, ri, rp``; the arrays are slices of the batch's own values, or made by ``frames``."""
    if frames is not None:
        for k, (read_id, seq) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
            bases = seq.as_py()
            yield k, bases, frames(read_id.as_py(), len(bases))
        return
    lists = [batch.column(k) for k in range(2, 6)]
    spans = [(x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)) for x in lists]
    for k, seq in enumerate(batch.column(1)):
        yield k, seq.as_py(), [values[offsets[k] : offsets[k + 1]] for offsets, values in spans]


def kinetic_columns(reads: DataFrame, frames: Frames | None = None) -> DataFrame:
    """What ``reads_of`` needs of the reads with whole kinetics; with ``frames`` all that have bases."""
    if frames is not None:
        return reads.filter("seq is not null").select("read_id", "seq")
    ready = reads.filter(has_kinetics(F.col("seq"), *[F.col(k) for k in ("fi", "fp", "ri", "rp")]))
    return ready.select("read_id", "seq", "fi", "fp", "ri", "rp")


def context_sites(seq: str, context: str) -> np.ndarray:
    """The context's sites in order; CHH sites of the other strand lie at their G."""
    return np.sort(np.concatenate([starts + shift for name, _, shift, starts in site_masks(codes(seq)) if name == context]))


#: Values of features that leave a pass together.
VALUES_AT_ONCE = 1 << 21


def kmer_features(reads: DataFrame, kmer: int = 21, context: str = "CpG") -> DataFrame:
    """``read_id, qoff, features`` (kmer x 8 floats) for the context's sites of reads with ``seq, fi, fp, ri, rp`` (frames).

    CHH sites of the other strand lie at their G, with the window as the read runs.
    """
    (context,) = chosen_contexts((context,))
    kind, width = reads.schema["read_id"].dataType.simpleString(), kmer * FEATURES_PER_BASE

    def packed(batch: pa.RecordBatch, rows: list[np.ndarray], sites: list[np.ndarray], flat: list[np.ndarray]) -> pa.RecordBatch:
        at, values = pa.array(np.concatenate(rows)), np.concatenate(flat)
        offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * width)
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate(sites).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["read_id", "qoff", "features"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sites, flat, held = [], [], [], 0
            for k, seq, arrays in reads_of(batch):
                at = context_sites(seq, context)
                features = base_features(seq, *arrays) if len(at) else None
                for low in range(0, len(at), VALUES_AT_ONCE // width + 1):
                    part = at[low : low + VALUES_AT_ONCE // width + 1]
                    rows.append(np.full(len(part), k))
                    sites.append(part)
                    flat.append(windows(features, part, kmer).reshape(-1))
                    held += len(flat[-1])
                    if held >= VALUES_AT_ONCE:
                        yield packed(batch, rows, sites, flat)
                        rows, sites, flat, held = [], [], [], 0
            if held:
                yield packed(batch, rows, sites, flat)

    return kinetic_columns(reads).mapInArrow(run, f"read_id {kind}, qoff int, features array<float>")


def window_sums(features: DataFrame, kmer: int = 21) -> DataFrame:
    """``read_id, qoff, sums``: the windows of ``kmer_features`` summed over their bases, a value for each feature of a base."""
    kind = features.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            sums = flat.reshape(len(batch), kmer, FEATURES_PER_BASE).sum(axis=1, dtype=np.float64)
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * FEATURES_PER_BASE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], names=["read_id", "qoff", "sums"])

    return features.select("read_id", "qoff", "features").mapInArrow(run, f"read_id {kind}, qoff int, sums array<double>")


#: Sites of a pass that leave it together.
SITES_AT_ONCE = 1 << 16
_SUMS = ("a", "c", "g", "t", "fi", "fp", "ri", "rp")


def site_sums(reads: DataFrame, kmer: int = 21, contexts: tuple[str, ...] = CONTEXTS, frames: Frames | None = None) -> DataFrame:
    """``read_id, qoff, context, a, c, g, t, fi, fp, ri, rp``: what the windows of ``kmer_features`` hold, summed over their bases, with frames as whole numbers.

    All contexts are found in one pass, and a window's sum is the difference of two running sums along the read, so no window is made. ``frames`` makes the
    arrays of reads that come without them.
    """
    contexts, half = chosen_contexts(contexts), kmer // 2
    kind = reads.schema["read_id"].dataType.simpleString()

    def packed(batch: pa.RecordBatch, found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows = pa.array(np.repeat([k for k, *_ in found], [len(at) for _, at, *_ in found]))
        names = pa.array(CONTEXTS).take(pa.array(np.concatenate([x for *_, x, _ in found])))
        sums = np.concatenate([x for *_, x in found], axis=1).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.concatenate([at for _, at, *_ in found]).astype(np.int32)), names, *map(pa.array, sums)], names=["read_id", "qoff", "context", *_SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for k, seq, arrays in reads_of(batch, frames):
                c = codes(seq)
                masks = [(CONTEXTS.index(name), starts + shift) for name, _, shift, starts in site_masks(c) if name in contexts]
                at = np.concatenate([x for _, x in masks])
                if not len(at):
                    continue
                running = np.zeros((len(_SUMS), len(c) + 1), dtype=np.int64)
                running[:4, 1:] = c == np.arange(4)[:, None]
                fi, fp, ri, rp = arrays
                running[4:, 1:] = fi, fp, ri[::-1], rp[::-1]
                np.cumsum(running, axis=1, out=running)
                context = np.repeat([n for n, _ in masks], [len(x) for _, x in masks])
                for low in range(0, len(at), SITES_AT_ONCE):
                    part = at[low : low + SITES_AT_ONCE]
                    first = np.maximum(part - half, 0)
                    found.append((k, part, context[low : low + SITES_AT_ONCE], running[:, np.minimum(part - half + kmer, len(c))] - running[:, first]))
                    held += len(part)
                    if held >= SITES_AT_ONCE:
                        yield packed(batch, found)
                        found, held = [], 0
            if held:
                yield packed(batch, found)

    return kinetic_columns(reads, frames).mapInArrow(run, f"read_id {kind}, qoff int, context string, " + ", ".join(f"{c} int" for c in _SUMS))

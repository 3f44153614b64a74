"""Scoring sites with a pluggable batch model: features in, an 8-bit methylation probability out."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinetics import FEATURES_PER_BASE, Frames, base_features, context_sites, decode_array, has_kinetics, kinetic_columns, read_features, reads_of, windows
from ..sources.files import open_input, open_output
from . import mods

BATCH = 4096
#: Places of a layer computed together, so that their inputs stay in a core's cache.
ROWS_AT_ONCE = 1024
MIN_READ_LENGTH = 1000
_KINETICS = ("fi", "fp", "ri", "rp")


class SiteScorer(Protocol):
    """A model of one context; ``score`` gets (n, kmer, 8) floats and gives (n, 2) logits.

    A scorer may have ``score_read`` as well, which gives the logits of a read's sites from the features of the whole read.
    """

    context: str
    kmer: int

    def score(self, features: np.ndarray) -> np.ndarray: ...


class LinearScorer:
    """A seeded linear model, to run the pipeline where no trained model is at hand; its calls mean nothing biologically."""

    def __init__(self, context: str = "CpG", kmer: int = 21, seed: int = 1):
        self.context, self.kmer = context, kmer
        self.weights = np.random.default_rng(seed).normal(0, 0.5, (kmer * FEATURES_PER_BASE, 2)).astype(np.float32)

    def score(self, features: np.ndarray) -> np.ndarray:
        # doubles, so that sums in any order give the same eight bits
        return features.reshape(len(features), -1).astype(np.float64) @ self.weights.astype(np.float64)


class ConvScorer:
    """A network of strided convolutions, each normalised and rectified, and two dense layers, in numpy.

    ``parameters`` (see ``load``) holds ``norm0`` for the input's channels, ``conv1`` (filters, channels, width) and ``norm1`` and so on, then
    ``dense1``, ``bias1``, ``dense2``, ``bias2``; a norm is four rows: mean, variance, factor and offset.
    """

    #: Filters and widths of the trained models' layers, their stride and padding, and what is added to variances (fixed values).
    FILTERS = (128, 128, 128, 96, 96, 96, 64, 64)
    WIDTHS = (13, 3, 3, 3, 3, 3, 3, 3)
    STRIDE, PADDING, EPSILON, DENSE = 2, 1, 1e-5, 256

    def __init__(self, context: str, kmer: int, parameters: dict[str, np.ndarray]):
        self.context, self.kmer = context, kmer
        self.parameters = {k: np.asarray(v, dtype=np.float32) for k, v in parameters.items()}
        self._layers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if self.parameters["dense1"].shape[1] != self.flat_size(kmer, self.parameters):
            raise ValueError(f"the parameters don't fit windows of {kmer} bases")

    @classmethod
    def flat_size(cls, kmer: int, parameters: dict[str, np.ndarray]) -> int:
        n = kmer
        for k in range(1, 1 + sum(name.startswith("conv") for name in parameters)):
            n = (n + 2 * cls.PADDING - parameters[f"conv{k}"].shape[2]) // cls.STRIDE + 1
        return n * parameters[f"conv{k}"].shape[0]

    @classmethod
    def load(cls, context: str, kmer: int, path: str) -> ConvScorer:
        """From a file of numpy arrays (npz) or an ONNX model, by path or URI."""
        import io

        from ..sources import onnx_file

        with open_input(path) as f:
            data = f.read()
        if data[:2] == b"PK":
            return cls(context, kmer, dict(np.load(io.BytesIO(data), allow_pickle=False)))
        parameters, said = onnx_file.read_parameters(data)
        if said not in (None, kmer):
            raise ValueError(f"{path}: a model for windows of {said} bases, not {kmer}")
        return cls(context, kmer, parameters)

    def save(self, path: str) -> None:
        """As an ONNX model, by path or URI."""
        from ..sources import onnx_file

        with open_output(path) as f:
            f.write(onnx_file.model_bytes(self.parameters, self.kmer))

    @classmethod
    def untrained(cls, context: str, kmer: int, seed: int = 1) -> ConvScorer:
        """Random parameters of the trained models' shape, for tests and timings; its calls mean nothing."""
        r = np.random.default_rng(seed)
        norm = lambda n: np.stack([r.normal(0, 0.1, n), r.uniform(0.5, 1.5, n), r.uniform(0.5, 1.5, n), r.normal(0, 0.1, n)])
        channels, out = FEATURES_PER_BASE, {"norm0": norm(FEATURES_PER_BASE)}
        for k, (filters, width) in enumerate(zip(cls.FILTERS, cls.WIDTHS, strict=True), 1):
            out[f"conv{k}"], out[f"norm{k}"] = r.normal(0, 1.5 / np.sqrt(channels * width), (filters, channels, width)), norm(filters)
            channels = filters
        size = cls.flat_size(kmer, out)
        return cls(context, kmer, out | {"dense1": r.normal(0, 1.5 / np.sqrt(size), (cls.DENSE, size)), "bias1": r.normal(0, 0.1, cls.DENSE), "dense2": r.normal(0, 0.1, (2, cls.DENSE)), "bias2": np.zeros(2)})

    def _normed(self, x: np.ndarray, k: int) -> np.ndarray:
        mean, variance, factor, offset = self.parameters[f"norm{k}"]
        return (x - mean) * (factor / np.sqrt(variance + np.float32(self.EPSILON))) + offset

    def score(self, features: np.ndarray) -> np.ndarray:
        x, k = self._normed(features.astype(np.float32), 0), 1  # (sites, bases, channels)
        while (kernel := self.parameters.get(f"conv{k}")) is not None:
            padded = np.pad(x, ((0, 0), (self.PADDING, self.PADDING), (0, 0)))
            seen = np.lib.stride_tricks.sliding_window_view(padded, kernel.shape[2], axis=1)[:, :: self.STRIDE]
            x = np.maximum(self._normed(np.tensordot(seen, kernel, axes=((2, 3), (1, 2))), k), 0)
            k += 1
        return self._dense(x.transpose(0, 2, 1).reshape(len(x), -1))

    def _dense(self, flat: np.ndarray) -> np.ndarray:
        hidden = np.maximum(flat @ self.parameters["dense1"].T + self.parameters["bias1"], 0)
        return hidden @ self.parameters["dense2"].T + self.parameters["bias2"]


    def _layer(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The weights of a convolution, (width * channels, filters), and its offsets, with the norm behind it folded in."""
        if k not in self._layers:
            mean, variance, factor, offset = self.parameters[f"norm{k}"]
            scale = factor / np.sqrt(variance + np.float32(self.EPSILON))
            kernel = (self.parameters[f"conv{k}"] * scale[:, None, None]).transpose(2, 1, 0)
            self._layers[k] = np.ascontiguousarray(kernel.reshape(-1, kernel.shape[2])), offset - mean * scale
        return self._layers[k]

    def score_read(self, features: np.ndarray, sites: np.ndarray) -> np.ndarray:
        """The logits of ``score`` for the windows around the sites of a read, with what overlapping windows share computed once.

        Output j of layer k in a window that starts at base w depends on the bases around w + 2^k j alone, unless padding at the window's ends
        reaches it: those few outputs (``edges``) are made for each site, all others once for each base that a window needs.
        """
        first = sites - self.kmer // 2
        low = int(first.min())
        first = first - low
        span = int(first.max()) + self.kmer
        x = np.zeros((span, features.shape[1]), dtype=np.float32)  # zero beyond the read's ends
        a, b = max(low, 0), min(low + span, len(features))
        x[a - low : b - low] = features[a:b]
        x, row_of, edges, n, step, k = self._normed(x, 0), np.arange(span), {}, self.kmer, 1, 1
        while f"conv{k}" in self.parameters:
            width, channels = self.parameters[f"conv{k}"].shape[2], x.shape[1]
            weights, shift = self._layer(k)
            n_out = (n + 2 * self.PADDING - width) // self.STRIDE + 1
            taps = {j: range(self.STRIDE * j - self.PADDING, self.STRIDE * j - self.PADDING + width) for j in range(n_out)}
            own = [j for j, t in taps.items() if t[0] < 0 or t[-1] >= n or any(i in edges for i in t)]
            shared = np.array([j for j in taps if j not in own], dtype=np.int64)
            needed = np.zeros(span, dtype=bool)
            needed[first[:, None] + self.STRIDE * step * shared] = True
            at = np.flatnonzero(needed)
            out = np.empty((len(at), weights.shape[1]), dtype=np.float32)
            reach = step * (np.arange(width) - self.PADDING)
            # the first layer's taps lie side by side
            runs = np.lib.stride_tricks.sliding_window_view(x.reshape(-1), width * channels)[::channels] if k == 1 else None
            for i in range(0, len(at), ROWS_AT_ONCE):
                part = out[i : i + ROWS_AT_ONCE]
                place = at[i : i + ROWS_AT_ONCE]
                values = runs[place + reach[0]] if runs is not None else x[row_of[place[:, None] + reach]].reshape(len(part), -1)
                np.matmul(values, weights, out=part)
                part += shift
                np.maximum(part, 0, out=part)
            made = {}
            for j in own:
                inside = [(m, i) for m, i in enumerate(taps[j]) if 0 <= i < n]
                values = np.concatenate([edges[i] if i in edges else x[row_of[first + step * i]] for _, i in inside], axis=1)
                made[j] = np.maximum(values @ weights[inside[0][0] * channels : (inside[-1][0] + 1) * channels] + shift, 0)
            row_of = np.zeros(span, dtype=np.int64)
            row_of[at] = np.arange(len(at))
            x, edges, n, step, k = out, made, n_out, self.STRIDE * step, k + 1
        last = [edges[j] if j in edges else x[row_of[first + step * j]] for j in range(n)]
        return self._dense(np.stack(last, axis=2).reshape(len(sites), -1))


class OnnxScorer:
    """A model file with one input (batch, kmer, 8), both last static; the session opens on first use in each worker."""

    def __init__(self, context: str, path: str, kmer: int):
        self.context, self.path, self.kmer, self._session = context, path, kmer, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None}

    def score(self, features: np.ndarray) -> np.ndarray:
        if self._session is None:
            import onnxruntime

            self._session = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
            shape = self._session.get_inputs()[0].shape
            if len(shape) != 3 or list(shape[1:]) != [self.kmer, FEATURES_PER_BASE]:
                raise ValueError(f"{self.path}: expected (batch, {self.kmer}, {FEATURES_PER_BASE}), not {shape}")
        return self._session.run(None, {self._session.get_inputs()[0].name: features.astype(np.float32)})[0]


def _logits(scorer: SiteScorer, features: np.ndarray, sites: np.ndarray) -> np.ndarray:
    """Of some sites of a read: by ``score_read`` if the scorer has it, else window by window."""
    shared = getattr(scorer, "score_read", None)
    return shared(features, sites) if shared else scorer.score(windows(features, sites, scorer.kmer))


def quantised(logits: np.ndarray) -> np.ndarray:
    """Softmax of two logits to 0..255, rounded down."""
    p = 1 / (1 + np.exp(np.clip(logits[:, 0].astype(np.float64) - logits[:, 1], -700, 700)))
    return np.minimum(255, np.floor(255 * p)).astype(np.int32)


def quantised_column(z0: Column, z1: Column) -> Column:
    return F.least(F.lit(255), F.floor(255 / (1 + F.exp(z0 - z1)))).cast("int")


def long_enough(reads: DataFrame, min_length: int = MIN_READ_LENGTH) -> DataFrame:
    return reads.filter(F.length("seq") >= min_length)


def scorable(reads: DataFrame, min_length: int = MIN_READ_LENGTH) -> DataFrame:
    """Reads long enough, with whole kinetics; the others pass through a run uncalled."""
    return long_enough(reads, min_length).filter(has_kinetics(F.col("seq"), *[F.col(k) for k in _KINETICS]))


def score_sites(features: DataFrame, scorer: SiteScorer, batch: int = BATCH) -> DataFrame:
    """``read_id, qoff, context, scaled_prob`` of rows ``read_id, qoff, features``."""
    size = scorer.kmer * FEATURES_PER_BASE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), batch):
                part = whole.slice(low, batch)
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(part), scorer.kmer, size // scorer.kmer)
                p = quantised(scorer.score(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([scorer.context] * len(part)), pa.array(p)], names=["read_id", "qoff", "context", "scaled_prob"])

    kind = features.schema["read_id"].dataType.simpleString()
    return features.select("read_id", "qoff", "features").mapInArrow(run, f"read_id {kind}, qoff int, context string, scaled_prob int")


def call_sites(reads: DataFrame, scorers: list[SiteScorer], batch: int = BATCH, frames: Frames | None = None) -> DataFrame:
    """``read_id, qoff, context, scaled_prob`` of the sites of every scorer's context, in one pass over ``read_id, seq, fi, fp, ri, rp``.

    Features are made and scored in the same task, a batch of sites at a time, so only the calls leave it. ``frames`` makes the arrays of reads that
    come without them.
    """
    kind = reads.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows, sites, names, probabilities = [], [], [], []
            for k, seq, arrays in reads_of(whole, frames):
                features = base_features(seq, *arrays)
                for scorer in scorers:
                    at = context_sites(seq, scorer.context)
                    for low in range(0, len(at), batch):
                        part = at[low : low + batch]
                        probabilities.append(quantised(_logits(scorer, features, part)))
                    rows.append(np.full(len(at), k))
                    sites.append(at)
                    names += [scorer.context] * len(at)
            join = lambda parts, to: pa.array(np.concatenate([*parts, np.zeros(0, dtype=np.int64)]).astype(to))
            yield pa.RecordBatch.from_arrays([whole.column(0).take(join(rows, np.int64)), join(sites, np.int32), pa.array(names, type=pa.string()), join(probabilities, np.int32)], names=["read_id", "qoff", "context", "scaled_prob"])

    return kinetic_columns(reads, frames).mapInArrow(run, f"read_id {kind}, qoff int, context string, scaled_prob int")


def tag_reads(reads: DataFrame, scorers: list[SiteScorer], seq_col: str = "seq", min_length: int = MIN_READ_LENGTH, batch: int = BATCH) -> DataFrame:
    """``reads`` with ``mm, ml, mn`` of the calls of all scorers, made, scored and encoded in one pass, and with ``n_<context>``, their numbers.

    Kinetics are decoded first where ``kinetics_encoded`` says so. Reads that are too short or without whole kinetics stay, without tags.
    """
    packed = ("kinetics_encoded",) if "kinetics_encoded" in reads.columns else ()

    def call(row: dict) -> tuple[np.ndarray, np.ndarray, list[int]]:
        none = np.zeros(0, dtype=np.int64)
        if len(row["seq"]) < max(1, min_length) or any(len(row[k] or ()) != len(row["seq"]) for k in _KINETICS):
            return none, none, [0] * len(scorers)
        if row.get("kinetics_encoded"):
            row = row | {k: decode_array(np.asarray(row[k])) for k in _KINETICS}
        features, sites, probabilities = read_features(row), [none], [none]
        for scorer in scorers:
            at = context_sites(row["seq"], scorer.context)
            sites.append(at)
            probabilities += [quantised(_logits(scorer, features, at[low : low + batch])) for low in range(0, len(at), batch)]
        at, p = np.concatenate(sites), np.concatenate(probabilities)
        order = np.argsort(at, kind="stable")
        return at[order], p[order], [len(x) for x in sites[1:]]

    return mods.tag_reads(reads, call, (*_KINETICS, *packed), seq_col, tuple(f"n_{s.context}" for s in scorers))

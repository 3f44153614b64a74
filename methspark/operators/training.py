"""Training of the call network: back-propagation in tasks, gradients summed over partitions, Nesterov steps on the driver.

A step's samples form micro-batches by a seeded hash of their read and base, so neither the samples of a micro-batch nor the order of steps depends on partitions.
Each micro-batch is normalised by its own statistics and gives the gradient of its mean loss; a task adds up those of its micro-batches, and their sum, weighted
by samples, moves the parameters. What travels is one set of sums a task, added up in a tree, never samples; results differ between
partitionings by rounding alone. An epoch's samples are written once in order of their steps, so a step reads its own.

The learning rate, its decay, momentum and weight decay are those of the trained models (fixed values).
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from ..sources.training import expanded
from .scoring import ConvScorer

LEARNING_RATE, DECAY, MOMENTUM, WEIGHT_DECAY = 0.1, 0.2, 0.9, 1e-5
#: Share of a step's statistics in the running ones.
RUNNING = 0.1
#: Sums that the driver adds up; more are added up in tasks first.
MOST_SUMS = 16


def _norm_forward(x: np.ndarray, norm: np.ndarray, epsilon: float) -> tuple[np.ndarray, tuple, np.ndarray, np.ndarray]:
    """Normalised by the batch's own statistics over samples and places."""
    mean, variance = x.mean(axis=(0, 1)), x.var(axis=(0, 1))
    spread = 1 / np.sqrt(variance + epsilon)
    centred = (x - mean) * spread
    return centred * norm[2] + norm[3], (centred, spread, norm[2]), mean, variance


def _norm_backward(d: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centred, spread, factor = kept
    d_factor, d_offset = (d * centred).sum(axis=(0, 1)), d.sum(axis=(0, 1))
    n = d.shape[0] * d.shape[1]
    return factor * spread * (d - d_offset / n - centred * d_factor / n), d_factor, d_offset


def gradients(parameters: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean cross-entropy of a batch of windows (samples, bases, channels), and its gradient by parameter.

    A norm's rows hold, in place of gradients of mean and variance, the batch's own (the variance with n - 1), which the running ones follow.
    """
    layers, epsilon = sum(name.startswith("conv") for name in parameters), ConvScorer.EPSILON
    stride, padding = ConvScorer.STRIDE, ConvScorer.PADDING
    grads: dict[str, np.ndarray] = {}

    def statistics(k: int, mean: np.ndarray, variance: np.ndarray, n: int) -> None:
        grads[f"norm{k}"] = np.zeros_like(parameters[f"norm{k}"])
        grads[f"norm{k}"][0], grads[f"norm{k}"][1] = mean, variance * (n / max(1, n - 1))

    h, kept0, mean, variance = _norm_forward(x, parameters["norm0"], epsilon)
    statistics(0, mean, variance, x.shape[0] * x.shape[1])
    trail = []
    for k in range(1, layers + 1):
        kernel = parameters[f"conv{k}"]
        padded = np.pad(h, ((0, 0), (padding, padding), (0, 0)))
        seen = np.lib.stride_tricks.sliding_window_view(padded, kernel.shape[2], axis=1)[:, ::stride]
        made = np.tensordot(seen, kernel, axes=((2, 3), (1, 2)))
        normed, kept, mean, variance = _norm_forward(made, parameters[f"norm{k}"], epsilon)
        statistics(k, mean, variance, made.shape[0] * made.shape[1])
        h = np.maximum(normed, 0)
        trail.append((seen, padded.shape, kept, normed > 0))
    flat = h.transpose(0, 2, 1).reshape(len(h), -1)
    before = flat @ parameters["dense1"].T + parameters["bias1"]
    hidden = np.maximum(before, 0)
    logits = hidden @ parameters["dense2"].T + parameters["bias2"]
    logits = logits - logits.max(axis=1, keepdims=True)
    log_p = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    n = len(x)
    loss = float(-log_p[np.arange(n), y].mean())

    d = np.exp(log_p)
    d[np.arange(n), y] -= 1
    d /= n
    grads["dense2"], grads["bias2"] = d.T @ hidden, d.sum(axis=0)
    d = (d @ parameters["dense2"]) * (before > 0)
    grads["dense1"], grads["bias1"] = d.T @ flat, d.sum(axis=0)
    d = (d @ parameters["dense1"]).reshape(n, h.shape[2], h.shape[1]).transpose(0, 2, 1)
    for k in range(layers, 0, -1):
        seen, shape, kept, active = trail[k - 1]
        d, grads[f"norm{k}"][2], grads[f"norm{k}"][3] = _norm_backward(d * active, kept)
        kernel = parameters[f"conv{k}"]
        grads[f"conv{k}"] = np.tensordot(d, seen, axes=((0, 1), (0, 1)))
        back = np.zeros(shape, dtype=d.dtype)
        for w in range(kernel.shape[2]):
            back[:, w : w + stride * d.shape[1] : stride] += d @ kernel[:, :, w]
        d = back[:, padding:-padding]
    _, grads["norm0"][2], grads["norm0"][3] = _norm_backward(d, kept0)
    return loss, grads


def _packed(sums: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **sums)
    return out.getvalue()


def _added(parts: Iterator[bytes]) -> dict[str, np.ndarray]:
    total: dict[str, np.ndarray] = {}
    for part in parts:
        with np.load(io.BytesIO(part), allow_pickle=False) as own:
            for name in own.files:
                total[name] = total[name] + own[name] if name in total else own[name]
    return total


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = _added(x.as_py() for batch in batches for x in batch.column(0))
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([_packed(total)])], names=["sums"])


def step_sums(samples: DataFrame, parameters: dict[str, np.ndarray], kmer: int) -> dict[str, np.ndarray]:
    """Sums over samples ``micro, id, qoff, label, window``: of each gradient times its samples, of losses (``loss``) and of samples (``n``)."""
    shared = samples.sparkSession.sparkContext.broadcast(parameters)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pandas().sort_values(["id", "qoff"], kind="stable")
        x = expanded(np.frombuffer(b"".join(rows["window"]), dtype=np.uint8), kmer).astype(np.float64)
        own = {k: v.astype(np.float64) for k, v in shared.value.items()}
        loss, grads = gradients(own, x, rows["label"].to_numpy())
        n = len(rows)
        return pa.table({"sums": pa.array([_packed({k: g * n for k, g in grads.items()} | {"loss": np.array(loss * n), "n": np.array(float(n))})])})

    sums = samples.groupBy("micro").applyInArrow(run, "sums binary").mapInArrow(_sum_rows, "sums binary")
    parts = sums.rdd.getNumPartitions()
    while parts > MOST_SUMS:
        parts = max(MOST_SUMS, math.isqrt(parts))
        sums = sums.repartition(parts).mapInArrow(_sum_rows, "sums binary")
    total = _added(x["sums"] for x in sums.collect())
    shared.unpersist()
    return total


class Nesterov:
    """Steps with momentum looked ahead, and weight decay on what is learned; running statistics follow the batches'."""

    def __init__(self, parameters: dict[str, np.ndarray], rate: float = LEARNING_RATE):
        self.parameters, self.rate = {k: v.astype(np.float64) for k, v in parameters.items()}, rate
        self.moved: dict[str, np.ndarray] = {}

    def step(self, sums: dict[str, np.ndarray]) -> float:
        """Applies the sums of a step; its mean loss."""
        n = float(sums["n"])
        for name, p in self.parameters.items():
            g = sums[name] / n
            learned = slice(2, 4) if name.startswith("norm") else slice(None)
            if name.startswith("norm"):
                p[:2] += RUNNING * (g[:2] - p[:2])
            d = g[learned] + WEIGHT_DECAY * p[learned]
            self.moved[name] = MOMENTUM * self.moved[name] + d if name in self.moved else d
            p[learned] -= self.rate * (d + MOMENTUM * self.moved[name])
        return float(sums["loss"]) / n


def fresh_parameters(kmer: int, filters: tuple[int, ...] = ConvScorer.FILTERS, widths: tuple[int, ...] = ConvScorer.WIDTHS, dense: int = ConvScorer.DENSE, channels: int = 8, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters to start from: uniform within one by the root of a unit's inputs, norms that change nothing."""
    r = np.random.default_rng(seed)
    uniform = lambda shape, inputs: r.uniform(-1, 1, shape) / math.sqrt(inputs)
    norm = lambda n: np.stack([np.zeros(n), np.ones(n), np.ones(n), np.zeros(n)])
    out = {"norm0": norm(channels)}
    for k, (n, width) in enumerate(zip(filters, widths, strict=True), 1):
        out[f"conv{k}"], out[f"norm{k}"] = uniform((n, channels, width), channels * width), norm(n)
        channels = n
    size = ConvScorer.flat_size(kmer, out)
    return out | {"dense1": uniform((dense, size), size), "bias1": uniform(dense, size), "dense2": uniform((2, dense), dense), "bias2": uniform(2, dense)}


def train(samples: DataFrame, context: str, kmer: int, parameters: dict[str, np.ndarray] | None = None, epochs: int = 1, batch: int = 4096, micro: int = 512, seed: int = 1, rate: float = LEARNING_RATE) -> tuple[ConvScorer, list[float]]:
    """A scorer trained on samples ``id, qoff, label, window`` (``sources.training.training_windows``), and the mean loss of every step.

    A step takes about ``batch`` samples in micro-batches of about ``micro``, by hashes of id, base and epoch. ``parameters`` of an earlier run are trained on.
    """
    pace = Nesterov(parameters or fresh_parameters(kmer, seed=seed), rate)
    n = samples.count()
    steps, micros = max(1, round(n / batch)), max(1, round(batch / micro))
    losses = []
    for epoch in range(epochs):
        drawn = F.xxhash64(F.lit(seed), F.lit(epoch), "id", "qoff")
        placed = samples.withColumn("step", F.pmod(drawn, F.lit(steps)).cast("int")).withColumn("micro", F.pmod(F.shiftright(drawn, 20), F.lit(micros)).cast("int"))
        ordered = written(placed.repartitionByRange("step", "micro").sortWithinPartitions("step", "micro"), "epoch")
        for step in range(steps):
            own = ordered.filter(F.col("step") == step)
            sums = step_sums(own, pace.parameters, kmer)
            if sums:
                losses.append(pace.step(sums))
        pace.rate *= DECAY
    return ConvScorer(context, kmer, pace.parameters), losses

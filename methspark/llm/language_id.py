"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the runs of one to three characters of the lower-cased text, hashed to ``DIM`` dimensions; every character that
isn't a letter counts as a space, and runs of spaces as one. A feature's weight is (1 + log count) * idf, and a text's vector
has length 1. The idf comes from document counts over all training documents, summed by partition. The classifier is
trained on one machine by follow-the-regularised-leader (FTRL-Proximal) with an elastic-net penalty, whose L1 part leaves most
weights at 0, on at most ``TRAIN_PER_LANGUAGE`` different texts a language with the smallest seeded hashes of their ids (a text that several rows
have counts once, with the smallest id); then one temperature is fitted on as many more that the regression has not seen. Prediction covers every document and whole text.

Defined results: ``und`` and score 0 if the text is null or has no letter, or if nothing could be learned; otherwise a label
seen in training and its calibrated probability, ties to the first label by code point. Rows without a label or id teach
nothing. Repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


UNDETERMINED = "und"
DIM_BITS = 15
DIM = 1 << DIM_BITS
#: Labelled documents a language for the regression, and as many for the temperature.
TRAIN_PER_LANGUAGE = 400
#: More labels than this are an error: the driver holds a weight for each feature and label, and the sample of each.
MOST_LABELS = 200
#: Characters hashed at a time.
PIECE = 1 << 20
#: FTRL-Proximal: learning rate, its offset, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 1e-4, 4


def _letters() -> np.ndarray:
    """For each code point of the basic plane: the lower-cased letter, or a space."""
    out = np.full(0x10000, 0x20, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_FOLD = _letters()


def fold(text: str) -> np.ndarray:
    """Code points of the text, lower-cased; what isn't a letter becomes a space, with one at either end, runs as one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.where(points < 0x10000, _FOLD[np.minimum(points, 0xFFFF)], points)
    beyond = np.flatnonzero(points >= 0x10000)
    for k in beyond.tolist():
        if not chr(int(points[k])).isalpha():
            low[k] = 0x20
    low = np.concatenate([np.array([0x20], dtype=np.uint32), low.astype(np.uint32), np.array([0x20], dtype=np.uint32)])
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != 0x20) | (low[:-1] != 0x20)
    return low[keep]


def counts(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a folded text and how often each occurs."""
    total = np.zeros(DIM, dtype=np.int64)
    with np.errstate(over="ignore"):
        for low in range(0, len(folded), PIECE):
            part = folded[low : low + PIECE + 2].astype(np.uint64)
            own = min(PIECE, len(folded) - low)
            run = part * np.uint64(0x9E3779B1) + np.uint64(1)
            for n in (1, 2, 3):
                if n > 1:
                    run = run[:-1] * np.uint64(0x100000001B3) + part[n - 1 :] * np.uint64(0x85EBCA77) + np.uint64(n)
                h = (run * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIM_BITS)
                total += np.bincount(h[:own].astype(np.int64), minlength=DIM)
    found = np.flatnonzero(total)
    return found, total[found]


def vector(folded: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, n = counts(folded)
    x = (1.0 + np.log(n)) * idf[found]
    return found, x / max(1e-12, float(np.sqrt((x * x).sum())))


@dataclass
class Model:
    """Labels by code point, their weights (DIM by labels) and biases, the idf and the temperature."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, found: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[found] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels:
            return UNDETERMINED, 0.0
        folded = fold(text)
        if not (folded != 0x20).any():
            return UNDETERMINED, 0.0
        p = _softmax(self.logits(*vector(folded, self.idf)) / self.temperature)
        best = int(np.argmax(p))
        return self.labels[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], held: list[tuple[str, str]], idf: np.ndarray, seed: int = 7) -> Model:
    """FTRL-Proximal over (label, text) rows, then a temperature over the held ones."""
    labels = sorted({label for label, _ in rows})
    at = {label: k for k, label in enumerate(labels)}
    data = [(at[label], *vector(f, idf)) for label, text in rows if ((f := fold(text)) != 0x20).any()]
    z, n = np.zeros((DIM, len(labels))), np.zeros((DIM, len(labels)))
    zb, nb = np.zeros(len(labels)), np.zeros(len(labels))

    def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    random = np.random.default_rng(seed)
    for _ in range(PASSES):
        for k in random.permutation(len(data)):
            y, found, x = data[k]
            w, b = weights(z[found], n[found], L1), weights(zb, nb, 0.0)
            p = _softmax(x @ w + b)
            p[y] -= 1.0
            for own_z, own_n, g, cur in ((z, n, x[:, None] * p[None, :], w), (zb, nb, p, b)):
                where = found if own_z is z else slice(None)
                old = own_n[where]
                new = old + g * g
                own_z[where] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * cur
                own_n[where] = new
    model = Model(labels, weights(z, n, L1).astype(np.float32), weights(zb, nb, 0.0), idf, 1.0)
    seen = [(at[label], model.logits(*vector(f, idf))) for label, text in held if label in at and ((f := fold(text)) != 0x20).any()]
    if seen:
        model.temperature = _temperature(np.array([s for _, s in seen]), np.array([y for y, _ in seen]))
    return model


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows of ``text``: in how many each feature occurs, and how many have a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                folded = fold(text.as_py() or "")
                if (folded != 0x20).any():
                    df[counts(folded)[0]] += 1
                    n += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, DIM), type=pa.int32()), pa.array(np.append(df[found], n), type=pa.int64())], names=["feature", "n"])

    total = docs.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIM + 1, dtype=np.int64)
    out[total["feature"].to_numpy(dtype=np.int64)] = total["n"].to_numpy(dtype=np.int64)
    return out[:DIM], int(out[DIM])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, seed: int = 7) -> Model:
    """A model from the labelled rows; rows without id, label or text teach nothing."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter("id is not null and text is not null and label is not null")
    df, n = document_frequencies(rows)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    labels = rows.select("label").distinct().limit(MOST_LABELS + 1).count()
    if labels > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    # the sample is chosen by hashes before any text moves, and holds a text of a language once; so it is bounded, whatever repeats
    known = rows.withColumn("h", F.xxhash64("text"))
    texts = known.groupBy("label", "h").agg(F.min("id").alias("id"))
    chosen = _first_by_label(texts.withColumn("o", F.xxhash64(F.lit(seed), "id")), 2 * per_language)
    found = known.join(F.broadcast(chosen), ["label", "h", "id"]).groupBy("label", "h", "rank").agg(F.min("text").alias("text"))
    picked = found.collect()
    picked.sort(key=lambda r: (r["label"].encode(), r["rank"]))
    return train([(r["label"], r["text"]) for r in picked if r["rank"] % 2], [(r["label"], r["text"]) for r in picked if not r["rank"] % 2], idf, seed)


def _first_by_label(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of each label with the smallest ``o``, ranked from 1; partitions keep n of each before any exchange."""
    from pyspark.sql.window import Window

    spread = rows.withColumn("salt", F.pmod("h", F.lit(64)))
    for keys in (["label", "salt"], ["label"]):
        spread = spread.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("o", "id", "h"))).filter(F.col("rank") <= n)
    return spread.select("id", "label", "h", "rank")


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, lang_pred, score`` of every row, and the columns in ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("".join(c.lower() for c in (id_col, *keep)) + "_"), *keep)  # a name that none of them has

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = [own.predict(text.as_py()) for text in batch.column(1)]
            columns = [batch.column(0), *[batch.column(k + 2) for k in range(len(keep))], pa.array([g[0] for g in got], type=pa.string()), pa.array([g[1] for g in got], type=pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *keep, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([rows.schema[id_col], *[rows.schema[k] for k in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(predict, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is determined with at least the probability ``least``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = (own.predict(text.as_py()) for text in batch.column(at))
            yield batch.filter(pa.array([label != UNDETERMINED and score >= least for label, score in got], type=pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))

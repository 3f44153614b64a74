"""Masked pseudo-likelihood scores of documents, by a bidirectional window network trained in numpy.

Every word is predicted from those on both sides of it, itself masked, in two factors: the probability of its class given the
neighbours' classes (hidden = L[left] + R[right], logits = U hidden + c, softmax over the classes), and that of the word within its
class. A document's score is the sum of the log-probabilities of its words.

Classes: the most frequent words of the whole corpus have one each, the others share hash buckets, and a boundary token stands at
either end of a text. Their number grows with the cube root of the number of words seen ``LEAST_SEEN`` times or more, up to ``MOST_CLASSES``. Within a bucket
of N tokens a word seen n times has n / (N + 1), from exact counts over all documents, and what was never seen shares the remaining
1 / (N + 1); so no two words share a probability unless they were seen equally often. Counts of the most frequent words are with
every task; the others are joined with the tokens by word, and so no task holds a list of all words. Which words are with the tasks
doesn't change a score.

Training: as the hidden layer is linear, the exact gradient of the pseudo-
likelihood needs only two tables counted over all documents, how often each pair of tokens stands side by side, and how often each
pair stands around a token. The first gives the part of the gradient that raises what was seen, exactly, and from
the second neighbour pairs are drawn for the part that lowers what the network predicts. So every token of the corpus is trained
on, and what the driver holds is the square of the number of classes.

Scoring: left and right part of a logit and the normaliser of every pair of neighbours are tables of that size as well, so a
token costs three look-ups, and the result is the network's own probability of the class.

Defined results: words are runs without ASCII white space, lower-cased; a null text or one without words has 0 tokens, log-
likelihood 0 and a null mean. Repeated rows get equal scores; an empty corpus gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Classes of a small corpus: the boundary (0), frequent words, buckets.
VOCABULARY, BUCKETS = 1024, 256
#: Beyond that there are GROWTH times the cube root of the number of words seen LEAST_SEEN times or more, a quarter of them buckets.
GROWTH, LEAST_SEEN = 20, 20
#: Up to so many: the driver holds two tables of its square (134 MB each), and every task three (67 MB each). Words stay apart within their classes.
MOST_CLASSES = 4096
#: About so many words' counts are with every task; the others are joined.
KNOWN = 200_000
#: Up to so many cells a task counts pairs in whole tables.
DENSE_CELLS = 1 << 22
#: Logarithms of counts are summed as multiples of 1 / SCALE, in any order with the same result.
SCALE = 1 << 30
HIDDEN, STEPS, BATCH, RATE = 16, 250, 1024, 0.05
#: Distinct words counted in a task before they leave it, and tokens before they are added to its tables.
FLUSH_WORDS, FLUSH_TOKENS = 400_000, 1 << 20
#: Words outside the vocabulary whose bucket a task remembers.
REMEMBERED = 400_000


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts (column ``text``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.binary()), pa.array(list(seen.values()), type=pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(words(text.as_py()))
                if len(seen) >= FLUSH_WORDS:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """Word to class: frequent words have their own, others share hash buckets."""

    def __init__(self, frequent: list[bytes], size: int = VOCABULARY, buckets: int = BUCKETS):
        super().__init__({w: i + 1 for i, w in enumerate(frequent[: size - buckets - 1])})
        self.size, self.buckets, self.known = size, buckets, len(self)

    def __reduce__(self):
        return Vocabulary, (list(self)[: self.known], self.size, self.buckets)

    def __missing__(self, word: bytes) -> int:
        token = self.size - self.buckets + zlib.crc32(word) % self.buckets
        if len(self) < self.known + REMEMBERED:
            self[word] = token
        return token

    def tokens(self, text: str | None) -> np.ndarray:
        return self.of(words(text))

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.int32, count=len(found))


def vocabulary(docs: DataFrame, size: int = VOCABULARY, buckets: int = BUCKETS) -> Vocabulary:
    top = word_counts(docs).orderBy(F.desc("n"), "word").limit(size - buckets - 1).collect()
    return Vocabulary([bytes(r["word"]) for r in top], size, buckets)


def classes(seen_often: int) -> tuple[int, int]:
    """How many classes a corpus gets that has so many words seen LEAST_SEEN times or more, and how many of them are buckets."""
    size = min(MOST_CLASSES, max(VOCABULARY, round(GROWTH * seen_often ** (1 / 3))))
    return size, max(BUCKETS, size // 4)


def frequent_words(counts: DataFrame) -> tuple[list[tuple[bytes, int]], int, int]:
    """Words with counts, the most frequent first, down to the least count that leaves no more than KNOWN; that count; and how many words
    were seen LEAST_SEEN times or more."""
    by_count = sorted(((r["n"], r["words"]) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    upto, least = 0, (by_count[0][0] + 1 if by_count else 1)
    for n, w in by_count:
        upto += w
        if upto > KNOWN:
            break
        least = n
    found = counts.filter(F.col("n") >= least).select("word", "n").toArrow()
    top = sorted(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    return top, least, sum(w for n, w in by_count if n >= LEAST_SEEN)


def lined(parts: list[np.ndarray]) -> np.ndarray:
    """Texts end to end with the boundary token around each."""
    edge = np.zeros(1, dtype=np.int32)
    return np.concatenate([edge, *[x for p in parts if len(p) for x in (p, edge)]])


def pair_tables(docs: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Counts of neighbours (left, right), and of pairs around a token (left, right), over all texts."""
    size, shared = vocab.size, docs.sparkSession.sparkContext.broadcast(vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, own = size * size, shared.value
        whole = np.zeros(2 * cells, dtype=np.int64) if cells <= DENSE_CELLS else None
        parts, held = [], 0

        def rows(at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for low in range(0, len(at), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(at[low : low + (1 << 18)], type=pa.int64()), pa.array(n[low : low + (1 << 18)], type=pa.int64())], names=["cell", "n"])

        def add() -> Iterator[pa.RecordBatch]:
            line = lined(parts).astype(np.int64)
            inner = line[1:-1] > 0
            for k, at in enumerate((line[:-1] * size + line[1:], (line[:-2] * size + line[2:])[inner])):
                if whole is not None:
                    whole[k * cells : (k + 1) * cells] += np.bincount(at, minlength=cells)
                else:
                    yield from rows(*np.unique(at + k * cells, return_counts=True))

        for batch in batches:
            for text in batch.column(0):
                parts.append(own.tokens(text.as_py()))
                held += len(parts[-1])
                if held >= FLUSH_TOKENS:
                    yield from add()
                    parts.clear()
                    held = 0
        if held:
            yield from add()
        if whole is not None:
            at = np.flatnonzero(whole)
            yield from rows(at, whole[at])

    counted = written(docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "pairs")
    out = []
    for k in (0, 1):
        table, low = np.zeros(size * size), k * size * size
        found = counted.filter((F.col("cell") >= low) & (F.col("cell") < low + size * size)).select((F.col("cell") - low).alias("cell"), "n").toArrow()
        table[found["cell"].to_numpy()] = found["n"].to_numpy()
        out.append(table.reshape(size, size))
    return out[0], out[1]


class WindowNetwork:
    """L, R and U are (vocabulary, hidden), c (vocabulary)."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = 11):
        random = np.random.default_rng(seed)
        self.left, self.right, self.out = (random.normal(0, 0.1, (size, hidden)) for _ in range(3))
        self.bias = np.zeros(size)

    def log_probabilities(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of every token, for each pair of neighbours; the boundary is never predicted."""
        z = (self.left[left] + self.right[right]) @ self.out.T + self.bias
        z[:, 0] = -np.inf
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, beside: np.ndarray, around: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 12) -> WindowNetwork:
        """Raise the mean log-likelihood of the counted corpus by Adam."""
        total = around.sum()
        if not total:
            return self
        size = len(self.bias)
        share = beside.sum(axis=0) / total
        share[0] = 0
        self.bias = np.log(share + 1e-7)
        cells = np.flatnonzero(around)
        upto = np.cumsum(around.ravel()[cells])
        random = np.random.default_rng(seed)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.left, self.right, self.out, self.bias)]
        for step in range(1, steps + 1):
            drawn = cells[np.searchsorted(upto, random.random(batch) * total, side="right").clip(max=len(cells) - 1)]
            l, r = drawn // size, drawn % size
            hidden = self.left[l] + self.right[r]
            p = np.exp(self.log_probabilities(l, r)) / batch
            back = p @ self.out
            out = self.out / total
            out[0] = 0  # the boundary is never predicted
            gl, gr = beside @ out, beside.T @ out
            np.subtract.at(gl, l, back)
            np.subtract.at(gr, r, back)
            go = (beside.T @ self.left + beside @ self.right) / total
            go[0] = 0
            go -= p.T @ hidden
            now = rate * (1 - (step - 1) / steps)
            for param, grad, (m, v) in zip((self.left, self.right, self.out, self.bias), (gl, gr, go, share - p.sum(axis=0)), state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                param += now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every pair: the left and right part of a token's logit, and the normaliser of two neighbours."""
        size = len(self.bias)
        left, right = self.left @ self.out.T, self.right @ self.out.T + self.bias
        norm = np.empty((size, size), dtype=np.float32)
        top_left, top_right = np.exp((left - left.max(axis=1, keepdims=True))[:, 1:]).astype(np.float32), np.exp((right - right.max(axis=1, keepdims=True))[:, 1:]).astype(np.float32)
        # log sum_t exp(a_t + b_t) is a product of two tables of exponentials
        for low in range(0, size, 256):
            norm[low : low + 256] = np.log(np.maximum(top_left[low : low + 256] @ top_right.T, 1e-37))
        norm += (left.max(axis=1)[:, None] + right.max(axis=1)[None, :]).astype(np.float32)
        return left.astype(np.float32), right.astype(np.float32), norm


def token_scores(line: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Log-probability of each token of a line from ``lined`` given its neighbours; 0 at boundaries."""
    left, right, norm = tables
    l, t, r = line[:-2], line[1:-1], line[2:]
    return np.where(t > 0, left[l, t].astype(np.float64) + right[r, t] - norm[l, r], 0.0)


class Model(NamedTuple):
    """``within`` has what a class takes from the logarithm of a word's count, ``logs`` the logarithms of the known words in buckets, and
    ``counts`` (``word, n``) the other words seen twice or more."""

    vocab: Vocabulary
    tables: tuple[np.ndarray, np.ndarray, np.ndarray]
    within: np.ndarray
    logs: dict[bytes, float]
    counts: DataFrame


def fit(docs: DataFrame) -> Model:
    """A network trained on all of ``docs`` (column ``text``), and the counts of its words."""
    counts = written(word_counts(docs).filter("n > 1"), "words")
    top, least, seen_often = frequent_words(counts)
    size, buckets = classes(seen_often)
    vocab = Vocabulary([w for w, _ in top], size, buckets)
    beside, around = pair_tables(docs, vocab)
    within = np.zeros(size)
    within[size - buckets :] = np.log(beside[:, size - buckets :].sum(axis=0) + 1)
    logs = {w: math.log(n) for w, n in top[vocab.known :]}
    return Model(vocab, WindowNetwork(size).train(beside, around).tables(), within, logs, counts.filter(F.col("n") < least))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``id, n_tokens, log_likelihood, mean_log_likelihood`` of every row."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    model = model or fit(rows)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model[:4]))
    kind = rows.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A record for each row, and one for each of its words whose count must be looked up."""
        vocab, tables, within, logs = shared.value
        first, key = vocab.size - vocab.buckets, TaskContext.get().partitionId() << 40
        for batch in batches:
            low, sums, parts, asked, askers, held = 0, [], [], [], [], 0

            def records(upto: int) -> pa.RecordBatch:
                n = np.array([len(p) for p in parts], dtype=np.int64)
                filled = np.flatnonzero(n)
                total = np.array(sums)
                if len(filled):
                    line = lined(parts)
                    starts = np.concatenate([[0], np.cumsum(n[filled] + 1)[:-1]])
                    total[filled] += np.add.reduceat(token_scores(line, tables) - within[line[1:-1]], starts)
                ids = batch.column(0).slice(low, upto - low)
                keys = np.arange(key + low, key + upto)
                # a row's own record has a key that no word has, so that these records don't meet in one task
                own = [b" %d" % k for k in keys]
                none = len(asked)
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([keys, keys[np.array(askers, dtype=np.int64)]])),
                        pa.concat_arrays([ids, pa.nulls(none, ids.type)]),
                        pa.array(np.concatenate([n, np.zeros(none, dtype=np.int64)])),
                        pa.array(np.concatenate([total, np.zeros(none)])),
                        pa.array(own + asked, type=pa.binary()),
                    ],
                    names=["_row", id_col, "n_tokens", "_own", "word"],
                )

            for k, text in enumerate(batch.column(1)):
                found = words(text.as_py())
                tokens = vocab.of(found)
                had = 0.0
                for i in np.flatnonzero(tokens >= first).tolist():
                    log = logs.get(found[i])
                    if log is None:
                        asked.append(found[i])
                        askers.append(len(parts))
                    else:
                        had += log
                parts.append(tokens)
                sums.append(had)
                held += len(tokens)
                if held >= FLUSH_TOKENS:
                    yield records(k + 1)
                    low, sums, parts, asked, askers, held = k + 1, [], [], [], [], 0
            if parts:
                yield records(len(batch))
            key += len(batch)

    found = rows.mapInArrow(judge, f"_row long, `{id_col}` {kind}, n_tokens long, _own double, word binary")
    logs = model.counts.select("word", F.round(F.log("n") * SCALE).cast("long").alias("_log"))
    summed = found.join(logs, "word", "left").groupBy("_row").agg(
        F.first(id_col, ignorenulls=True).alias(id_col), F.sum("n_tokens").alias("n_tokens"), (F.sum("_own") + F.coalesce(F.sum("_log"), F.lit(0)) / SCALE).alias("log_likelihood")
    )
    return summed.drop("_row").withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))

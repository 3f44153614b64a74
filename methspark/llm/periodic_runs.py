"""Periodic runs of words: branching tandem repeats from a suffix tree's smaller halves, rotated and merged into maximal runs.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST_EXPONENT`` times as long as q and of at least ``LEAST_LENGTH``
words, that no neighbouring word extends keeping the period. Documents are searched on their own, each within its row, many at a time by numpy:

1. Words get numbers, exact and document by document. In a run every word occurs at least ``LEAST_EXPONENT`` times, so only stretches of
   words that do are searched, each with an alphabet of its own; no run is lost, as no word outside could extend one.
2. Suffix tree, as suffix array (prefix doubling, only of what is still tied) and lengths of common prefixes (those that don't follow from the
   suffix one word before are compared, the others are one less). Each of these lengths d is an inner node of depth d, that splits its
   leaves, an interval of the suffix array, in two; a node of several children is as many such splits.
3. For every split the leaf list of the smaller half is gone through: a leaf i whose i + d, or i - d, lies in the other half starts, or
   ends, a tandem repeat of period d that branches, as depth d is exactly where the two part. No leaf is in more than log n smaller halves.
4. A branching repeat is the last rotation of its run, whose end it shares. Rotating it to the left, as long as words d apart are equal, gives
   the start. Of repeats with one end the shortest goes first, and its multiples within its run are merged into it, which leaves the
   smallest period; so no run is rotated through twice.

A word goes if any run holds it after that run's first q words, so each run collapses to one period.

Defined results: a null or empty text, or one of white space, has no words, no runs and an empty ``collapsed``. Rows are judged one by one, so
null or repeated ids don't matter, and other columns are not read. An empty table gives an empty result. A very long text is a batch of its
own; memory follows the longest text (about 200 bytes a word), not the table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_EXPONENT = 4
LEAST_LENGTH = 6
#: Words searched together.
WORDS = 1 << 18
#: Leaves looked at together, and elements compared together.
AT_ONCE = 1 << 20


def suffix_array(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of numbers from 0, and its inverse, by prefix doubling."""
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    slots, keys, h = np.arange(n), letters[order].astype(np.int64), 0
    while True:
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[order[slots]] = np.maximum.accumulate(np.where(first, slots, 0))
        tied = ~(first & np.append(first[1:], True))
        if not tied.any():
            return order, rank
        slots, h = slots[tied], max(1, 2 * h)
        at = order[slots]
        after = np.zeros(len(at), dtype=np.int64)
        inside = at + h < n
        after[inside] = rank[at[inside] + h] + 1
        keys = rank[at] * (n + 1) + after
        by = np.argsort(keys, kind="stable")
        order[slots], keys = at[by], keys[by]


def agreement(padded: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many letters from i and j on (``step`` 1), or before them (-1), are equal; ``padded`` ends the comparison at either side.

    Blocks grow as fewer pairs are left, and are cut at the ends of the text.
    """
    out = np.zeros(len(i), dtype=np.int64)
    left, done, top = np.arange(len(i)), 0, len(padded) - 1
    while len(left):
        parts = []
        block = int(min(4096, max(8, (1 << 16) // len(left))))
        reach = (done + np.arange(block)) * step
        for low in range(0, len(left), AT_ONCE // block):
            some = left[low : low + AT_ONCE // block]
            same = padded[np.clip(i[some, None] + reach, 0, top)] == padded[np.clip(j[some, None] + reach, 0, top)]
            whole = same.all(axis=1)
            out[some] = done + np.where(whole, block, same.argmin(axis=1))
            parts.append(some[whole])
        left, done = np.concatenate(parts), done + block
    return out


def common_prefixes(letters: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in the suffix array."""
    n = len(letters)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    known = (before > 0) & (place > 0)
    known[known] = letters[place[known] - 1] == letters[before[known] - 1]
    compared = np.flatnonzero(~known & (before >= 0))
    ends = place.copy()  # where the common prefix ends; without a suffix before, at the suffix itself
    ends[compared] += agreement(np.append(letters, -1), compared, before[compared], 1)
    ends[known] = 0
    return (np.maximum.accumulate(ends) - place)[order]


def splits(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every k with lcp[k] > 0: k, the first slot of its left half, and the slot after its right half (which starts at k)."""
    n = len(lcp)
    k = np.flatnonzero(lcp > 0)
    if not len(k):
        return k, k, k
    zeros = np.append(np.flatnonzero(lcp == 0), n)
    tables, width = [lcp], 1
    while 2 * width <= np.diff(zeros).max():
        low = tables[-1]
        tables.append(np.minimum(low[:-width], low[width:]))
        width *= 2
    depth, left, right = lcp[k], k.copy(), k + 1
    for level in range(len(tables) - 1, -1, -1):
        table, width = tables[level], 1 << level
        able = left >= width
        able[able] = table[left[able] - width] > depth[able]
        left[able] -= width
        able = right + width <= n
        able[able] = table[right[able]] >= depth[able]
        right[able] += width
    return k, left - 1, right


def branching_repeats(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every branching tandem repeat: two equal parts side by side, that the letter behind them doesn't go on with."""
    order, rank = suffix_array(letters)
    lcp = common_prefixes(letters, order)
    k, low, high = splits(lcp)
    depth, on_left = lcp[k], k - low <= high - k
    first = np.where(on_left, low, k)
    size = np.where(on_left, k - low, high - k)
    other_low, other_high = np.where(on_left, k, low), np.where(on_left, high, k)
    starts, periods = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    sums = np.cumsum(size)
    at = 0
    while at < len(k):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + AT_ONCE, side="right")))
        node = np.repeat(np.arange(at, to), size[at:to])
        leaf = order[np.arange(len(node)) - np.repeat(np.cumsum(size[at:to]) - size[at:to] - first[at:to], size[at:to])]
        d = depth[node]
        for partner, start in ((leaf + d, leaf), (leaf - d, leaf - d)):
            inside = np.flatnonzero((partner >= 0) & (partner < len(letters)))
            slot = rank[partner[inside]]
            hit = inside[(slot >= other_low[node[inside]]) & (slot < other_high[node[inside]])]
            starts.append(start[hit])
            periods.append(d[hit])
        at = to
    return np.concatenate(starts), np.concatenate(periods)


def maximal_runs(letters: np.ndarray, least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs, by start and period. Letters are numbers from 0."""
    start, period = branching_repeats(letters)
    by = np.lexsort((period, start + 2 * period))
    start, period = start[by], period[by]
    padded = np.concatenate([[-1], letters])  # before the first letter nothing is equal
    found = [(np.zeros(0, dtype=np.int64),) * 3]
    while len(start):
        end = start + 2 * period
        first = np.concatenate([[True], end[1:] != end[:-1]])
        own = np.flatnonzero(first)[np.cumsum(first) - 1]
        s, q = start[first], period[first]
        turns = agreement(padded, s, s + q, -1)
        begins = s - turns
        long = end[first] - begins
        good = (long >= least_exponent * q) & (long >= least_length)
        found.append((begins[good], long[good], q[good]))
        length = np.zeros(len(start), dtype=np.int64)
        length[first] = long
        merged = (period % period[own] == 0) & (2 * period <= length[own])
        start, period = start[~merged], period[~merged]
    runs = tuple(np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((runs[2], runs[0]))
    return tuple(x[by] for x in runs)


def stretches(texts: np.ndarray, words: np.ndarray, least_exponent: int, least_length: int, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may lie in a run, and letters that tell stretches apart; ``texts`` rise, ``words`` are numbers of their own in each text."""
    place, part, letter = np.arange(len(words)), texts, words
    for _ in range(passes):
        enough = np.bincount(letter, minlength=1)[letter] >= least_exponent if len(letter) else np.zeros(0, dtype=bool)
        before = len(place)
        place, part, letter = place[enough], part[enough], letter[enough]
        if not len(place):
            break
        begins = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (part[1:] != part[:-1])])
        number = np.cumsum(begins) - 1
        wide = np.bincount(number)[number] >= least_length
        place, part, letter = place[wide], number[wide], letter[wide]
        letter = np.unique(part * (int(words.max()) + 1) + letter, return_inverse=True)[1]
        if len(place) == before:
            break
    return place, letter


def runs_of_texts(texts: list[list[bytes]], least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of the runs of all texts (lists of words), by text, start and period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    numbers, numbered = [np.zeros(0, dtype=np.int64)], 0
    for t in texts:
        code: defaultdict = defaultdict(count(numbered).__next__)
        numbers.append(np.fromiter(map(code.__getitem__, t), dtype=np.int64, count=len(t)))
        numbered += len(code)
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    place, letters = stretches(owner, np.concatenate(numbers), least_exponent, least_length)
    if not len(place):
        return (np.zeros(0, dtype=np.int64),) * 4
    start, length, period = maximal_runs(letters, least_exponent, least_length)
    start = place[start]
    text = owner[start]
    return text, start - base[text], length, period


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words but those that a run holds after its first period, with single spaces."""
    if not len(start):
        return b" ".join(words)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    return b" ".join([w for w, gone in zip(words, np.cumsum(marks)[:-1].tolist(), strict=True) if not gone])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``id, n_words, runs, collapsed`` of every row; ``runs`` are structs of start (word number from 0), length and period, by start and period."""
    if least_exponent < 2 or least_length < 2:
        raise ValueError("a run holds its period at least twice")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def searched(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        text, *runs = runs_of_texts(texts, least_exponent, least_length)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        out = [collapsed(t, *(x[cuts[k] : cuts[k + 1]] for x in runs)).decode() for k, t in enumerate(texts)]
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in runs], fields=list(run)))
        return pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], type=pa.int64()), lists, pa.array(out, type=pa.string())], names=["id", "n_words", "runs", "collapsed"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, first = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                texts.append((text.as_py() or "").encode().split())
                held += len(texts[-1])
                if held >= WORDS:
                    yield searched(batch.column(0).slice(first, k + 1 - first), texts)
                    texts, held, first = [], 0, k + 1
            if texts:
                yield searched(batch.column(0).slice(first), texts)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(search, schema).withColumnRenamed("id", id_col)

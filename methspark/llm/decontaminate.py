"""Benchmark decontamination: size-partitioned MinHash search for items contained in documents, verified exactly.

Items are partitioned by the size of their shingle sets, each partition reaching to twice its smallest size. An item's
sketch is its bottom-k MinHash: the k smallest of its shingles' hashes, where k is set by the size partition's largest
size q so that k > (1 - t) q. A document that holds at least a share t of an item's shingles misses at most (1 - t) q of
them, so at least one of the sketch is in it: the search has no false negatives, however long the document. (Banded
MinHash of whole documents can't give that: a 30-word item in a 20,000-word document has a Jaccard similarity near 0.001.)
Documents are probed with all their shingles; a document that meets a sketch becomes a candidate of that item, and the share
of the item's shingles that it holds is then counted on the words themselves.

The benchmark is a stated query set: it is read in blocks of at most ``BLOCK_BYTES`` of text, each broadcast, and every document
is searched for one block's items in one pass, with no shuffle. More blocks only mean more passes.

Words are runs without ASCII white space or punctuation, A-Z lower-cased. Defined results: an item with fewer words than a
shingle has one shingle, its whole sequence, and is in every document that has this run of words; for each such length that occurs,
documents are probed with their runs of that length as well. An item or document without words is in nothing and holds nothing.
Repeated item rows are reported each under their own id; null ids of items are left out. A null text is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from .wordhash import Words, each_text, rolling

SHINGLE, THRESHOLD = 5, 0.8
#: Text of items broadcast at a time.
BLOCK_BYTES = 16 << 20
CUT = Words(lower=True, punctuation=True)
#: Bits of the table that drops most shingles before the exact look-up.
FILTER_BITS = 20


def _spelled(body: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> list[bytes]:
    """The n-word runs of a text as words, lower-cased, in order."""
    raw = body.tobytes().lower()
    tokens = [raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
    return [b" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]


class ItemBlock:
    """The sketches and shingles of one block of items.

    Hashes of shorter runs are told apart by their length, as they are probed with runs of that length only.
    """

    def __init__(self, ids: list, texts: list[str], n: int = SHINGLE, threshold: float = THRESHOLD):
        self.threshold, self.ids = threshold, ids
        self.sets: list[frozenset[bytes]] = []
        self.lengths: list[int] = []
        met: dict[int, dict[int, list[int]]] = {}
        for k, (_, body, begin, end, value) in enumerate(each_text(pa.array(texts, type=pa.large_string()), CUT)):
            length = min(n, len(value))
            self.lengths.append(length)
            self.sets.append(frozenset(_spelled(body, begin, end, length)) if length else frozenset())
            hashes = np.unique(rolling(value, length)) if length else value
            for h in hashes[: self.sketch_size(len(hashes))].tolist():
                met.setdefault(length, {}).setdefault(h, []).append(k)
        self.items_of = met
        self.keys = {length: np.array(sorted(own), dtype=np.uint64) for length, own in met.items()}
        self.seen = {length: np.zeros(1 << FILTER_BITS, dtype=bool) for length in met}
        for length, keys in self.keys.items():
            self.seen[length][(keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def sketch_size(self, size: int) -> int:
        """k of the item's size partition: more than the shingles that a match of the partition's largest size may miss."""
        largest = (1 << size.bit_length()) - 1
        return min(size, math.floor((1 - self.threshold) * largest + 1e-9) + 1)

    def candidates(self, value: np.ndarray) -> set[int]:
        out: set[int] = set()
        for length, keys in self.keys.items():
            hashes = rolling(value, length)
            hashes = hashes[self.seen[length][(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]]
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            out.update(k for h in np.unique(hashes[keys[at] == hashes]).tolist() for k in self.items_of[length][h])
        return out

    def matches(self, body: np.ndarray, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> list[tuple]:
        """Item ids and shares of the items that the text contains, by id."""
        maybe = self.candidates(value)
        if not maybe:
            return []
        held = {length: set(_spelled(body, begin, end, length)) for length in {self.lengths[k] for k in maybe}}
        shares = ((self.ids[k], len(self.sets[k] & held[self.lengths[k]]) / len(self.sets[k])) for k in maybe)
        return sorted((i, s) for i, s in shares if s >= self.threshold)


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items, in blocks of bounded text; one block at a time is on the driver."""
    ids, texts, held = [], [], 0
    rows = items.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).filter("i is not null")
    for row in rows.toLocalIterator():
        ids.append(row["i"])
        texts.append(row["t"])
        held += len(row["t"].encode())
        if held >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def matches_by_document(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``id, items, shares`` for every document: the items that it contains, by id, and the share of each."""
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType
    none = F.array().cast(ArrayType(kind)).alias("items"), F.array().cast("array<double>").alias("shares")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *none)
    for ids, texts in item_blocks(items, item_id, item_text):
        block = spark.sparkContext.broadcast((ids, texts))

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = ItemBlock(*block.value, n, threshold)
            for batch in batches:
                items, shares = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for row, body, begin, end, value in each_text(batch.column(1), CUT):
                    for item, part in index.matches(body, begin, end, value):
                        items[row].append(item)
                        shares[row].append(part)
                found = [pa.array(items, type=pa.list_(to_arrow_type(kind))), pa.array(shares, type=pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["id", "text", "items", "shares"])

        rows = rows.mapInArrow(search, rows.schema)
    return rows.select("id", "items", "shares")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``id, contaminated, n_items, items, containment`` for every document; ``containment`` is the largest share, else 0."""
    found = matches_by_document(docs, items, id_col, text_col, **parameters)
    return found.select(
        F.col("id").alias(id_col),
        (F.size("items") > 0).alias("contaminated"),
        F.size("items").cast("long").alias("n_items"),
        F.array_sort("items").alias("items"),
        F.coalesce(F.array_max("shares"), F.lit(0.0)).alias("containment"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item; no exchange."""
    spark = docs.sparkSession
    kept = docs
    for ids, texts in item_blocks(items, item_id, item_text):
        block = spark.sparkContext.broadcast((ids, texts))
        at = docs.columns.index(text_col)

        def search(batches: Iterator[pa.RecordBatch], block=block, at=at) -> Iterator[pa.RecordBatch]:
            index = ItemBlock(*block.value, n, threshold)
            for batch in batches:
                clean = [not index.matches(body, begin, end, value) for _, body, begin, end, value in each_text(batch.column(at), CUT)]
                yield batch.filter(pa.array(clean, type=pa.bool_()))

        kept = kept.mapInArrow(search, docs.schema)
    return kept

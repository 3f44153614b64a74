"""Substring dedup over words: fixed-block anchors, probed by every rolling window, extended to maximal exact repeats.

A window is ``WINDOW`` consecutive words of one document; every word covered by a window that also starts in a document with a
smaller id goes. A window of 2 b words holds a whole aligned block of b words, wherever it starts, so:

1. Index. Every document's non-overlapping blocks of b = WINDOW / 2 words are hashed; their hashes go into a bitmap.
2. Probe. Every rolling run of b words of every document is looked up in the bitmap. What passes is counted by hash, over
   documents: the anchors are the hashes that occur in two or more. (The bitmap only saves the exchange of runs that are
   no block anywhere; the count is exact.)
3. Extend. Each window next to an anchor, that is with an anchor within its first b + 1 runs, is hashed whole. A window's
   hash is compared within the task, and exchanged with its document if none there is smaller; those whose smallest document
   is another one are repeats. Runs of such
   windows are the maximal exact repeats, and their words are removed.

Documents with the same words throughout need none of that: the smallest id stands for them, and each other one loses all its
words if it has a window. Windows of a hot passage are pre-aggregated by hash before the exchange, and joined back by a skew
join; no group is collected but a document's own windows. Texts are read again in each pass rather than moved; only those that lose
words are exchanged.

Defined results: a null text has no words, and ``kept_sha256`` is that of the empty string. A row without an id keeps
everything and is no reference. Rows that repeat an id are one document to others, and don't remove each other's words.
Equality is that of two 64-bit hashes over the words of a window, of 128-bit hashes for whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap
from .shared import written
from .wordhash import Words, each_text, mix64, rolling

WINDOW = 50
#: Windows compared within a task before the rest is exchanged.
SETTLE = 1 << 21
CUT = Words()
NOTHING = hashlib.sha256(b"").hexdigest()


def _digest(value: np.ndarray) -> bytes:
    return hashlib.blake2b(value.tobytes(), digest_size=16).digest()


def _checks(value: np.ndarray, n: int) -> np.ndarray:
    """A second hash of every run of n words, over word hashes of its own."""
    return rolling(mix64(~value), n)


def _part(digest: bytes) -> int:
    """Tells apart texts that share an id."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*parts, np.zeros(0, dtype=kind)]).astype(kind)))


def text_table(docs: DataFrame, window: int) -> DataFrame:
    """``id, part, n_words, digest, sha, blocks``: the words' number and hashes, that of the text with single spaces, and the aligned blocks' hashes."""
    half = window // 2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, shas, blocks = [], [], [], []
            for _, body, _, _, value in each_text(batch.column(1), CUT):
                sizes.append(len(value))
                digests.append(_digest(value))
                shas.append(hashlib.sha256(b" ".join(body.tobytes().split())).hexdigest())
                blocks.append(rolling(value, half)[::half].view(np.int64) if len(value) >= window else np.zeros(0, dtype=np.int64))
            columns = [pa.array([_part(d) for d in digests], type=pa.int64()), pa.array(sizes, type=pa.int64()), pa.array(digests, type=pa.binary()), pa.array(shas, type=pa.string()), _lists(blocks, np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "part", "n_words", "digest", "sha", "blocks"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(build, f"id {kind}, part long, n_words long, digest binary, sha string, blocks array<long>")


def _anchor_hits(docs: DataFrame, references, blocks, window: int) -> DataFrame:
    """``id, hits``: the distinct rolling half-window hashes of a document that may be a block."""
    half = window // 2

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(references.value.test(batch.column(2).to_numpy().view(np.uint64)))
            ids, hits = [], []
            part = batch.filter(keep)
            for row, _, _, _, value in each_text(part.column(1), CUT):
                if len(value) >= window:
                    runs = rolling(value, half)
                    ids.append(row)
                    hits.append(np.unique(runs[blocks.value.test(runs)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids, type=pa.int64())), _lists(hits, np.int64)], names=["id", "hits"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", F.xxhash64("id")).mapInArrow(probe, f"id {kind}, hits array<long>")


def _windows(docs: DataFrame, references, anchors, window: int) -> DataFrame:
    """``id, part, at, hash, check`` (arrays) of the windows next to an anchor; ``part`` tells apart texts that share an id.

    A window that a smaller document of the same task has as well is known to be a repeat and isn't exchanged; these
    are ``gone_at, gone_n``, first windows and lengths of runs.
    """
    half = window // 2

    def settle(held: list[tuple]) -> pa.RecordBatch:
        ids = pa.concat_arrays([pa.array([h[0].as_py()], type=h[0].type) for h in held])
        sizes = np.array([len(h[2]) for h in held])
        ranks = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        rank, hashes, checks = np.repeat(ranks, sizes), np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        order = np.lexsort((rank, checks, hashes))
        first = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (checks[order][1:] != checks[order][:-1])])
        least = rank[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        gone = np.zeros(len(hashes), dtype=bool)
        gone[order] = rank[order] > least
        ats, keeps, second, runs, lengths, low = [], [], [], [], [], 0
        for (_, _, at, own, check), size in zip(held, sizes.tolist(), strict=True):
            out = gone[low : low + size]
            low += size
            ats.append(at[~out])
            keeps.append(own[~out].view(np.int64))
            second.append(check[~out].view(np.int64))
            lost = at[out]
            cuts = np.flatnonzero(np.concatenate([[True], lost[1:] != lost[:-1] + 1])) if len(lost) else np.zeros(0, dtype=np.int64)
            runs.append(lost[cuts])
            lengths.append(np.diff(np.append(cuts, len(lost))))
        columns = [ids, pa.array([h[1] for h in held], type=pa.int64()), _lists(ats, np.int32), _lists(keeps, np.int64), _lists(second, np.int64), _lists(runs, np.int32), _lists(lengths, np.int32)]
        return pa.RecordBatch.from_arrays(columns, names=["id", "part", "at", "hash", "check", "gone_at", "gone_n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            part = batch.filter(pa.array(references.value.test(batch.column(2).to_numpy().view(np.uint64))))
            for row, _, _, _, value in each_text(part.column(1), CUT):
                if len(value) < window:
                    continue
                near = np.concatenate([[0], np.cumsum(anchors.value.test(rolling(value, half)))])
                n = len(value) - window + 1
                at = np.flatnonzero(near[half + 1 : half + 1 + n] > near[:n])
                if len(at):
                    held.append((part.column(0)[row], _part(_digest(value)), at.astype(np.int32), rolling(value, window)[at], _checks(value, window)[at]))
                    n_held += len(at)
                    if n_held >= SETTLE:
                        yield settle(held)
                        held, n_held = [], 0
        if held:
            yield settle(held)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", F.xxhash64("id")).mapInArrow(cut, f"id {kind}, part long, at array<int>, hash array<long>, check array<long>, gone_at array<int>, gone_n array<int>")


def repeats(docs: DataFrame, window: int = WINDOW, table: DataFrame | None = None) -> DataFrame:
    """``id, part, at, gone_at, gone_n``: the windows that also start in a document with a smaller id, as first words and as
    runs; of equal texts only the first is looked at."""
    rows = (table if table is not None else written(text_table(docs, window), "texts")).filter(F.col("id").isNotNull() & (F.col("n_words") >= window))
    firsts = written(rows.groupBy("digest").agg(F.min("id").alias("id"), F.max(F.size("blocks")).cast("long").alias("n")), "firsts")
    size = firsts.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("blocks")).first()
    known = docs.filter(F.col("id").isNotNull())
    references = bitmap(firsts.select(F.xxhash64("id").alias("h")), size["docs"])
    blocks = bitmap(rows.join(firsts.select("digest", "id"), ["digest", "id"], "left_semi").select(F.explode("blocks").alias("h")), size["blocks"], probes=3)
    hits = _anchor_hits(known, references, blocks, window).select("id", F.explode("hits").alias("h"))
    anchors = written(hits.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("h"), "anchors")
    near = written(_windows(known, references, bitmap(anchors, anchors.count(), bits_per_key=48, probes=4), window), "windows")
    each = near.select("id", "part", F.explode(F.arrays_zip("at", "hash", "check")).alias("w")).select("id", "part", "w.at", "w.hash", "w.check")
    first = each.groupBy("hash", "check").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("hash", "check", "low")
    found = each.join(first, ["hash", "check"]).filter(F.col("id") > F.col("low")).groupBy("id", "part").agg(F.collect_list("at").alias("found"))
    runs = near.groupBy("id", "part").agg(F.first("gone_at").alias("gone_at"), F.first("gone_n").alias("gone_n"))
    out = runs.join(found, ["id", "part"], "left").filter("found is not null or size(gone_at) > 0")
    return out.select("id", "part", F.coalesce("found", F.array().cast("array<int>")).alias("at"), "gone_at", "gone_n")


def _without(docs: DataFrame, removed: DataFrame, window: int) -> DataFrame:
    """``id, part, n_removed, kept``: texts of the documents in ``removed`` without the words that their windows cover."""
    touched = written(removed, "removed")
    chosen = bitmap(touched.select(F.xxhash64("id").alias("h")), touched.count())
    kind = docs.schema["id"].dataType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(chosen.value.test(batch.column(2).to_numpy().view(np.uint64))))
            keys = [_part(_digest(value)) for *_, value in each_text(part.column(1), CUT)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, type=pa.int64()), part.column(1)], names=["id", "part", "text"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept = [], []
            for text, at, run, n in zip(*[batch.column(k) for k in (2, 3, 4, 5)], strict=True):
                tokens = text.as_py().encode().split()
                marks = np.zeros(len(tokens) + 1, dtype=np.int64)
                starts, runs = at.values.to_numpy(), run.values.to_numpy()
                np.add.at(marks, np.concatenate([starts, runs]), 1)
                np.add.at(marks, np.concatenate([starts + window, runs + n.values.to_numpy() - 1 + window]), -1)
                stays = np.cumsum(marks)[:-1] == 0
                gone.append(len(tokens) - int(stays.sum()))
                kept.append(b" ".join([t for t, s in zip(tokens, stays.tolist(), strict=True) if s]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, type=pa.int64()), pa.array(kept, type=pa.string())], names=["id", "part", "n_removed", "kept"])

    texts = docs.filter(F.col("id").isNotNull()).select("id", "text", F.xxhash64("id")).mapInArrow(pick, f"id {kind}, part long, text string").dropDuplicates(["id", "part"])
    joined = texts.join(touched, ["id", "part"]).select("id", "part", "text", "at", "gone_at", "gone_n")
    return joined.mapInArrow(strip, f"id {kind}, part long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256`` of every row."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = written(text_table(texts, window), "texts")
    removed = repeats(texts, window, table)
    cut = _without(texts, removed, window).select("id", "part", "n_removed", F.sha2("kept", 256).alias("kept_sha"))
    firsts = written(table.filter(F.col("id").isNotNull() & (F.col("n_words") >= window)).groupBy("digest").agg(F.min("id").alias("first")), "firsts")
    rows = table.select("id", "part", "n_words", "digest", "sha").join(firsts, "digest", "left").join(cut, ["id", "part"], "left")
    copy = F.col("id") > F.col("first")
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )

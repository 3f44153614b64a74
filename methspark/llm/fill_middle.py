"""Fill-in-the-middle: texts cut into prefix, middle and suffix at the borders of lines, and put together in the order psm or spm.

A Split pre-tokenizer with isolated matches of a regex cuts the text into units, which need no vocabulary and no training, and gives each unit's
offsets in code points. With 0 before them these ends are the offset array: its length less one is the number n of units, and the entries at two
ranks drawn for the document cut the text into its three slices. The ranks, and the form, come from a SHA-256 of seed and id, so a
document has the same ones in every run and in any partitioning, and no rows move.

A text goes through the pre-tokenizer in pieces of ``PIECE`` code points: a unit ends at a line feed or at the end of the text, so an end that
is neither is only that of the piece, and is left out. Memory so stays bounded by the text itself, of whatever length its lines are.

Defined results: a null text is an empty one, and comes out empty and plain; a null id is written as nothing in what is hashed. A text that
contains one of the marks is left plain, so that ``restored`` can tell the slices apart. Rows that repeat an id are cut at the same ranks
(modulo their own numbers of units). Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

#: A unit: a line with its line feed, or what stands after the last one.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Code points that the pre-tokenizer gets at a time.
PIECE = 4096
#: Code points of text in a batch of the result; a longer text is a batch of its own.
BATCH = 1 << 22


def unit_ends(text: str, split: pre_tokenizers.Split, piece: int = PIECE) -> np.ndarray:
    """The offset array: 0 and the end of every unit."""
    found = [np.zeros(1, dtype=np.int64)]
    for at in range(0, len(text), piece):
        part = text[at : at + piece]
        found.append(np.fromiter((end for _, (_, end) in split.pre_tokenize_str(part)), dtype=np.int64) + at)
        if not part.endswith("\n") and at + piece < len(text):
            found[-1] = found[-1][:-1]
    return np.concatenate(found)


def draws(seed: int, name: str) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def rearranged(text: str, name: str, split: pre_tokenizers.Split, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, and the text in its new order."""
    ends = unit_ends(text, split)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(seed, name)
    if not n or h3 % 100 >= rate or any(mark in text for mark in MARKS):
        return n, "plain", None, None, text
    low, high = (int(ends[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    p, s, m = MARKS
    if h4 % 100 < spm:
        return n, "spm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of every row.

    ``rate`` percent of the documents are rearranged, ``spm`` percent of these with the suffix first.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokenizers.Split(Regex(LINES), "isolated")

        def batch_of(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([ids, *columns], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

        for batch in batches:
            rows, first, size = [], 0, 0
            for k, (name, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                text = text.as_py() or ""
                name = name.as_py()
                rows.append(rearranged(text, "" if name is None else str(name), split, seed, rate, spm))
                size += len(text)
                if size >= BATCH:
                    yield batch_of(batch.column(0).slice(first, k + 1 - first), rows)
                    rows, first, size = [], k + 1, 0
            if rows:
                yield batch_of(batch.column(0).slice(first), rows)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    slices = F.split(output, "|".join(re.escape(m) for m in MARKS), -1)
    psm, spm = F.concat(slices[1], slices[3], slices[2]), F.concat(slices[2], slices[3], slices[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

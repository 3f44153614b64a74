"""Cytosine contexts of sequences: CpG, CHG and CHH sites, on whole reads, in one linear pass.

Sites come from an Arrow pass over the sequence bytes. A native lambda over ``substring(seq, i, 3)`` would scan from the start of
the string for every i, which is quadratic in the length of a read of tens of kilobases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXTS = ("CpG", "CHG", "CHH")
A, C, G, T, OTHER = range(5)
_CODE = np.full(256, OTHER, dtype=np.int8)
for _base, _code in zip("ACGT", range(4), strict=True):
    _CODE[ord(_base)] = _CODE[ord(_base.lower())] = _code
_COMPLEMENT = "ACGTacgt", "TGCAtgca"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *_COMPLEMENT))


def original_orientation(seq: Column, flag: Column) -> Column:
    """The read as sequenced: flag 16 means that it is stored reverse-complemented."""
    return F.when(flag.bitwiseAND(16) != 0, reverse_complement(seq)).otherwise(seq)


def opposite_position(n: Column, pos: Column, k: int) -> Column:
    """Where a k-mer at ``pos`` starts on the other strand of a sequence of length n."""
    return n - 1 - (pos + (k - 1))


def oriented_bases(seq: Column, start: Column, n: int, reverse: Column) -> Column:
    """The n bases from ``start`` on of the sequence, or of its reverse complement where ``reverse``."""
    forward = seq.substr(start + 1, F.lit(n))
    turned = reverse_complement(seq.substr(F.length(seq) - start - n + 1, F.lit(n)))
    return F.when(reverse, turned).otherwise(forward)


def codes(seq: str | bytes) -> np.ndarray:
    """Bases as 0-3, anything else as 4."""
    return _CODE[np.frombuffer(seq.encode() if isinstance(seq, str) else seq, dtype=np.uint8)]


#: Bases that each letter may be, as bits A 1, C 2, G 4, T 8 (fixed values of the IUPAC code); U is T.
MASKS = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}
_MASK = np.zeros(256, dtype=np.uint8)
for _letter, _bits in MASKS.items():
    _MASK[ord(_letter)] = _MASK[ord(_letter.lower())] = _bits


def base_masks(seq: str | bytes) -> np.ndarray:
    """The bits of each letter, in any case; 0 for a letter that is no base code, such as a gap."""
    return _MASK[np.frombuffer(seq.encode() if isinstance(seq, str) else seq, dtype=np.uint8)]


def turned_masks(masks: np.ndarray) -> np.ndarray:
    """Masks of the reverse complement: A and T, C and G change places."""
    m = masks[::-1]
    return ((m & 1) << 3) | ((m & 2) << 1) | ((m & 4) >> 1) | ((m & 8) >> 3)


def pattern_starts(masks: np.ndarray, pattern: str, possible: bool = False) -> np.ndarray:
    """Where a pattern of base codes stands: each letter of the sequence is certainly of its code (all its bases are among the code's), or, if
    ``possible``, may be (they share one)."""
    wanted = base_masks(pattern)
    n = max(0, len(masks) - len(wanted) + 1)
    fits = np.ones(n, dtype=bool)
    for k, code in enumerate(wanted):
        own = masks[k : k + n]
        fits &= (own & code) != 0 if possible else (own != 0) & ((own & ~code) == 0)
    return np.flatnonzero(fits)


def site_masks(c: np.ndarray) -> list[tuple[str, int, int, np.ndarray]]:
    """Context, strand, offset of the site from the motif's start, and the motifs' starts."""
    two, three = max(0, len(c) - 1), max(0, len(c) - 2)
    a, b = c[:two], c[1 : 1 + two]
    x, y, z = c[:three], c[1 : 1 + three], c[2 : 2 + three]
    not_g, not_c = lambda v: (v != G) & (v != OTHER), lambda v: (v != C) & (v != OTHER)
    return [
        ("CpG", 0, 0, np.flatnonzero((a == C) & (b == G))),
        ("CHG", 0, 0, np.flatnonzero((x == C) & not_g(y) & (z == G))),
        ("CHH", 0, 0, np.flatnonzero((x == C) & not_g(y) & not_g(z))),
        ("CHH", 1, 2, np.flatnonzero(not_c(x) & not_c(y) & (z == G))),
    ]


_FORWARD = np.frombuffer(b"ACGTN", dtype=np.uint8)


def motif_names(c: np.ndarray, starts: np.ndarray, k: int, strand: int) -> list[str]:
    """The k-mers at the starts, in the orientation of the cytosine."""
    mers = np.stack([c[starts + i] for i in range(k)], axis=1) if len(starts) else np.zeros((0, k), dtype=np.int8)
    if strand:
        mers = 3 - mers[:, ::-1]
    return [bytes(m).decode() for m in _FORWARD[mers]]


def chosen_contexts(names: str | tuple[str, ...]) -> tuple[str, ...]:
    """Contexts by name in any case, of a tuple or a list with commas; an unknown name is an error."""
    known = {c.lower(): c for c in CONTEXTS}
    parts = [n.strip() for n in (names.split(",") if isinstance(names, str) else names)]
    unknown = sorted(n for n in parts if n.lower() not in known)
    if unknown:
        raise ValueError(f"unknown contexts: {unknown}")
    return tuple(dict.fromkeys(known[n.lower()] for n in parts))


def motif_sites(reads: DataFrame, contexts: tuple[str, ...] = CONTEXTS, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """``id, qoff, strand, context, motif`` of every site of every read; the CHH sites of the other strand lie at their G."""
    contexts = chosen_contexts(contexts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 64):
                part = batch.slice(low, 64)
                rows, offsets, strands, names, motifs = [], [], [], [], []
                for k, seq in enumerate(part.column(1)):
                    c = codes(seq.as_py() or "")
                    for context, strand, shift, starts in site_masks(c):
                        if context in contexts and len(starts):
                            rows.append(np.full(len(starts), k))
                            offsets.append(starts + shift)
                            strands.append(np.full(len(starts), strand, dtype=np.int32))
                            names += [context] * len(starts)
                            motifs += motif_names(c, starts, 2 if context == "CpG" else 3, strand)
                at = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(at)),
                        pa.array(np.concatenate([*offsets, np.zeros(0, dtype=np.int64)]).astype(np.int32)),
                        pa.array(np.concatenate([*strands, np.zeros(0, dtype=np.int32)]).astype(np.int32)),
                        pa.array(names, type=pa.string()),
                        pa.array(motifs, type=pa.string()),
                    ],
                    names=[id_col, "qoff", "strand", "context", "motif"],
                )

    kind = reads.schema[id_col].dataType.simpleString()
    return reads.select(id_col, seq_col).mapInArrow(scan, f"`{id_col}` {kind}, qoff int, strand int, context string, motif string")


def motif_summary(reads: DataFrame, contexts: tuple[str, ...] = CONTEXTS, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """``id, context, strand, motif, n, offsets, last``: number, sum of offsets and last offset of the sites of every read, by motif.

    Counted within the pass by the motifs' numbers, so neither sites nor their names leave it.
    """
    contexts = chosen_contexts(contexts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(low, 1024) for whole in batches for low in range(0, len(whole), 1024)):
            found: list[tuple] = []
            for k, seq in enumerate(batch.column(1)):
                c = codes(seq.as_py() or "")
                for context, strand, shift, starts in site_masks(c):
                    if context not in contexts or not len(starts):
                        continue
                    size = 2 if context == "CpG" else 3
                    number = sum(c[starts + j].astype(np.int64) * 4 ** (size - 1 - j) for j in range(size))
                    n = np.bincount(number, minlength=4**size)
                    total = np.bincount(number, weights=starts + shift, minlength=4**size)
                    last = np.zeros(4**size, dtype=np.int64)
                    last[number] = starts + shift  # the starts rise, so the last one stays
                    found += [(k, context, strand, _mer(int(m), size, strand), int(n[m]), int(total[m]), int(last[m])) for m in np.flatnonzero(n)]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            columns = [pa.array([f[j] for f in found], type=t) for j, t in enumerate(kinds, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([f[0] for f in found], type=pa.int64())), *columns], names=[id_col, "context", "strand", "motif", "n", "offsets", "last"])

    kind = reads.schema[id_col].dataType.simpleString()
    return reads.select(id_col, seq_col).mapInArrow(scan, f"`{id_col}` {kind}, context string, strand int, motif string, n long, offsets long, last int")


def _mer(number: int, size: int, strand: int) -> str:
    """The k-mer of a number, in the orientation of the cytosine."""
    letters = [number >> 2 * (size - 1 - j) & 3 for j in range(size)]
    return "".join("ACGT"[3 - x if strand else x] for x in (letters[::-1] if strand else letters))


def triplet_counts(reads: DataFrame, seq_col: str = "seq") -> DataFrame:
    """``motif, n``: every triplet of known bases of all reads, 64 counts a batch leaving the pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64, dtype=np.int64)
        for batch in batches:
            for seq in batch.column(0):
                c = codes(seq.as_py() or "").astype(np.int64)
                if len(c) > 2:
                    x, y, z = c[:-2], c[1:-1], c[2:]
                    known = (x < OTHER) & (y < OTHER) & (z < OTHER)
                    total += np.bincount((16 * x + 4 * y + z)[known], minlength=64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([_mer(int(m), 3, 0) for m in at], type=pa.string()), pa.array(total[at])], names=["motif", "n"])

    return reads.select(seq_col).mapInArrow(scan, "motif string, n long").groupBy("motif").agg(F.sum("n").alias("n"))


def pattern_sites(reads: DataFrame, patterns: tuple[str, ...], possible: bool = False, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """``id, qoff, strand, pattern`` of every place of the patterns (base codes such as CHG or RCGY) on the read (0) and on its reverse complement (1).

    ``qoff`` is the leftmost base on the read. A palindrome stands on both strands. Letters of the read may be codes themselves, see ``pattern_starts``.
    """
    for p in patterns:
        if not p or not base_masks(p).all():
            raise ValueError(f"not a pattern of base codes: {p!r}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(low, 64) for whole in batches for low in range(0, len(whole), 64)):
            rows, offsets, kinds = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for k, seq in enumerate(batch.column(1)):
                masks = base_masks(seq.as_py() or "")
                for strand, own in enumerate((masks, turned_masks(masks))):
                    for j, p in enumerate(patterns):
                        starts = pattern_starts(own, p, possible)
                        rows.append(np.full(len(starts), k))
                        offsets.append(len(masks) - len(p) - starts[::-1] if strand else starts)
                        kinds.append(np.full(len(starts), 2 * j + strand))
            kind = np.concatenate(kinds)
            names = pa.array(patterns).take(pa.array(kind // 2))
            columns = [batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(offsets).astype(np.int32)), pa.array((kind % 2).astype(np.int32)), names]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "qoff", "strand", "pattern"])

    kind = reads.schema[id_col].dataType.simpleString()
    return reads.select(id_col, seq_col).mapInArrow(scan, f"`{id_col}` {kind}, qoff int, strand int, pattern string")


def context_of(triplet: Column) -> Column:
    """CpG, CHG or CHH of the cytosine that starts a k-mer of up to three bases; null if none or not known."""
    up = F.upper(triplet)
    return F.when(up.rlike("^CG"), "CpG").when(up.rlike("^C[ACT]G"), "CHG").when(up.rlike("^C[ACT][ACT]"), "CHH")

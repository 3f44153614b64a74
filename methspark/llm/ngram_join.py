"""N-gram Jaccard join over word shingles, exact, by token-combination prefixes.

Tokens are hashes of shingles. Each distinct token set is one node, so copies cost nothing further. Two sets with Jaccard
similarity of at least num/den share all but at most n - need of their n tokens, need = ceil(num n / den); so if a prefix
of each set in one global order holds n - need + 1 tokens, similar sets share one in it (prefix filter). Here:

* Order. Rare tokens come before frequent ones, each in order of hash. Frequent means in at least ``FREQUENT`` documents by an
  exact count over all of them. All of these, however many, go into a bitmap that is broadcast; past its size more rare tokens
  pass as frequent, which makes pairs of them but no bucket larger (the order only decides the cost, not the result).
* Signatures. A rare token of the prefix is a signature by itself. Frequent tokens are dealt into classes by hash, and the
  signatures are the pairs of tokens of one class; x tokens of a class earn x - 1 credits and a rare token one, and the prefix is
  extended until it has n - need + 1 credits, since so many tokens would have to go before no signature is left. The
  number of classes follows the size band [2^b, 2^(b+1)) of the set, n/8 to n/16, so a set has about as many signatures
  as it has prefix tokens; a set near the end of its band, which may be similar to one of the next, has those of the next
  as well. Bands under 8 tokens use single tokens.
* Candidates. Sets that share a signature: all pairs within a bucket of at most ``SMALL`` sets, counted over the buckets;
  pairs that can't share enough tokens in their prefixes are dropped by an exact bound. Larger buckets (sets made of frequent
  tokens: large groups of near copies) are linked in rounds by what their sets differ in from a reference, see
  ``_large_buckets``.
* Verification counts shared tokens on the whole sets, or on their whole differences from one reference. Links go to connected components, never to the driver.

Memory is bounded by a task's piece of text, the bitmap of frequent tokens and one longest text. Hot tokens are counted in
each task before they are exchanged.

Defined results: words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than a shingle has its
whole sequence as its only token; one without words (or null) has none and links with nothing. Repeated rows are one node
and each gets the result. A row without an id takes part, but never names a component (null if no other row does).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import Bitmap, bitmap
from .components import components
from .shared import written
from .wordhash import Words, each_text, mix64, shingles

CUT = Words(lower=True)
FREQUENT = 32
SMALL = 32
#: Rounds in which large buckets with the same pivot are one group.
ROUNDS = 3
#: About so many sets of a pivot decide on its reference.
VOTERS = 64
#: A pivot's tokens to a slice; votes are counted slice by slice.
SLICE = 1 << 16
#: Tokens counted together before they leave a task.
FLUSH = 1 << 19
#: Bits of a token that counting looks at, besides those of its slice.
COUNTED_BITS = 32


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind) if n else np.zeros(0, dtype=kind)


def frequent_tokens(docs: DataFrame, n: int, slices_bits: int) -> Broadcast:
    """Bitmap of the mixed heads (``slices_bits + COUNTED_BITS`` high bits) of all tokens in at least FREQUENT documents, counted over all.

    A task sorts the heads of up to FLUSH tokens at a time and sends, for each slice of the hash space, the distinct ones as
    differences and their counts; one small task a slice merges these.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
            heads, times = np.unique(np.concatenate(parts) >> np.uint64(64 - slices_bits - COUNTED_BITS), return_counts=True)
            cuts = np.searchsorted(heads >> np.uint64(COUNTED_BITS), np.arange((1 << slices_bits) + 1))
            low = (heads & np.uint64((1 << COUNTED_BITS) - 1)).astype(np.uint32)
            rows = [k for k in range(1 << slices_bits) if cuts[k + 1] > cuts[k]]
            at = [(cuts[k], cuts[k + 1]) for k in rows]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, type=pa.int32()),
                    pa.array([b - a for a, b in at], type=pa.int32()),
                    pa.array([_packed(np.diff(low[a:b], prepend=np.uint32(0))) for a, b in at], type=pa.binary()),
                    pa.array([_packed(times[a:b].astype(np.uint32)) for a, b in at], type=pa.binary()),
                ],
                names=["slice", "n", "heads", "times"],
            )

        parts, held = [], 0
        for batch in batches:
            for *_, value in each_text(batch.column(0), CUT):
                parts.append(np.unique(shingles(value, n)))
                held += len(parts[-1])
                if held >= FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    def merge(table: pa.Table) -> pa.Table:
        heads, times = [], []
        for k, a, b in zip(table["n"].to_pylist(), table["heads"].to_pylist(), table["times"].to_pylist(), strict=True):
            heads.append(np.cumsum(_unpacked(a, k, np.uint32), dtype=np.uint32))
            times.append(_unpacked(b, k, np.uint32))
        all_heads, all_times = np.concatenate(heads), np.concatenate(times)
        order = np.argsort(all_heads, kind="stable")
        all_heads = all_heads[order]
        first = np.flatnonzero(np.concatenate([[True], all_heads[1:] != all_heads[:-1]]))
        total = np.add.reduceat(all_times[order].astype(np.int64), first)
        found = all_heads[first][total >= FREQUENT].astype(np.uint64) + np.uint64(table["slice"][0].as_py() << COUNTED_BITS)
        return pa.table({"h": pa.array(mix64(found).view(np.int64))})

    sent = docs.select("text").mapInArrow(count, "slice int, n int, heads binary, times binary")
    often = written(sent.groupBy("slice").applyInArrow(merge, "h long"), "frequent")
    return bitmap(often, often.count())


def signatures(tokens: np.ndarray, often: np.ndarray, num: int, den: int) -> tuple[list[int], int, int]:
    """Signatures of a sorted token set, the tokens it has beyond its prefix, and the frequent tokens in its prefix."""
    n = len(tokens)
    if not n:
        return [], 0, 0
    credits = n + (-num * n // den) + 1  # n - ceil(num n / den) + 1
    rare, freq = tokens[~often], tokens[often]
    out = rare[:credits].view(np.int64).tolist()
    if len(rare) >= credits:
        return out, n - credits, 0
    wanted, longest, shortest = credits - len(rare), 0, n
    band = n.bit_length() - 1
    for b in (band, band + 1) if n * den // num >= 2 << band else (band,):
        salt = np.uint64(b + 1)
        if b < 3:
            chosen = freq[:wanted]
            out += mix64(chosen ^ mix64(np.array([salt]))).view(np.int64).tolist()
        else:
            group = (mix64(freq) & np.uint64((1 << (b - 3)) - 1)).astype(np.int64)
            again = np.ones(len(freq), dtype=bool)
            again[np.unique(group, return_index=True)[1]] = False
            size = int(np.searchsorted(np.cumsum(again), wanted)) + 1
            chosen = freq[:size]
            order = np.argsort(group[:size], kind="stable")
            ordered, cuts = chosen[order], np.flatnonzero(np.diff(group[:size][order])) + 1
            for part in np.split(ordered, cuts):
                if len(part) > 1:
                    i, j = np.triu_indices(len(part), 1)
                    with np.errstate(over="ignore"):
                        out += mix64(mix64(part[i] + salt) * np.uint64(3) + part[j]).view(np.int64).tolist()
        longest, shortest = max(longest, len(chosen)), min(shortest, len(chosen))
    return out, n - len(rare) - shortest, longest


def token_table(docs: DataFrame, often: Broadcast, slices_bits: int, n: int, num: int, den: int) -> DataFrame:
    """For each row: ``id, n, key`` (hash of the whole set), its signatures and what the bound needs."""
    shift = np.uint64(64 - slices_bits - COUNTED_BITS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Bitmap = often.value
        for batch in batches:
            sizes, keys, sigs, tails, freqs = [], [], [], [], []
            for *_, value in each_text(batch.column(1), CUT):
                tokens = np.unique(shingles(value, n))
                got, tail, freq = signatures(tokens, known.test(mix64(tokens >> shift)), num, den)
                sizes.append(len(tokens))
                keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                sigs.append(np.unique(np.asarray(got, dtype=np.int64)))
                tails.append(tail)
                freqs.append(freq)
            flat = pa.array(np.concatenate(sigs)) if sigs else pa.array([], type=pa.int64())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, type=pa.int64()), pa.array(keys, type=pa.binary()), pa.array(tails, type=pa.int32()), pa.array(freqs, type=pa.int32()), pa.ListArray.from_arrays(offsets, flat)],
                names=["id", "n", "key", "tail", "freq", "sigs"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(build, f"id {kind}, n long, key binary, tail int, freq int, sigs array<long>")


def _token_sets(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``v, tokens, crowded`` of the nodes in ``wanted`` (``v, crowded``), a folder for either kind; texts are read again, not moved."""
    chosen = written(wanted.join(nodes.select("v", "key", "label"), "v"), "wanted")
    hashed = chosen.filter("label is not null").select(F.xxhash64("label").alias("h"))
    keys = bitmap(hashed, chosen.count())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keep = pa.array(keys.value.test(h) | batch.column(2).to_numpy(zero_copy_only=False))
            texts = batch.column(1).filter(keep)
            sets = [np.unique(shingles(value, n)) for *_, value in each_text(texts, CUT)]
            if sets:
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], type=pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], names=["key", "tokens"])

    found = docs.select(F.xxhash64("id"), "text", F.col("id").isNull()).mapInArrow(build, "key binary, tokens array<long>")
    found = found.groupBy("key").agg(F.first("tokens").alias("tokens")).join(chosen.select("key", "v", "crowded"), "key")
    return written(found.select("v", "tokens", "crowded"), "token-sets", "crowded")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` whose whole token sets are similar enough."""
    one = sets.select(F.col("v").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("v").alias("b"), F.col("tokens").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb")).cast("long")
    enough = shared * F.lit(den) >= (F.size("ta") + F.size("tb") - shared) * F.lit(num)
    return pairs.select("a", "b").join(one, "a").join(two, "b").filter(enough).select("a", "b")


def nodes_and_labels(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (``id, n, key``), nodes (``key, v, label``) and the component of every linked node (``v, comp``)."""
    slices_bits = min(16, max(6, (docs.count() >> 12).bit_length()))
    often = frequent_tokens(docs, n, slices_bits)
    rows = written(token_table(docs, often, slices_bits, n, num, den), "rows")
    whole = F.first(F.struct("n", "tail", "freq", "sigs")).alias("s")
    nodes = rows.filter("n > 0").groupBy("key").agg(F.min("id").alias("label"), whole).select("key", "label", "s.*")
    nodes = written(nodes.withColumn("v", F.monotonically_increasing_id()), "nodes")
    posted = nodes.select("v", F.explode("sigs").alias("sig"))
    often_met = posted.groupBy("sig").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    buckets = written(posted.join(often_met, "sig"), "buckets")

    # all pairs of the small buckets, counted, with the bound on what their prefixes must share
    small, large = buckets.filter(F.col("sets") <= SMALL), buckets.filter(F.col("sets") > SMALL)
    unseen = large.groupBy("v").agg(F.count(F.lit(1)).alias("unseen"))
    facts = nodes.select("v", "n", "tail", "freq")
    met = small.select("v").distinct().join(facts, "v").join(unseen, "v", "left").select("v", "n", "tail", (F.col("freq") + F.coalesce("unseen", F.lit(0))).alias("more"))
    met = written(met, "met")
    ends = small.join(met, "v").select("sig", "v", "n")
    one, two = (ends.select("sig", F.col("v").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    counted = one.join(two, "sig").filter(fits).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    fact = [met.select(F.col("v").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "tail", "more")]) for x in "ab"]
    overlap = F.ceil((F.col("na") + F.col("nb")) * num / (num + den) - 1e-9)
    least = overlap - F.greatest("taila", "tailb")
    pairs = counted.join(fact[0], "a").join(fact[1], "b").filter(F.col("shared") + F.least("morea", "moreb") >= least).select("a", "b")
    pairs = written(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("v"), F.lit(False).alias("crowded")).union(large.select("v", F.lit(True)))
    sets = _token_sets(docs, wanted.groupBy("v").agg(F.max("crowded").alias("crowded")), nodes, n)
    labels = components(written(_verified(pairs, sets, num, den), "verified"))
    if not large.isEmpty():
        labels = _large_buckets(large, sets.filter("crowded"), labels, num, den)
    return rows, nodes, labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links; ``labels`` itself if there are none."""
    return labels if links.isEmpty() else components(labels.select(F.col("v").alias("a"), F.col("comp").alias("b")).union(links))


def _turned(voters: DataFrame) -> DataFrame:
    """``g, f_in, f_out``: of each group the tokens in ``minus`` and in ``plus`` of more than half of its rows.

    A row stays a row for each slice of its tokens (one but for long texts) and is never spread by token: in the sorted tokens of
    v rows, those of more than v / 2 have an equal one v // 2 places on.
    """
    ballots = voters.select("g", "minus", "plus", "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    own = {c: F.filter(c, lambda t: F.pmod(t, F.col("slices")) == F.col("slice")) for c in ("minus", "plus")}
    polled = ballots.groupBy("g", "slice").agg(F.floor(F.count(F.lit(1)) / 2).cast("int").alias("half"), *[F.sort_array(F.flatten(F.collect_list(x))).alias(c) for c, x in own.items()])
    most = {c: F.expr(f"array_distinct(filter({c}, (t, i) -> t = get({c}, i + half)))") for c in ("minus", "plus")}
    return polled.select("g", *[x.alias(c) for c, x in most.items()]).groupBy("g").agg(F.flatten(F.collect_list("minus")).alias("f_in"), F.flatten(F.collect_list("plus")).alias("f_out"))


def _large_buckets(large: DataFrame, sets: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Labels after all links within large buckets (``sig, v``), found in rounds over differences from a reference set.

    Similar means that the symmetric difference of x and y has at most c (nx + ny) tokens, c = (den - num) / (den + num). With
    D(x) the difference of x from any one reference set, it has |D(x)| + |D(y)| - 2 |D(x) and D(y)| tokens. So let s(x) = |D(x)| - c nx.

    * Where s(x) + s(y) <= 0 the two are linked for certain, and then each of them is linked to the set with the least s as
      well, so a star around that one joins all such pairs.
    * Any other link has at least (s(x) + s(y)) / 2 > 0 common tokens in D(x) and D(y), so prefixes of the D in one order that
      leave out fewer share one. Only links to another component matter, hence s(y) is at least the least s of the
      other components; and as D(y) has the common tokens, s(y) >= s(x) - 2 c ny, where ny <= nx den / num. So x posts
      |D(x)| - (s(x) + the greater of these) / 2 + 1 tokens: under 2 c nx den / num + 2 in any case, and none where that many
      common tokens are more than it has, as for a group of near copies and sets far from it.

    The reference is a bucket's pivot, turned in every token in which more than half of about ``VOTERS`` of its sets differ from
    it, so that within a group of near copies D(x) holds a copy's own edits, which few others share. Tokens beyond the
    reference come before those that a set lacks, which many share. Any reference and order give the same links; good ones leave
    little to compare.

    Tokens of prefixes that more than ``SMALL`` sets share are the buckets of the next round, until none is left with two components.
    Buckets with the same pivot are one group for ``ROUNDS`` rounds; from then on each is a group of its own, where all sets
    agree in the bucket's token and so do all later references: a token more each round, so the rounds end.
    """
    members = large.select("sig", "v")
    near, far = den + num, den - num
    turn = 0
    while True:
        now = members.join(labels, "v", "left").select("sig", "v", F.coalesce("comp", "v").alias("comp"))
        split = now.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct(F.xxhash64(F.lit(turn), "v").alias("h"), F.col("v"))).alias("p"))
        split = written(split.filter("low <> high").select("sig", F.col("p.v").alias("p"), F.col("p.v" if turn < ROUNDS else "sig").alias("g")), "split")
        if split.isEmpty():
            return labels
        group = now.join(split, "sig").select("g", "p", "v", "comp").distinct()
        tokens = group.join(sets.select(F.col("v").alias("p"), F.col("tokens").alias("tp")), "p").join(sets.select("v", "tokens"), "v")
        apart = written(tokens.select("g", "v", "comp", F.size("tokens").alias("n"), F.ceil(F.size("tp") / SLICE).cast("int").alias("slices"), F.array_except("tp", "tokens").alias("minus"), F.array_except("tokens", "tp").alias("plus")), "apart")

        # the reference: what most of the voters have
        sizes = apart.groupBy("g").agg(F.count(F.lit(1)).alias("all"))
        voters = apart.join(sizes, "g").filter(F.pmod(F.xxhash64(F.lit(turn), "v"), F.col("all")) < VOTERS)
        turned = _turned(voters)
        none = F.array().cast("array<long>")
        f_in, f_out = F.coalesce("f_in", none), F.coalesce("f_out", none)
        lacking = F.concat(F.array_except("minus", f_in), F.array_except(f_out, "plus"))
        beyond = F.concat(F.array_except("plus", f_out), F.array_except(f_in, "minus"))
        apart = apart.join(turned, "g", "left").select("g", "v", "comp", "n", F.concat(F.array_sort(beyond), F.array_sort(lacking)).alias("d"))
        apart = written(apart.withColumn("s", F.size("d") * near - F.col("n") * far), "apart")

        # the star
        centre = apart.groupBy("g").agg(F.min(F.struct("s", "v", "comp")).alias("x"))
        star = apart.join(centre, "g").filter((F.col("x.s") + F.col("s") <= 0) & (F.col("x.comp") != F.col("comp"))).select(F.col("x.v").alias("a"), F.col("v").alias("b"))
        labels = _joined(labels, written(star, "star"))

        # prefixes
        known = apart.drop("comp").join(labels, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
        lows = known.groupBy("g", "comp").agg(F.min("s").alias("s"))
        first = lows.groupBy("g").agg(F.min(F.struct("s", "comp")).alias("m"))
        other = lows.join(first, "g").filter(F.col("comp") != F.col("m.comp")).groupBy("g", "m").agg(F.min("s").alias("s_other"))
        least = F.greatest(F.when(F.col("comp") == F.col("m.comp"), F.col("s_other")).otherwise(F.col("m.s")), F.col("s") - F.col("n") * (2 * far * den / num))
        common = F.greatest(F.lit(1), F.ceil((F.col("s") + least) / (2 * near) - 1e-9)).cast("int")
        posting = known.join(other, "g").withColumn("tail", common - 1).filter(F.col("tail") < F.size("d"))
        spread = posting.select("g", "v", "s", "n", "comp", "tail", F.size("d").alias("size"), F.explode(F.slice("d", 1, F.size("d") - F.col("tail"))).alias("t"))
        shared = spread.groupBy("g", "t").agg(F.count(F.lit(1)).alias("sets"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("sets > 1 and low <> high").select("g", "t", "sets")
        spread = written(spread.join(shared, ["g", "t"]), "spread")

        # pairs of small buckets, bounded by what they share, then by the whole differences
        hot = spread.filter(F.col("sets") > SMALL)
        many = hot.groupBy("g", "v").agg(F.count(F.lit(1)).alias("hot"))
        about = ("v", "s", "n", "comp", "tail", "size")
        one, two = (spread.filter(F.col("sets") <= SMALL).select("g", "t", *[F.col(c).alias(f"{c}_{side}") for c in about]) for side in "ab")
        apart_by = F.col("s_a") + F.col("s_b")
        fits = (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (apart_by > 0) & (apart_by <= F.least("size_a", "size_b") * (2 * near))
        met = one.join(two, ["g", "t"]).filter((F.col("v_a") < F.col("v_b")) & (F.col("comp_a") != F.col("comp_b")) & fits)
        met = met.groupBy("g", "v_a", "v_b", apart_by.alias("by"), F.greatest("tail_a", "tail_b").alias("tail")).agg(F.count(F.lit(1)).alias("shared"))
        for side in "ab":
            met = met.join(many.select("g", F.col("v").alias(f"v_{side}"), F.col("hot").alias(f"hot_{side}")), ["g", f"v_{side}"], "left")
        unseen = F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0))) + F.col("tail")
        met = written(met.filter((F.col("shared") + unseen) * (2 * near) >= F.col("by")).select("g", "v_a", "v_b", "by"), "pairs")
        if not met.isEmpty():
            for side in "ab":
                met = met.join(apart.select("g", F.col("v").alias(f"v_{side}"), F.col("d").alias(f"d_{side}")), ["g", f"v_{side}"])
            sure = met.filter(F.size(F.array_intersect("d_a", "d_b")) * (2 * near) >= F.col("by"))
            labels = _joined(labels, written(sure.select(F.col("v_a").alias("a"), F.col("v_b").alias("b")), "verified"))
        members = written(hot.select(F.xxhash64("g", "t").alias("sig"), "v"), "large")
        turn += 1


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``id, n_shingles, component_id`` for every row: sets link at Jaccard similarity num/den (over one half) or more."""
    if not 2 * num > den >= num:
        raise ValueError("num/den must be over one half and at most one")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, nodes, labels = nodes_and_labels(texts, n, num, den)
    named = nodes.join(labels, "v", "left").select("key", "label", F.coalesce("comp", "v").alias("comp"))
    least = named.groupBy("comp").agg(F.min("label").alias("component_id"))
    by_key = written(named.join(least, "comp").select("key", "component_id"), "by-key")
    return rows.select("id", "n", "key").join(by_key, "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.col("component_id"), F.col("id")).alias("component_id"))

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from methspark.llm import decontaminate, exact_dedup, ngram_join, substring_dedup
from methspark.llm.wordhash import PIECE, Words, each_text, rolling, shingles
from tests.llm import brute

SCHEMA = "doc_id long, text string, sets int, id string, n long, key string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "x", 2, "k") for i, t in rows], SCHEMA).repartition(parts)


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def near_copies(r, base, count, edits):
    out = []
    for _ in range(count):
        w = base.split()
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


# ---- hashing


def test_words_do_not_depend_on_place_or_piece():
    texts = ["a bb  ccc", None, "", " ccc\t\x0bbb\r\na ", "é ccc\u00a0x bb", "x" * (PIECE + 5) + " a " + "y" * (2 * PIECE)]
    got = [[h for h in value.tolist()] for *_, value in each_text(pa.array(texts), Words())]
    a, bb, ccc = got[0]
    assert got[1] == got[2] == [] and got[3] == [ccc, bb, a] and got[4][2] == bb and len(got[5]) == 3 and got[5][1] == a
    sliced = pa.array(["zz", *texts]).slice(1)
    assert [value.tolist() for *_, value in each_text(sliced, Words())] == got
    assert [v.tolist() for *_, v in each_text(pa.array(["A b"]), Words(lower=True))] == [v.tolist() for *_, v in each_text(pa.array(["a B"]), Words(lower=True))]


def test_rolling_hashes_are_those_of_the_runs():
    h = np.arange(1, 200, dtype=np.uint64) * np.uint64(77)
    for n in (2, 8, 25):
        assert rolling(h, n)[13] == rolling(h[13 : 13 + n], n)[0] and len(rolling(h, n)) == len(h) - n + 1
    assert len(rolling(h[:3], 5)) == 0 and len(shingles(h[:3], 5)) == 1 and len(shingles(h[:0], 5)) == 0
    assert shingles(h[:3], 5)[0] != shingles(h[:3], 3)[0]


# ---- exact dedup


def test_exact_dedup_keeps_one_of_each_text(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (6, "a "), (7, "A"), (8, "a")] + [(100 + k, "hot") for k in range(60)]
    for keep, pick in (("largest", max), ("smallest", min)):
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, rows, 7), keep=keep).collect()}
        for i, t in rows:
            group = [j for j, u in rows if (u or "") == (t or "")]
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (pick(group), len(group), i == pick(group), hashlib.sha256((t or "").encode()).hexdigest())


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []
    for keep in ("largest", "smallest"):
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, [(None, "a"), (5, "a"), (5, "a"), (None, "z")]), keep=keep).collect()), key=str)
        assert got == [(False, 5, 5, 3, True), (False, 5, 5, 3, True), (True, 0, 5, 3, False), (True, 0, None, 1, True)]


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.exact_dedup(frame(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# ---- n-gram join


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 4, 5), (1, 7, 10)])
def test_ngram_components_equal_brute_force(spark, monkeypatch, n, num, den):
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    r = random.Random(n)
    texts = [prose(r, r.randint(1, 60)) for _ in range(40)]
    for size, count, edits in ((120, 40, 4), (40, 15, 2), (12, 25, 1), (7, 12, 1), (300, 20, 9)):
        texts += near_copies(r, prose(r, size), count, edits)
    texts += [texts[50]] * 8 + ["one", "One", "two words", "TWO words ", "", None, " \t\n"]
    passage = prose(r, 30)
    texts += [f"{prose(r, r.randint(5, 40))} {passage} {prose(r, 3)}" for _ in range(30)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    want = brute.linked_components(rows, n, num, den)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_components(frame(spark, rows), n=n, num=num, den=den).collect()}
    assert got == {i: (len(brute.shingle_set(t, n)), want[i]) for i, t in rows}


def test_ngram_signatures_never_miss_a_similar_pair():
    r, num, den = random.Random(3), 85, 100
    for trial in range(400):
        n = r.choice([1, 2, 5, 8, 9, 15, 16, 17, 31, 40, 64, 100, 200])
        a = {r.getrandbits(64) for _ in range(n)}
        b = set(a)
        while True:
            c = set(b)
            if r.random() < 0.5 and len(c) > 1:
                c.remove(r.choice(sorted(c)))
            else:
                c.add(r.getrandbits(64))
            if den * len(a & c) < num * len(a | c):
                break
            b = c
        share = r.choice([0.0, 0.5, 0.9, 1.0])
        often = {x for x in a | b if r.random() < share}
        sides = []
        for s in (a, b):
            tokens = np.array(sorted(s), dtype=np.uint64)
            sides.append(ngram_join.signatures(tokens, np.array([t in often for t in tokens.tolist()], dtype=bool), num, den))
        assert set(sides[0][0]) & set(sides[1][0]), (trial, n, share)


def exploded(spark, after):
    """Rows made by every Generate of the executions beyond the first ``after``, and the number of executions so far."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, made = store.executionsList(), []
    for k in range(after, runs.size()):
        run = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if node.name() == "Generate":
                found = [values.get(m.accumulatorId()) for m in (node.metrics().apply(i) for i in range(node.metrics().size())) if m.name() == "number of output rows"]
                made += [(int(x.get().replace(",", "")), node.desc()) for x in found if x.isDefined()]
    return made, runs.size()


def test_ngram_votes_make_no_row_for_each_token(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    r = random.Random(8)
    passage = prose(r, 60)
    rows = list(enumerate(near_copies(r, prose(r, 300), 40, 12) + [f"{prose(r, 100)} {passage}" for _ in range(40)]))
    before = exploded(spark, 0)[1]
    got = {x.doc_id: x.component_id for x in ngram_join.ngram_components(frame(spark, rows)).collect()}
    assert got == brute.linked_components(rows, 5, 4, 5)
    votes = [(n, what) for n, what in exploded(spark, before)[0] if "minus" in what]
    assert votes and max(n for n, _ in votes) <= 2 * len(rows) * 10, votes  # a set may be of several groups


@pytest.mark.parametrize("slices", [1, 3])
def test_ngram_votes_equal_a_plain_count(spark, slices):
    r, rows = random.Random(slices), []
    for g, n in enumerate((1, 2, 3, 8, 33)):
        rows += [(g, *([t for t in range(lo, lo + 12) if r.random() < t % 12 / 11] for lo in (-6, 100)), slices) for _ in range(n)]
    rows += [(9, [], [], slices), (9, [], [2**62], slices)]
    voters = spark.createDataFrame(rows, "g long, minus array<long>, plus array<long>, slices int")
    got = {x.g: (sorted(x.f_in), sorted(x.f_out)) for x in ngram_join._turned(voters).collect()}
    for g in {x[0] for x in rows}:
        of = [x for x in rows if x[0] == g]
        assert got[g] == tuple(sorted(t for t in {t for x in of for t in x[k]} if 2 * sum(t in x[k] for x in of) > len(of)) for k in (1, 2))


def test_ngram_frequent_tokens_make_no_large_bucket_however_many(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 8, raising=False)  # beyond it frequent tokens used to be taken for rare ones
    r = random.Random(5)
    passage = prose(r, 30)
    rows = list(enumerate([f"{prose(r, 40, 10**6)} {passage}" for _ in range(30)] + [f"{prose(r, 60, 10**6)} x"] * 2))
    large = []
    monkeypatch.setattr(ngram_join, "_large_buckets", lambda buckets, sets, labels, num, den: large.append(buckets.count()) or labels)
    got = {x.doc_id: x.component_id for x in ngram_join.ngram_components(frame(spark, rows)).collect()}
    assert got == brute.linked_components(rows, 5, 4, 5) and not large


def test_ngram_edges(spark):
    assert ngram_join.ngram_components(frame(spark, [])).collect() == []
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "A B C D E F"), (9, None), (4, "x")])).collect()), key=str)
    assert got == [(False, 3, 2, 3), (False, 3, 2, 3), (False, 4, 1, 4), (False, 9, 0, 9), (True, 0, 2, 3)]
    with pytest.raises(ValueError, match="half"):
        ngram_join.ngram_components(frame(spark, []), num=1, den=2)


# ---- substring dedup


@pytest.mark.parametrize("weak", [False, True])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, weak):
    """With ``weak``, the first hash of a window has only 64 values, so that the second decides."""
    monkeypatch.setattr(substring_dedup, "SETTLE", 300)
    if weak:
        monkeypatch.setattr(substring_dedup, "rolling", lambda hashes, n: rolling(hashes, n) & np.uint64(63) if n == 10 else rolling(hashes, n))
    r = random.Random(5)
    passages = [prose(r, k) for k in (9, 10, 11, 15, 40)]
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(prose(r, r.randint(1, 25), 10**6) if r.random() < 0.5 else r.choice(passages))
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], prose(r, 30, 2), "a " * 40, "a " * 12, None, "", passages[4], passages[4].replace(" ", "\n\t")]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    want = brute.without_repeats(rows, 10)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.substring_dedup(frame(spark, rows, 5), window=10).collect()}
    assert got == want


def test_substring_dedup_edges(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).collect() == []
    long = prose(random.Random(1), 60)
    rows = [(7, long), (7, long), (7, "x " + long), (8, "y " + long), (None, long)]
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_words, x.n_removed) for x in substring_dedup.substring_dedup(frame(spark, rows)).collect())
    assert got == [(False, 7, 60, 0), (False, 7, 60, 0), (False, 7, 61, 0), (False, 8, 61, 60), (True, 0, 60, 0)]


# ---- decontamination


def test_decontamination_equals_brute_force(spark):
    r = random.Random(9)
    items = [(k, prose(r, r.randint(1, 60), 10**6)) for k in range(25)] + [(90, ""), (91, None), (92, "Two words"), (None, "no id at all here")]
    rows = []
    for k in range(60):
        parts = [prose(r, r.randint(0, 300), 10**6)]
        for _ in range(r.randint(0, 3)):
            w = r.choice(items[:25])[1].split()
            for _ in range(r.choice([0, 0, 1, 2, 8])):
                w[r.randrange(len(w))] = "changed"
            parts += [" ".join(w).upper() if r.random() < 0.3 else ", ".join(w), prose(r, 5, 10**6)]
        rows.append((k, " ".join(parts)))
    rows += [(100, items[3][1]), (101, None), (102, ""), (103, "two WORDS!"), (104, "not two words more"), (107, "two other words"), (105, items[4][1]), (106, items[4][1])]
    want = brute.contained(rows, [i for i in items if i[0] is not None], 5, 0.8)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.contamination(frame(spark, rows), bench).collect()}
    assert {i: x["items"] for i, x in got.items()} == want
    assert all(x.contaminated == bool(x["items"]) == (x.containment >= 0.8) and x.n_items == len(x["items"]) for x in got.values())
    kept = sorted(x.doc_id for x in decontaminate.without_contaminated(frame(spark, rows), bench).collect())
    assert kept == sorted(i for i, k in want.items() if not k)


def test_items_of_few_words_are_found_in_long_documents(spark):
    r = random.Random(19)
    items = [("one", "Zebra"), ("two", "blue zebra"), ("three", "a, blue zebra"), ("four", "saw a blue zebra"), ("five", "we saw a blue zebra"), ("none", "?!")]
    long = prose(r, 20_000).split()
    rows = [(k, " ".join([*long[: 1000 * k], *text.split(), *long[1000 * k :]])) for k, (_, text) in enumerate(items)] + [(10, "zebra"), (11, "blue"), (12, "BLUE-zebra"), (13, " ".join(long))]
    got = {x.doc_id: sorted(x["items"]) for x in decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == brute.contained(rows, items, 5, 0.8)
    assert got[4] == ["five", "four", "one", "three", "two"] and got[0] == got[10] == ["one"] and not got[5] and not got[11] and not got[13]


def test_decontamination_in_blocks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    items = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (2, "a b c d e f")], "item_id long, text string")
    rows = [(1, "x a b c d e f g h i j k l"), (1, "a b c d e f"), (2, "nothing"), (None, "g h i j k l")]
    got = sorted((str(x.doc_id), x["items"]) for x in decontaminate.contamination(frame(spark, rows), items).collect())
    assert got == [("1", [1, 2]), ("1", [1, 2, 2]), ("2", []), ("None", [2])]
    assert decontaminate.contamination(frame(spark, []), items).collect() == []
    none = items.filter("false")
    assert [x["items"] for x in decontaminate.contamination(frame(spark, [(1, "a")]), none).collect()] == [[]]
    assert decontaminate.without_contaminated(frame(spark, [(1, "a")]), none).count() == 1

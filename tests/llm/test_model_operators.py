import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from methspark.llm import language_id, lm_score, mixing


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, lang string, source string, label string, score double").repartition(3)


# ---- language ID


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(language_id.held_out()).toPandas()
    assert len(got) > 200 and (got.lang_pred == got.lang).mean() > 0.98 and got.score.between(0, 1).all()
    assert (model.weights == 0).mean() > 0.5, "L1 leaves most weights at zero"
    assert abs(got.score.mean() - (got.lang_pred == got.lang).mean()) < 0.05
    again = language_id.fit(docs.filter(~language_id.held_out()).repartition(5))
    assert np.array_equal(again.weights, model.weights) and again.temperature == model.temperature


def test_language_id_edges(spark):
    rows = [(k, "der die das und " * 3 if k % 2 else "the and of to " * 3, "de" if k % 2 else "en", "s") for k in range(40)]
    model = language_id.fit(frame(spark, rows + [(None, "x", "zz", "s"), (50, None, "zz", "s"), (51, "y", None, "s")]))
    assert model.labels == ["de", "en"]
    texts = [(1, None, None, None), (2, "", "en", None), (3, "123 .,!", None, None), (4, "und das", None, None), (4, "und das", None, None), (None, "the of " * 50_000, None, None)]
    got = sorted((str(r.doc_id), r.lang_pred, r.score > 0) for r in language_id.identify(frame(spark, texts), model).collect())
    assert got == [("1", "und", False), ("2", "und", False), ("3", "und", False), ("4", "de", True), ("4", "de", True), ("None", "en", True)]
    assert language_id.identify(frame(spark, []), model).collect() == []
    nothing = language_id.fit(frame(spark, []))
    assert nothing.predict("words") == ("und", 0.0)
    kept = language_id.accepted(frame(spark, texts), model)
    assert kept.columns == frame(spark, []).columns and kept.count() == 3


def test_repeated_rows_neither_fill_the_sample_nor_multiply(spark, monkeypatch):
    seen = {}

    def train(rows, held, idf, seed):
        seen.update(rows=rows, held=held)
        return language_id.Model([], None, None, None, 1.0)

    monkeypatch.setattr(language_id, "train", train)
    rows = [(1, "same text", "en")] * 1000 + [(k, "copied text", "en") for k in range(500)] + [(1, f"text {k}", "de") for k in range(1000)] + [(2, "same text", "de")]
    language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), per_language=100)
    texts = seen["rows"] + seen["held"]
    assert len(texts) == len(set(texts)) == 202 and {("en", "same text"), ("en", "copied text")} < set(texts) and abs(len(seen["rows"]) - len(seen["held"])) <= 2
    monkeypatch.setattr(language_id, "MOST_LABELS", 1)
    with pytest.raises(ValueError, match="labels"):
        language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_identify_keeps_columns_of_any_name(spark):
    model = language_id.train([("en", "the cat sat"), ("de", "der hund lag")], [], np.ones(language_id.DIM))
    df = spark.createDataFrame([(1, "the cat", "a", "b")], "doc_id long, text string, _text string, doc_id_text_ string")
    got = language_id.identify(df, model, keep=("_text", "doc_id_text_", "text")).first()
    assert (got["_text"], got["doc_id_text_"], got["text"]) == ("a", "b", "the cat")


def test_held_out_follows_crc32(spark):
    import zlib

    got = {r.doc_id: r.h for r in spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", language_id.held_out()).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_char_ngrams_of_pieces_are_those_of_the_whole(monkeypatch):
    text = language_id.fold("Größe Élan 12 x" * 300)
    found, n = language_id.counts(text)
    monkeypatch.setattr(language_id, "PIECE", 100)
    again = language_id.counts(text)
    assert np.array_equal(found, again[0]) and np.array_equal(n, again[1])


# ---- language-model scores


def test_scores_are_the_networks_probabilities():
    network = lm_score.WindowNetwork(40, hidden=5)
    network.left *= 20
    network.right *= 20
    line = lm_score.lined([np.array([3, 9, 9, 39], np.int32), np.zeros(0, np.int32), np.array([7], np.int32)])
    got = lm_score.token_scores(line, network.tables())
    for k, g in enumerate(got, 1):
        want = network.log_probabilities(line[k - 1 : k], line[k + 1 : k + 2])[0, line[k]] if line[k] else 0.0
        assert abs(g - want) < 1e-4
    assert abs(np.exp(network.log_probabilities(np.array([1]), np.array([2]))).sum() - 1) < 1e-9


def test_training_raises_the_likelihood_to_that_of_the_counts():
    r, size = np.random.default_rng(0), 12
    line = np.concatenate([[0], *[np.append((np.arange(6) + r.integers(5)) % 11 + 1, 0) for _ in range(400)]]).astype(np.int32)
    beside, around = np.zeros((size, size)), np.zeros((size, size))
    np.add.at(beside, (line[:-1], line[1:]), 1)
    inner = line[1:-1] > 0
    np.add.at(around, (line[:-2][inner], line[2:][inner]), 1)
    before = lm_score.token_scores(line, lm_score.WindowNetwork(size).tables()).sum()
    after = lm_score.token_scores(line, lm_score.WindowNetwork(size).train(beside, around, steps=400).tables()).sum()
    assert after / inner.sum() > -0.5 > -2 > before / inner.sum()


def test_pair_tables_count_every_pair(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FLUSH_TOKENS", 3)
    texts = ["a b a", None, "", "b c", "A  b"]
    docs = frame(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    assert {bytes(r.word): r.n for r in lm_score.word_counts(docs).collect()} == {b"a": 3, b"b": 3, b"c": 1}
    vocab = lm_score.vocabulary(docs, 8, 2)
    beside, around = lm_score.pair_tables(docs, vocab)
    a, b, c = (vocab[w] for w in (b"a", b"b", b"c"))
    assert beside[a, b] == 2 and beside[b, a] == 1 and beside[0, a] == 2 and beside[c, 0] == 1 and beside.sum() == 10
    assert around[0, b] == 2 and around[a, a] == 1 and around[a, 0] == 1 and around[b, 0] == 2 and around.sum() == 7


def test_lm_scores_of_a_corpus(spark, tiny, monkeypatch):
    monkeypatch.setattr(lm_score, "STEPS", 60)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(0)
    texts = {x.doc_id: x.text for x in docs.collect()}
    shuffled = []
    for i, t in texts.items():
        w = (t or "").split()
        r.shuffle(w)
        shuffled.append((10**6 + i, " ".join(w), None))
    model = lm_score.fit(docs)
    both = docs.union(spark.createDataFrame(shuffled, docs.schema))
    got = {x.doc_id: x for x in lm_score.score(both, model=model).collect()}
    pairs = [(got[i].mean_log_likelihood, got[10**6 + i].mean_log_likelihood) for i, t in texts.items() if t and len(t.split()) > 50]
    assert np.mean([a > b for a, b in pairs]) > 0.6
    assert all(got[i].n_tokens == len((t or "").split()) for i, t in texts.items())


def test_words_of_a_bucket_have_the_probability_of_their_counts(spark, monkeypatch):
    """Words beyond the classes are told apart, whether their counts are with the tasks or joined."""
    monkeypatch.setattr(lm_score, "VOCABULARY", 4)
    monkeypatch.setattr(lm_score, "BUCKETS", 1)
    monkeypatch.setattr(lm_score, "GROWTH", 0)
    monkeypatch.setattr(lm_score, "STEPS", 5)
    seen = {"a": 40, "b": 30, "c": 7, "d": 3, "e": 3, "f": 2, "g": 1}
    docs = frame(spark, [(k, w, None, None) for k, w in enumerate(w for w, n in seen.items() for _ in range(n))])
    asked = frame(spark, [(k, w, None, None) for k, w in enumerate([*seen, "never", "c never"])])
    found = []
    for known in (10**6, 4, 2):
        monkeypatch.setattr(lm_score, "KNOWN", known)
        model = lm_score.fit(docs)
        assert (model.vocab.known, model.vocab.size, model.counts.count()) == (2, 4, {10**6: 0, 4: 3, 2: 4}[known])
        found.append({r.doc_id: r.log_likelihood for r in lm_score.score(asked, model=model).collect()})
    for x in found:
        by = dict(zip(seen, (x[k] for k in range(7)), strict=True))
        assert abs(by["c"] - by["g"] - np.log(7)) < 1e-6 and abs(by["d"] - by["f"] - np.log(1.5)) < 1e-6 and abs(by["d"] - by["e"]) < 1e-9
        assert abs(by["g"] - x[7]) < 1e-9, "a word never seen has what one seen once has"
        assert abs(sum(np.exp([*by.values(), x[7]])) - 1) < 1e-4, "all words together have the probability 1"
    assert all(abs(x[k] - found[0][k]) < 1e-6 for x in found for k in x)


def test_pairs_of_many_classes_are_counted_alike(spark, monkeypatch):
    docs = frame(spark, [(k, f"a b {'c ' * k} d b a", None, None) for k in range(9)])
    vocab = lm_score.vocabulary(docs, 8, 2)
    want = lm_score.pair_tables(docs, vocab)
    monkeypatch.setattr(lm_score, "DENSE_CELLS", 0)
    assert all(np.array_equal(a, b) for a, b in zip(want, lm_score.pair_tables(docs, vocab), strict=True))


def test_classes_grow_with_the_corpus():
    assert lm_score.classes(0) == (1024, 256)
    assert lm_score.classes(10**6) == (2000, 500) and lm_score.classes(8 * 10**6) == (4000, 1000)
    assert lm_score.classes(10**9) == lm_score.classes(10**15) == (4096, 1024), "tables on the driver and with tasks are bounded"


def test_scores_of_whole_documents_equal_a_plain_loop(spark, monkeypatch):
    """Every document's sum, word by word: its class by the network's own probabilities, then the word by counts."""
    for name, value in (("VOCABULARY", 12), ("BUCKETS", 4), ("GROWTH", 0), ("STEPS", 20), ("KNOWN", 9), ("FLUSH_TOKENS", 40)):
        monkeypatch.setattr(lm_score, name, value)
    networks, tables = [], lm_score.WindowNetwork.tables
    monkeypatch.setattr(lm_score.WindowNetwork, "tables", lambda self: (networks.append(self), tables(self))[1])
    r = random.Random(31)
    texts = [" ".join(f"W{int(r.paretovariate(0.8)) % 40}" for _ in range(r.choice([0, 1, 2, 30, 200]))) for _ in range(60)] + [None, " \n", texts_of(r, 3000)]
    model = lm_score.fit(frame(spark, [(k, t, None, None) for k, t in enumerate(texts)]))
    (network,) = networks
    counts, sizes = {}, {}
    for t in texts:
        for w in (t or "").lower().encode().split():
            counts[w] = counts.get(w, 0) + 1
            c = model.vocab.of([w])[0]
            sizes[c] = sizes.get(c, 0) + 1
    got = {x.doc_id: x for x in lm_score.score(frame(spark, [(k, t, None, None) for k, t in enumerate(texts)]), model=model).collect()}
    for k, t in enumerate(texts):
        own = (t or "").lower().encode().split()
        tokens = [0, *model.vocab.of(own).tolist(), 0]
        want = 0.0
        for i, w in enumerate(own, 1):
            want += network.log_probabilities(np.array([tokens[i - 1]]), np.array([tokens[i + 1]]))[0, tokens[i]]
            if tokens[i] >= 8:
                want += np.log(counts[w] / (sizes[tokens[i]] + 1))
        assert got[k].n_tokens == len(own) and abs(got[k].log_likelihood - want) < 1e-4 * max(1, len(own)), k
        assert (got[k].mean_log_likelihood is None) == (not own)


def texts_of(r, n):
    return " ".join(f"w{r.randrange(60)}" for _ in range(n))


def test_lm_score_edges(spark):
    assert lm_score.score(frame(spark, [])).collect() == []
    got = sorted((str(x.doc_id), x.n_tokens, x.log_likelihood <= 0, x.mean_log_likelihood is None) for x in lm_score.score(frame(spark, [(1, None, None, None), (2, "", None, None), (3, "a b", None, None), (3, "a b", None, None), (None, "b", None, None)])).collect())
    assert got == [("1", 0, True, True), ("2", 0, True, True), ("3", 2, True, False), ("3", 2, True, False), ("None", 1, True, False)]


# ---- mixing


def by_quotients(votes, seats, most=None):
    got = [0] * len(votes)
    for _ in range(seats):
        able = [i for i in range(len(votes)) if votes[i] > 0 and (most is None or got[i] < most[i])]
        if not able:
            break
        got[max(able, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


def test_sainte_lague_is_that_of_the_highest_quotients():
    r = random.Random(4)
    for _ in range(200):
        votes = [r.choice([0, r.randint(0, 50), r.random() * 1000]) for _ in range(r.randint(1, 9))]
        seats = r.randint(0, 60)
        if max(votes) > 0:
            assert mixing.sainte_lague(votes, seats) == by_quotients(votes, seats), (votes, seats)
        most = [r.randint(0, 12) for _ in votes]
        assert mixing.sainte_lague(votes, seats, most) == by_quotients(votes, seats, most), (votes, seats, most)
    assert sum(mixing.sainte_lague([1.0] * 200_000, 100_001)) == 100_001
    assert mixing.sainte_lague([], 5) == [] and mixing.sainte_lague([0, 0], 5) == [0, 0]
    assert mixing.sainte_lague([10, 10, 10], 4) == [2, 1, 1]
    assert sum(mixing.sainte_lague([3e9, 1e9, 2.5e9], 10**8)) == 10**8


def test_targets_of_very_many_sources_take_little_time():
    import time

    r = np.random.default_rng(1)
    sizes = (r.pareto(0.7, 60_000) * 100).tolist()
    began = time.perf_counter()
    got = mixing.targets(sizes, [(3.0, 1.0, 2.0)[k % 3] for k in range(len(sizes))], 1.5)
    assert time.perf_counter() - began < 5 and abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 * sum(sizes)


def test_rows_of_one_id_are_spread_over_shards(spark):
    df = spark.range(2000).selectExpr("if(id % 2 = 0, null, 7L) AS doc_id", "concat('word ', id) AS text", "'s' AS source")
    got = mixing.mix(df, shard_docs=100).groupBy("shard").count().collect()
    assert len(got) == 20 and max(x["count"] for x in got) < 200


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([1000, 0, 10], [3, 1, 2], 1.5) == pytest.approx([1495, 0, 20])
    assert mixing.targets([], [], 1.5) == [] and mixing.targets([0], [1], 1.5) == [0]


def test_taken_equals_a_plain_mix(spark):
    """Seat by seat and word by word, with the shards and the order of the operator."""
    r = random.Random(16)
    rows = [(k, " ".join(["w"] * r.choice([0, 1, 5, 40, 200, 900])), "en", r.choice(["a", "a", "a", "b", "c", None])) for k in range(300)]
    rows += [(7, "again " * 9, "en", "a"), (7, "again " * 30, "en", "a"), (7, "other " * 30, "en", "a")]
    block, docs = 16, frame(spark, rows)
    got = sorted(mixing.mix(docs, block=block, shard_docs=40).select("doc_id", "size", "taken").collect())
    keyed = docs.selectExpr("doc_id", "source", "text", "xxhash64(text) AS tie", "xxhash64(20011, doc_id) AS h", "xxhash64(20012, doc_id, xxhash64(text)) AS place").collect()
    sources = sorted({x.source for x in keyed}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len(x.text.split()) for x in keyed if x.source == s) for s in sources}
    targets = mixing.targets([sizes[s] for s in sources], [3, 1, 2, 3], 1.5)
    quotas = by_quotients(targets, round(sum(targets) / block))
    want = []
    for s, quota in zip(sources, quotas, strict=True):
        own = [x for x in keyed if x.source == s]
        shards = max(1, -(-len(own) // 40))
        lines = {}
        for x in sorted(own, key=lambda x: (x.h, x.doc_id, len(x.text.split()), x.tie)):
            lines.setdefault(x.place % shards, []).append((x.doc_id, len(x.text.split())))
        names = sorted(lines)
        totals = [sum(n for _, n in lines[k]) for k in names]
        seats = by_quotients(totals, quota, [-(-2 * t // block) for t in totals])
        assert sum(seats) == min(quota, sum(-(-2 * t // block) for t in totals))
        for k, blocks, total in zip(names, seats, totals, strict=True):
            left = min(blocks * block, 2 * total)
            passes = left // total if total else 0
            left -= passes * total
            for i, n in lines[k]:
                want.append((i, n, passes * n + min(n, left)))
                left -= min(n, left)
    assert [tuple(x) for x in got] == sorted(want)


def test_mix_meets_its_targets(spark):
    r = random.Random(6)
    rows = [(k, " ".join(["w"] * r.choice([0, 1, 5, 40, 200])), "en", r.choice(["a", "a", "a", "b", "c", None])) for k in range(600)] + [(900, "w " * 5000, "en", "b"), (901, None, None, "only nulls"), (5, "w w", "en", "a")]
    got = mixing.mix(frame(spark, rows), shard_docs=50).collect()
    assert len(got) == len(rows)
    sums: dict = {}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        sums.setdefault((x.target, x.source_size), []).append(x)
    assert len(sums) == 5
    for (target, size), members in sums.items():
        assert sum(m.size for m in members) == size
        assert abs(sum(m.taken for m in members) - target) <= 64 * (1 + len({m.shard for m in members}))
    names = ["a", "b", "c", "only nulls", None]
    sizes = [sum(len((t or "").split()) for _, t, _, s in rows if s == n) for n in names]
    assert sorted(t for t, _ in sums) == pytest.approx(sorted(mixing.targets(sizes, [3, 1, 2, 3, 1], 1.5)))
    again = mixing.mix(frame(spark, rows).repartition(7), shard_docs=50).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix(frame(spark, [])).collect() == []

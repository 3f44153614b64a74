import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from methspark.functions import kinetics, motifs, text
from methspark.operators import alignment, correlation, coverage, evaluation, mods, pileup, sampling, scoring
from methspark.plans import catalogue

# ---- motifs and kinetics


def test_reverse_complement_twice_is_the_sequence(spark):
    rows = spark.createDataFrame([("ACGTNacgt",), ("",)], "s string")
    twice = motifs.reverse_complement(motifs.reverse_complement(F.col("s")))
    assert [r[0] for r in rows.select(twice).collect()] == ["ACGTNacgt", ""]


def test_sites_of_a_read_with_unknown_bases(spark):
    reads = spark.createDataFrame([(1, "CGCAGCNGCTA"), (2, "TTG"), (3, None)], "read_id long, seq string")
    got = sorted((r.read_id, r.qoff, r.strand, r.context, r.motif) for r in motifs.motif_sites(reads).collect())
    assert got == [(1, 0, 0, "CpG", "CG"), (1, 2, 0, "CHG", "CAG"), (1, 8, 0, "CHH", "CTA"), (2, 2, 1, "CHH", "CAA")]
    assert motifs.chosen_contexts("chh, CPG,chh") == ("CHH", "CpG")
    with pytest.raises(ValueError, match="unknown contexts"):
        motifs.motif_sites(reads, ("CNG",))


CODEC = [(0, 0), (63, 63), (64, 64), (127, 190), (128, 192), (191, 444), (192, 448), (255, 952)]
ENCODED = [(0, 0), (63, 63), (65, 64), (191, 127), (192, 128), (447, 191), (448, 192), (952, 255), (1000, 255)]


def test_codec_bounds(spark):
    decoded = spark.createDataFrame(CODEC, "code int, frames int").select(kinetics.decode_frames(F.col("code")).alias("got"), "frames").collect()
    assert all(r.got == r.frames for r in decoded)
    encoded = spark.createDataFrame(ENCODED, "frames int, code int").select(kinetics.encode_frames(F.col("frames")).alias("got"), "code").collect()
    assert all(r.got == r.code for r in encoded)
    codes = np.arange(256)
    assert [kinetics.decode_array(codes)[c] for c, _ in CODEC] == [f for _, f in CODEC]
    assert (kinetics.encode_array(kinetics.decode_array(codes)) == codes).all()
    assert [int(kinetics.encode_array(np.array([f]))[0]) for f, _ in ENCODED] == [c for _, c in ENCODED]


def test_features_are_those_of_a_plain_loop():
    r = np.random.default_rng(1)
    seq = "ACGNTACGCG"
    fi, fp, ri, rp = (r.integers(0, 953, len(seq)) for _ in range(4))
    got = kinetics.windows(kinetics.base_features(seq, fi, fp, ri, rp), np.array([1, 8]), 5)
    for w, site in zip(got, (1, 8), strict=True):
        for k in range(5):
            i = site - 2 + k
            want = np.zeros(8)
            if 0 <= i < len(seq):
                if seq[i] in "ACGT":
                    want["ACGT".index(seq[i])] = 1
                want[4:] = np.array([fi[i], fp[i], ri[len(seq) - 1 - i], rp[len(seq) - 1 - i]]) / 952
            assert np.allclose(w[k], want)


def test_hits_of_joined_alignments_are_those_of_each():
    r = random.Random(11)
    rows = [("", "", False), ("C", "C", True), ("GC", "GC", False), ("GG", "GG", True)]
    for k in range(60):
        q = "".join(r.choice("ACGTN") for _ in range(r.randint(1, 60)))
        rows.append((q, "".join(r.choice("ACGT") if r.random() < 0.1 else b for b in q), k % 2 == 1))
    each = [alignment.Columns(f"{len(q)}M" if q else "", q, s, 0) for q, s, _ in rows]
    each.append(alignment.Columns("2S4M2I3D6M", "TTACGCAACGCAGA", "ACGCTTTCGCAGA", 0))
    turned, sizes = [t for *_, t in rows] + [True], [len(q) for q, *_ in rows] + [14]
    want = sorted((k, x, a, b) for k, c in enumerate(each) for x, qs, ss in c.hits(turned[k], sizes[k]) for a, b in zip(qs.tolist(), ss.tolist(), strict=True))
    got = sorted((k, x, a, b) for x, ks, qs, ss in alignment.joined_hits(each, turned, sizes) for k, a, b in zip(ks.tolist(), qs.tolist(), ss.tolist(), strict=True))
    assert got == want and len(got) > 100 and alignment.joined_hits([], [], []) == []


@pytest.mark.parametrize("with_arrays", [True, False])
def test_sums_of_windows_are_made_without_windows(spark, monkeypatch, with_arrays):
    r = random.Random(8)
    own = {f"r{k}": "".join(r.choice("ACGTN") for _ in range(n)) for k, n in enumerate((0, 2, 3, 9, 40, 300))}
    frames = lambda read_id, n: [np.random.default_rng([n, k]).integers(0, 953, n) for k in range(4)]
    arrays = {i: frames(i, len(s)) for i, s in own.items()}
    rows = [(i, s, *(a.tolist() for a in arrays[i])) for i, s in own.items()]
    rows += [("none", None, [], [], [], [])] + [("short", "ACGT", [1], [1], [1], [1])] * with_arrays
    reads = spark.createDataFrame(rows, "read_id string, seq string, fi array<int>, fp array<int>, ri array<int>, rp array<int>")
    monkeypatch.setattr(kinetics, "SITES_AT_ONCE", 7)
    found = kinetics.site_sums(reads if with_arrays else reads.select("read_id", "seq"), 21, ("cpg", "CHH"), None if with_arrays else frames)
    got = {(x.read_id, x.qoff, x.context): tuple(x)[3:] for x in found.collect()}
    want = {}
    for i, seq in own.items():
        features = kinetics.base_features(seq, *arrays[i]).astype(float)
        for context in ("CpG", "CHH"):
            at = kinetics.context_sites(seq, context)
            for site, w in zip(at.tolist(), kinetics.windows(features, at, 21), strict=True):
                sums = w.astype(float).sum(axis=0)
                want[i, site, context] = (*np.rint(sums[:4]).astype(int).tolist(), *np.rint(sums[4:] * kinetics.MOST_FRAMES).astype(int).tolist())
    assert got == want and len(want) > 50


def test_kmer_features_query_sends_no_window(spark, tiny):
    plan = catalogue.QUERIES["kmer_features"](spark, tiny)._jdf.queryExecution().toString()
    assert plan.count("features#") == 0 and "transform(" not in plan


def test_the_network_is_that_of_plain_loops():
    net = scoring.ConvScorer.untrained("CpG", 25)
    x = np.random.default_rng(3).normal(0, 1, (3, 25, 8))
    p = net.parameters

    def normed(rows, k):  # rows: channels by places
        return [[(v - p[f"norm{k}"][0][c]) / math.sqrt(p[f"norm{k}"][1][c] + 1e-5) * p[f"norm{k}"][2][c] + p[f"norm{k}"][3][c] for v in row] for c, row in enumerate(rows)]

    for site, got in zip(x, net.score(x), strict=True):
        rows = normed(site.T.tolist(), 0)
        for k in range(1, 9):
            kernel = p[f"conv{k}"].astype(float)
            padded = np.pad(np.array(rows), ((0, 0), (1, 1)))
            starts = range(0, padded.shape[1] - kernel.shape[2] + 1, 2)
            rows = [[max(0.0, v) for v in row] for row in normed([[float((f * padded[:, s : s + f.shape[1]]).sum()) for s in starts] for f in kernel], k)]
        flat = np.array([v for row in rows for v in row])
        hidden = np.maximum(p["dense1"] @ flat + p["bias1"], 0)
        assert got == pytest.approx(p["dense2"] @ hidden + p["bias2"], rel=1e-3, abs=1e-4)


@pytest.mark.parametrize("kmer", [15, 26, 61, 401])
def test_the_network_over_a_read_is_that_over_its_windows(monkeypatch, kmer):
    monkeypatch.setattr(scoring, "ROWS_AT_ONCE", 50)
    net, r = scoring.ConvScorer.untrained("CpG", kmer), np.random.default_rng(kmer)
    for n, share in ((1, 1.0), (30, 0.5), (700, 0.05), (1500, 0.3)):
        features = r.normal(0, 1, (n, 8)).astype(np.float32)
        sites = np.flatnonzero((r.random(n) < share) | (np.arange(n) == n // 2))
        assert np.allclose(net.score_read(features, sites), net.score(kinetics.windows(features, sites, kmer)), rtol=1e-3, atol=1e-4)


def test_overlapping_windows_are_not_convolved_again(spark, monkeypatch):
    net, rows = scoring.ConvScorer.untrained("CpG", 401), []
    monkeypatch.setattr(scoring.ConvScorer, "score", lambda self, features: rows.append(len(features)) or np.zeros((len(features), 2)))
    assert len(scoring._logits(net, np.zeros((500, 8), np.float32), np.arange(0, 500, 20))) == 25 and not rows


def test_calls_of_one_pass_are_those_of_features_and_scores(spark, tmp_path):
    r = random.Random(3)
    seqs = ["".join(r.choice("ACGT") for _ in range(n)) for n in (0, 3, 40, 200)]
    rows = [(f"r{k}", s, *([r.randrange(953) for _ in s] for _ in range(4))) for k, s in enumerate(seqs)] + [("short", "ACG", [1], [1], [1], [1])]
    reads = spark.createDataFrame(rows, "read_id string, seq string, fi array<int>, fp array<int>, ri array<int>, rp array<int>")
    np.savez(tmp_path / "net.npz", **scoring.ConvScorer.untrained("CHG", 15).parameters)
    scorers = [scoring.LinearScorer("CpG"), scoring.ConvScorer.load("CHG", 15, str(tmp_path / "net.npz")), scoring.LinearScorer("CHH", 9)]
    want = [row for s in scorers for row in scoring.score_sites(kinetics.kmer_features(reads, s.kmer, s.context), s).collect()]
    got = scoring.call_sites(reads, scorers, batch=7).collect()
    key = lambda x: (x.read_id, x.context, x.qoff)
    assert [key(x) for x in sorted(got, key=key)] == [key(x) for x in sorted(want, key=key)] and {x.context for x in got} == {"CpG", "CHG", "CHH"}
    assert all(abs(a.scaled_prob - b.scaled_prob) <= (a.context == "CHG") for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True))
    with pytest.raises(ValueError, match="don't fit"):
        scoring.ConvScorer("CHG", 401, scorers[1].parameters)


def test_scores_do_not_depend_on_the_batch(spark):
    scorer = scoring.LinearScorer(kmer=3)
    features = spark.range(50).select(F.col("id").alias("read_id"), F.lit(1).alias("qoff"), F.expr("transform(sequence(1, 24), i -> cast((i * id) % 7 / 7 as float))").alias("features"))
    small = {r.read_id: r.scaled_prob for r in scoring.score_sites(features.repartition(5), scorer, batch=3).collect()}
    assert small == {r.read_id: r.scaled_prob for r in scoring.score_sites(features, scorer).collect()}
    assert scoring.quantised(np.array([[0.0, 0.0], [-900.0, 900.0], [900.0, -900.0]])).tolist() == [127, 255, 0]


# ---- alignments


def plain_columns(cigar, query, subject, start):
    import re

    q, s, out, lead = 0, start, [], True
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        for _ in range(int(n)):
            if op == "S" and lead:
                q += 1
            if op in "M=X":
                out.append((query[q], subject[s], q, s))
                q, s = q + 1, s + 1
            elif op == "I":
                out.append((query[q], "-", q, s - 1))
                q += 1
            elif op in "DN":
                out.append(("-", subject[s], q - 1, s))
                s += 1
        if op not in "SH":
            lead = False
    return out


@given(st.lists(st.tuples(st.integers(1, 12), st.sampled_from("MIDN=XP")), min_size=1, max_size=8), st.integers(0, 3), st.integers(0, 5), st.randoms(use_true_random=False))
@settings(max_examples=150, deadline=None)
def test_columns_are_those_of_a_plain_walk(ops, soft, start, r):
    cigar = ("2H" if soft == 3 else "") + (f"{soft}S" if soft else "") + "".join(f"{n}{op}" for n, op in ops) + "3S1H"
    query = "".join(r.choice("ACGT") for _ in range(soft + 3 + sum(n for n, op in ops if op in "M=XI")))
    subject = "".join(r.choice("ACGT") for _ in range(start + sum(n for n, op in ops if op in "M=XDN")))
    c = alignment.Columns(cigar, query, subject, start)
    want = plain_columns(cigar, query, subject, start)
    assert list(zip([chr(x) for x in c.q], [chr(x) for x in c.s], c.q_pos.tolist(), c.s_pos.tolist(), strict=True)) == want
    assert "".join(chr(x) for x in c.q).replace("-", "") == query[soft : len(query) - 3]
    assert "".join(chr(x) for x in c.s).replace("-", "") == subject[start:]


def test_identities():
    c = alignment.Columns("4M9I4M2D2M", "ACGT" + "A" * 9 + "ACGTAC", "ACGTACGTGGAT", 0)
    assert c.identity() == pytest.approx(100 * 9 / 21) and c.effective_identity() == pytest.approx(100 * 9 / 12)
    with pytest.raises(ValueError, match="bad CIGAR"):
        alignment.Columns("4M3", "ACGT", "ACGT", 0)


def test_hits_of_a_reversed_read():
    seq = "ACGCAGCTA"
    rc = "TAGCTGCGT"
    forward = {(x, q, s) for x, qs, ss in alignment.Columns("9M", seq, seq, 0).hits(False, 9) for q, s in zip(qs.tolist(), ss.tolist(), strict=True)}
    assert forward == {("CpG", 1, 1), ("CHG", 3, 3), ("CHH", 6, 6)}
    turned = {(x, q, s) for x, qs, ss in alignment.Columns("9M", rc, rc, 0).hits(True, 9) for q, s in zip(qs.tolist(), ss.tolist(), strict=True)}
    assert {(x, seq[q]) for x, q, _ in turned} <= {("CpG", "C"), ("CHG", "C"), ("CHH", "C"), ("CHH", "G")}
    assert ("CpG", 1, 6) in turned and ("CHG", 3, 3) in turned


# ---- tags


@given(st.text("ACGTN", max_size=60), st.data())
@settings(max_examples=150, deadline=None)
def test_tags_round_trip(seq, data):
    places = [(i, 0 if b == "C" else 1) for i, b in enumerate(seq) if b in "CG"]
    chosen = [p for p in places if data.draw(st.booleans())]
    calls = [(q, s, data.draw(st.integers(0, 255))) for q, s in chosen]
    mm, ml = mods.encode(seq, *(np.array([c[k] for c in calls], dtype=np.int64) for k in range(3)))
    if not calls:
        assert mm is None and not len(ml)
        return
    assert sorted((q, s, p) for q, s, _, _, p in decoded(seq, mm, ml)) == sorted(calls)


def decoded(seq, mm, ml):
    return [(q, s, b, c, p) for places, s, b, c, ps in mods.decode(seq, mm, ml) for q, p in zip(places.tolist(), ps.tolist(), strict=True)]


def test_tag_grammar():
    assert sorted(decoded("ACGCC", "C+mh?,1,0;", [1, 2, 3, 4])) == [(3, 0, "C", "h", 2), (3, 0, "C", "m", 1), (4, 0, "C", "h", 4), (4, 0, "C", "m", 3)]
    assert decoded("ACGCC", "C+27551.,2;N+n,0;", [9, 8]) == [(4, 0, "C", "m", 9), (0, 0, "N", "n", 8)]
    for seq, mm, ml, message in (("CC", "C+m,0", [1], "bad MM"), ("CC", "C+m,2;", [1], "beyond"), ("CC", "C+m,0;", [], "shorter"), ("CC", "C+m,0;", [1, 2], "longer"), ("CC", "A+m,0;", [1], "go with"), ("CC", "C+99,0;", [1], "ChEBI"), ("CC", "C+m,0;", [256], "0..255")):
        with pytest.raises(ValueError, match=message):
            mods.decode(seq, mm, ml)


def test_last_call_wins_and_tags_are_dropped(spark):
    rows = spark.createDataFrame([(1, 5, "m", 10, 0), (1, 5, "m", 20, 1), (1, 5, "h", 30, 2)], "read_id long, qoff int, code string, scaled_prob int, ord int")
    assert [tuple(r) for r in mods.last_calls(rows).collect()] == [(1, 5, 20)]
    tags = spark.createDataFrame([({"MM": "x", "fi": "y", "np": "3"},)], "t map<string,string>")
    assert tags.select(mods.without_old_tags(F.col("t"))).first()[0] == {"np": "3"}
    assert tags.select(mods.without_old_tags(F.col("t"), keep_kinetics=True)).first()[0] == {"np": "3", "fi": "y"}


# ---- thresholds and pileup


def plain_threshold(n):
    st_, en = 20, 236
    while st_ < 256 and n[st_] < 10:
        st_ += 1
    while en > 0 and n[en - 1] < 10:
        en -= 1
    if en - st_ >= 50 and sum(n[st_:en]) >= 10_000:
        return min(range(st_, en), key=lambda b: (n[b], b))
    return 128


def test_threshold_follows_the_rule(spark):
    r = random.Random(1)
    hists = []
    for _ in range(30):
        n = [r.choice([0, r.randint(0, 15), r.randint(40, 400)]) if r.random() < 0.2 else r.randint(10, 150) for _ in range(256)]
        for b in range(r.randint(0, 120)):
            n[b] = r.randint(0, 9)
        hists.append(n)
    hists += [[0] * 20 + [200] * 49 + [0] * 187, [0] * 20 + [200] * 25 + [201] * 25 + [0] * 186, [0] * 20 + [100] * 99 + [99] + [0] * 136, [0] * 20 + [100] * 100 + [0] * 136, [500] * 20 + [0] * 236]
    rows = [(k, b, n[b]) for k, n in enumerate(hists) for b in range(256) if n[b]]
    got = {x.context: x.threshold for x in pileup.adaptive_threshold(spark.createDataFrame(rows, "context int, scaled_prob int, n long")).collect()}
    assert got == {k: plain_threshold(n) for k, n in enumerate(hists)}


def test_pileup_loses_no_observation_and_ignores_order(spark):
    r = random.Random(3)
    rows = [(r.randrange(3), r.randrange(30), r.choice(["CpG", "CHG"]), r.randrange(256), 60, r.random() < 0.8) for _ in range(3000)]
    obs = spark.createDataFrame(rows, "chrom int, soff int, context string, scaled_prob int, mapq int, primary boolean")
    got = pileup.pileup(obs).collect()
    assert sum(x.pcov + x.ncov for x in got) == 3000 and all(x.pcov + x.ncov > 0 and x.end == x.start + 1 for x in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, pileup.pileup(obs.repartition(9).orderBy("scaled_prob")).collect()))


def test_published_rows(spark):
    """Five published frequencies pin the formula and the text form."""
    rows = [(9, 4, "69.2308"), (1, 12, "7.69231"), (2, 11, "15.3846"), (0, 13, "0")]
    bed = pileup.frequencies(spark.createDataFrame([("c", k, p, n, "CHH", want) for k, (p, n, want) in enumerate(rows)], "chrom string, soff int, pcov long, ncov long, context string, want string"))
    shown = {r.start: r.s for r in bed.select("start", text.six_digits(F.col("freq")).alias("s")).collect()}
    assert shown == {k: want for k, (_, _, want) in enumerate(rows)}


def test_six_digits_is_percent_g(spark):
    values = [0.0, 100.0, 0.1953125, 50.0, 33.333333, 0.0123456789, 0.00123456, 99.99996, 9.999996, 123456.0, 1.5, 66.66666666]
    shown = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(text.six_digits(F.col("v"))).collect()]
    assert shown == ["%g" % v for v in values]


def test_data_sizes(spark):
    got = spark.createDataFrame([("1.5k",), ("2GB",), ("7",)], "t string").select(text.parse_data_size(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [1536, 2 << 30, 7]
    assert spark.range(1).select(text.data_size(F.lit(1536)).alias("t")).first().t == "1.50KB"
    assert spark.range(1).select(text.split_filled(F.lit("a\t\tb\t"))).first()[0] == ["a", "b"]


# ---- coverage, correlation, sampling, evaluation


def test_coverage_folds_strands_at_contig_ends(spark):
    contigs = spark.createDataFrame([("x", "CGCAGCCGGTTC"), ("y", "acg")], "chrom string, seq string")
    seq = "CGCAGCCGGTTC"
    rows = spark.createDataFrame([("x", k + 1, 10 + k, 1) for k in range(len(seq))] + [("y", 2, 3, 0), ("y", 3, 4, 0), ("y", 1, 9, 9)], "chrom string, start int, pcov int, ncov int")
    for chunk in (4096, 5):
        coverage.CHUNK = chunk
        cpg = {(r.chrom, r.start): (r.pcov, r.ncov) for r in coverage.truth_sites(rows, contigs, "CpG").collect()}
        assert cpg == {("x", 0): (10 + 11, 2), ("x", 6): (16 + 17, 2), ("y", 1): (7, 0)}
        chg = {(r.start, r.motif): r.pcov for r in coverage.truth_sites(rows, contigs, "CHG").filter("chrom = 'x'").collect()}
        assert chg == {(2, "CAG"): 12 + 14, (5, "CCG"): 15, (8, "CCG"): 18}
        folded = {(r.start, r.motif): r.pcov for r in coverage.truth_sites(rows, contigs, "CHG", fold_ccg=True).filter("chrom = 'x'").collect()}
        assert folded == {(2, "CAG"): 26, (5, "CCG"): 15, (6, "CCG"): 18}
    coverage.CHUNK = 4096
    assert [r.chrom for r in coverage.unknown_contigs(spark.createDataFrame([("x",), ("z",)], "chrom string"), contigs).collect()] == ["z"]


def test_chunks_cover_a_contig(spark):
    seq = "".join(random.Random(2).choice("ACGT") for _ in range(103))
    contigs = spark.createDataFrame([("x", seq)], "chrom string, seq string")
    rows = spark.createDataFrame([("x", k + 1) for k in range(103)], "chrom string, start int")
    padded = "--" + seq + "--"
    for chunk in (7, 64, 103, 4096):
        got = {r.soff: r.five for r in coverage.around(rows, contigs, chunk).collect()}
        assert got == {k: padded[k : k + 5] for k in range(103)}


def test_correlation_rules(spark):
    one = spark.createDataFrame([("a", k, "c", k, 10 - k) for k in range(11)], "chrom string, soff int, context string, pcov int, ncov int")
    assert correlation.correlation(one, one).first().r == pytest.approx(1)
    other = one.select("chrom", "soff", "context", F.col("ncov").alias("pcov"), F.col("pcov").alias("ncov"))
    assert correlation.correlation(one, other).first().r == pytest.approx(-1)
    few = correlation.correlation(one.filter("soff < 4"), one).first()
    assert few.n_loci == 4 and few.r is None
    assert correlation.correlation(one, one, min_cov=11).collect()[0].n_loci == 0


def place(*named):
    return int(hashlib.md5(":".join(map(str, named)).encode()).hexdigest()[:8], 16)


def test_replicates_are_samples_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(sampling, "ORDER_BUCKETS", 16)
    ids = [k * 2**52 + k for k in range(2000)] + [2**63 - 1, -1]
    rows = spark.createDataFrame([(i, None if i % 3 == 2 else i % 3, "x", 1) for i in ids], "id long, label long, part string, rank int")
    got = sampling.balanced(rows, ("label",), "id", 5, 20, 42)
    assert got.columns == [*rows.columns, "replicate"]
    chosen = {}
    for r in got.collect():
        chosen.setdefault((r.label, r.replicate), set()).add(r.id)
    for label in (0, 1, None):
        own = [i for i in ids if (None if i % 3 == 2 else i % 3) == label or (label is None and i % 3 == 2)]
        for k in range(5):
            assert chosen[label, k] == set(sorted(own, key=lambda i: (place(42, k, i), i))[:20])
        assert len(set.union(*[chosen[label, k] for k in range(5)])) > 60
    few = sampling.balanced(rows.limit(7), ("label",), "id", 2, 20, 1)
    assert few.count() == 14
    times = rows.withColumn("times", F.lit(3))
    assert sampling.oversampled(times, ("label",), 1000).columns == [*times.columns, "copy"]


def test_running_totals_have_no_global_window(spark):
    rows = spark.range(500).select(F.col("id").alias("read_id"), (F.col("id") % 17).alias("length"))
    got = sampling.to_coverage(rows, 900, 5).collect()
    order = sorted(range(500), key=lambda i: (place(5, i), i))
    want, total = set(), 0
    for i in order:
        if total >= 900:
            break
        want.add(i)
        total += i % 17
    assert {r.read_id for r in got} == want
    assert sampling.to_coverage(rows.filter("length > 0"), 0, 5).count() == 1


def plain_auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    tp = fp = 0
    ap = 0.0
    for s in sorted({p for _, p in rows}, reverse=True):
        new = sum(p == s for p in pos)
        tp, fp = tp + new, fp + sum(p == s for p in neg)
        ap += new / len(pos) * tp / (tp + fp)
    return auc, ap


def test_ranking_metrics(spark):
    r = random.Random(8)
    groups = {"mixed": [(r.randint(0, 1), r.randrange(20)) for _ in range(80)], "perfect": [(1, 200), (1, 201), (0, 3)], "constant": [(1, 5), (0, 5), (0, 5)], "one": [(1, 5), (1, 9)]}
    rows = spark.createDataFrame([(g, y, p, int(p >= 10)) for g, x in groups.items() for y, p in x], "g string, label int, scaled_prob int, predict int")
    got = {x.g: x for x in evaluation.ranking(rows, ("g",)).collect()}
    for g in ("mixed", "perfect", "constant"):
        assert (got[g].auc, got[g].average_precision) == pytest.approx(plain_auc(groups[g]))
    assert got["one"].auc is None
    conf = {x.g: x for x in evaluation.confusion(rows, ("g",)).collect()}
    assert conf["one"].specificity == 0 and conf["perfect"].f1 == 1 and conf["constant"].precision == 0


def test_placed_reads_meet_the_reference_by_chunks(spark):
    r = random.Random(3)
    contigs = {c: "".join(r.choices("ACGTacgt", k=n)) for c, n in (("a", 500), ("b", 64), ("c", 1))}
    rows = []
    for k in range(200):
        c = r.choice("abcx")
        n = r.randint(0, 90)
        cigar = f"3S{n}M2I5D1X4H" if n else "7S"
        rows.append((k, c, r.choice([0, 16, 4]), cigar, r.randint(-1, 500), "keep"))
    reads = spark.createDataFrame(rows, "read_id long, chrom string, flag int, cigar string, pos int, offset string")
    table = spark.createDataFrame(list(contigs.items()), "chrom string, seq string")
    want = []
    for k, c, flag, cigar, pos, _ in rows:
        span = sum(int(n) for n, op in re.findall(r"(\d+)([A-Z=])", cigar) if op in "M=XDN")
        if not flag & 4 and c in contigs and pos >= 0 and span and pos + span <= len(contigs[c]):
            want.append((k, 0, pos, contigs[c][pos : pos + span].upper()))
    assert len(want) > 20
    for chunk in (16, 64, 4096):
        got = alignment.placed(reads, table, chunk=chunk).select("read_id", "pos", "offset", "subject")
        assert sorted(map(tuple, got.collect())) == want


# ---- base codes


#: The bases that each code may be (fixed values).
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
OPPOSITE = {"A": "T", "C": "G", "G": "C", "T": "A"}


def test_all_base_codes_against_a_plain_table():
    assert {k for k in motifs.MASKS} == {*IUPAC, "U"}
    for code, bases in IUPAC.items():
        for letter in (code, code.lower()):
            (mask,) = motifs.base_masks(letter)
            assert mask == sum({"A": 1, "C": 2, "G": 4, "T": 8}[b] for b in bases)
            assert motifs.turned_masks(motifs.base_masks(letter))[0] == motifs.base_masks(next(c for c, x in IUPAC.items() if set(x) == {OPPOSITE[b] for b in bases}))[0]
        for other, more in IUPAC.items():
            assert bool(len(motifs.pattern_starts(motifs.base_masks(other), code))) == (set(more) <= set(bases))
            assert bool(len(motifs.pattern_starts(motifs.base_masks(other), code, possible=True))) == bool(set(more) & set(bases))
    assert motifs.base_masks("-. Xz@").tolist() == [0] * 6 and motifs.base_masks("u")[0] == 8


def test_pattern_sites_on_both_strands(spark):
    r = random.Random(6)
    reads = [(k, "".join(r.choice("ACGTACGTACGTNRYSWKMBDHV-") for _ in range(r.randint(0, 80)))) for k in range(60)] + [(99, None)]
    patterns = ("CG", "CHG", "CHH", "RCGY", "N")
    for possible in (False, True):
        got = sorted(map(tuple, motifs.pattern_sites(spark.createDataFrame(reads, "read_id long, seq string"), patterns, possible).collect()))
        want = []
        for k, seq in reads:
            sets = [set(IUPAC.get(b, "")) for b in seq or ""]
            turned = [{OPPOSITE[b] for b in s} for s in reversed(sets)]
            for strand, own in enumerate((sets, turned)):
                for p in patterns:
                    for i in range(len(own) - len(p) + 1):
                        pairs = [(own[i + j], set(IUPAC[c])) for j, c in enumerate(p)]
                        if all(a & b if possible else a and a <= b for a, b in pairs):
                            want.append((k, len(own) - len(p) - i if strand else i, strand, p))
        assert got == sorted(want)
    # on plain bases the contexts are patterns
    plain = spark.createDataFrame([(k, "".join(r.choices("ACGT", k=300))) for k in range(5)], "read_id long, seq string")
    for context, pattern in (("CpG", "CG"), ("CHG", "CHG")):
        sites = sorted(map(tuple, motifs.motif_sites(plain, (context,)).select("read_id", "qoff").collect()))
        assert sites == sorted((x.read_id, x.qoff) for x in motifs.pattern_sites(plain, (pattern,)).filter("strand = 0").collect())
    with pytest.raises(ValueError, match="base codes"):
        motifs.pattern_sites(plain, ("C1",))


def test_six_digits_are_those_of_c(spark):
    r = random.Random(3)
    values = [0.0, 1.0, 100.0, 99.99996, 99.999949, 0.0001, 0.00009999996, 1e-5, 123456.0, 999999.4, 999999.6, 1e6, 12345678.9, 1e100, 3e-300, -0.5, -1.25e-7, 1e-4 / 3]
    values += [r.choice([1, -1]) * 10 ** r.uniform(-12, 12) for _ in range(500)] + [round(r.uniform(0, 100), 9) for _ in range(300)]
    from methspark.functions import text

    df = spark.createDataFrame([(x,) for x in values], "x double")
    for x in df.withColumn("got", text.six_digits(F.col("x"))).collect():
        assert x.got == f"{x.x:g}", x


def test_numbers_with_commas_and_zeros(spark):
    from methspark.functions import text

    df = spark.createDataFrame([(0,), (7,), (999,), (1000,), (-1234567,), (10**15,)], "n long")
    got = [tuple(x) for x in df.select(text.with_commas(F.col("n")), text.zero_padded(F.abs("n"), 4)).collect()]
    assert got == [(f"{n:,}", f"{abs(n):04d}") for n in (0, 7, 999, 1000, -1234567, 10**15)]


# ---- reads without an alignment, eligibility, orientation, the network's query


def test_histogram_of_reads_without_an_alignment(spark):
    r = random.Random(14)
    rows, want = [], {}
    for k in range(40):
        seq = "".join(r.choices("ACGTN", k=r.choice([0, 3, 50])))
        flag = r.choice([0, 4, 16, 256, 2048])
        at = np.array([i for i, b in enumerate(seq) if b in "CG" and r.random() < 0.8], dtype=np.int64)
        p = np.array([r.randrange(256) for _ in at], dtype=np.int64)
        mm, ml = mods.encode(seq, at, np.array([seq[i] == "G" for i in at], dtype=np.int64), p)
        rows.append((k, flag, seq, mm, [int(x) for x in ml] if mm is not None else None))
        if flag & 0x900:
            continue
        for i, x in zip(at.tolist(), p.tolist()):
            three, back = seq[i : i + 3], seq[i - 2 : i + 1] if i >= 2 else ""
            if three.startswith("CG"):
                context = "CpG"
            elif re.fullmatch("C[ACT]G", three):
                context = "CHG"
            elif re.fullmatch("C[ACT][ACT]", three) or re.fullmatch("[AGT][AGT]G", back):
                context = "CHH"
            else:
                continue
            want[context, x] = want.get((context, x), 0) + 1
    df = spark.createDataFrame(rows, "read_id long, flag int, seq string, mm string, ml array<int>").repartition(3)
    assert {(x.context, x.scaled_prob): x.n for x in mods.own_histogram(df).collect()} == want and any(f == 4 for _, f, *_ in rows)


def test_eligible_reads_have_whole_kinetics(spark):
    full = [1] * 8
    rows = [(0, "ACGTACGT", full, full, full, full), (1, "ACG", [1] * 3, [1] * 3, [1] * 3, [1] * 3), (2, "ACGTACGT", full, full, full, None), (3, "ACGTACGT", full, full[:7], full, full), (4, None, full, full, full, full)]
    df = spark.createDataFrame(rows, "read_id long, seq string, fi array<int>, fp array<int>, ri array<int>, rp array<int>")
    assert [x.read_id for x in sampling.eligible(df, 5).collect()] == [0] and sampling.eligible(df).count() == 0


def test_bases_by_strand(spark):
    seq, turn = "ACCGTTGAn", str.maketrans("ACGTacgt", "TGCAtgca")
    df = spark.createDataFrame([(seq, i, rev) for i in range(len(seq) - 2) for rev in (True, False)], "seq string, at int, rev boolean")
    for x in df.withColumn("got", motifs.oriented_bases(F.col("seq"), F.col("at"), 3, F.col("rev"))).collect():
        whole = seq.translate(turn)[::-1] if x.rev else seq
        assert x.got == whole[x.at : x.at + 3]


def test_sites_scored_by_the_network_equal_plain_loops(spark):
    """What ``score_sites_network`` does, on short reads, against the network written out in loops."""
    r, kmer = random.Random(21), 401
    scorer = scoring.ConvScorer.untrained("CpG", kmer)
    reads = [(k, "".join(r.choices("ACGT", k=n)), *([r.randrange(953) for _ in range(n)] for _ in range(4))) for k, n in enumerate((30, 250))]
    df = spark.createDataFrame(reads, "read_id long, seq string, fi array<int>, fp array<int>, ri array<int>, rp array<int>")
    got = {(x.read_id, x.qoff): x.scaled_prob for x in scoring.call_sites(df, [scorer], batch=3).collect()}
    sites = [(k, i) for k, seq, *_ in reads for i in range(len(seq) - 1) if seq[i : i + 2] == "CG"]
    assert set(got) == set(sites)
    p = scorer.parameters
    for k, site in r.sample(sites, 3):
        _, seq, fi, fp, ri, rp = reads[k]
        x = np.zeros((kmer, 8))
        for j in range(kmer):
            at = site - kmer // 2 + j
            if 0 <= at < len(seq):
                x[j, "ACGT".index(seq[at])] = 1
                x[j, 4:] = [fi[at] / 952, fp[at] / 952, ri[len(seq) - 1 - at] / 952, rp[len(seq) - 1 - at] / 952]
        norm = lambda h, n: (h - n[0]) / np.sqrt(n[1] + 1e-5) * n[2] + n[3]
        x = norm(x, p["norm0"])
        for layer in range(1, 9):
            kernel = p[f"conv{layer}"]
            padded = np.concatenate([np.zeros((1, x.shape[1])), x, np.zeros((1, x.shape[1]))])
            out = [[float((padded[2 * t : 2 * t + kernel.shape[2]].T * kernel[f]).sum()) for f in range(kernel.shape[0])] for t in range((len(padded) - kernel.shape[2]) // 2 + 1)]
            x = np.maximum(norm(np.array(out), p[f"norm{layer}"]), 0)
        hidden = np.maximum(p["dense1"] @ x.T.ravel() + p["bias1"], 0)
        z = p["dense2"] @ hidden + p["bias2"]
        assert abs(got[k, site] - 255 / (1 + math.exp(z[0] - z[1]))) <= 1.01

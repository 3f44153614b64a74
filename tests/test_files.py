"""Named files, and the training layout."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from methspark.functions import kinetics
from methspark.sources import text, training


def test_named_site_files_are_the_same_at_any_partitioning(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice("abz"), k, k + 1, 100.0 * (k % 7) / 7, k % 7, 7 - k % 7, r.choice(["CpG", "CHH"])) for k in range(3000)]
    contigs = spark.createDataFrame([(0, "z"), (1, "a")], "sid int, chrom string")
    order = {"z": 0, "a": 1, "b": 2}
    sites = spark.createDataFrame(rows, "chrom string, start int, end int, freq double, pcov int, ncov int, context string")
    for parts in (1, 7, 40):
        (tmp_path / str(parts)).mkdir()
        text.write_site_files(sites.repartition(parts), str(tmp_path / str(parts) / "x"), contigs)
    for context in ("CpG", "CHG", "CHH"):
        own = sorted((x for x in rows if x[6] == context), key=lambda x: (order[x[0]], x[1]))
        want = "".join("\t".join([x[0], str(x[1]), str(x[2]), f"{x[3]:g}", str(x[4]), str(x[5])]) + "\n" for x in own)
        assert [(tmp_path / str(p) / f"x.{context}.cov.bed").read_text() for p in (1, 7, 40)] == [want] * 3
    text.write_truth_file(sites.drop("context"), str(tmp_path / "t.bed"), contigs)
    assert len((tmp_path / "t.bed").read_text().splitlines()) == 3000
    with pytest.raises(ValueError, match="any place"):
        text.write_site_files(sites, "mock://x/y")
    samples = spark.createDataFrame([(c, k % 5, k % 2, k % 3 % 2, k % 256) for k in range(500) for c in ("CpG", "CHG")], "context string, replicate int, label int, predict int, scaled_prob int")
    text.write_sample_files(samples, str(tmp_path / "s"), ("CpG", "CHG", "CHH"))
    for k in range(5):
        lines = [x.split("\t") for x in (tmp_path / f"s.CpG.{k}").read_text().splitlines()]
        assert len(lines) == 100 and [x[0] for x in lines] == ["1"] * 50 + ["0"] * 50 and (tmp_path / f"s.CHH.{k}").read_bytes() == b""
    back = text.read_sample_files(spark, str(tmp_path / "s"))
    assert sorted((x.context, x.replicate, x.label, x.predict, round(x.prob * 255)) for x in back.collect()) == sorted(map(tuple, samples.collect()))


def test_training_files_round_trip(spark, tmp_path):
    r = random.Random(5)
    reads = {}
    for k in range(40):
        n = r.choice([1, 5, 30, 300])
        reads[k * 3] = ("".join(r.choices("ACGTN", k=n)), [[r.randrange(256) for _ in range(n)] for _ in range(4)])
    rows = [(k, s, *a, 7, 8) for k, (s, a) in reads.items()] + [(500, "ACG", None, None, None, None, 0, 0)]
    df = spark.createDataFrame(rows, "read_id long, seq string, fi array<int>, fp array<int>, ri array<int>, rp array<int>, fn int, rn int").repartition(5)
    training.write_blob(df, str(tmp_path / "t"))
    places = [tuple(x) for x in training.read_offsets(spark, str(tmp_path / "t")).orderBy("offset").collect()]
    sizes = [len(reads[k][0]) for k in sorted(reads)]
    assert places == [(sum(sizes[:i]), k, sizes[i], 7, 8) for i, k in enumerate(sorted(reads))]
    blob = np.fromfile(tmp_path / "t" / "features", dtype=np.uint8)
    assert len(blob) == 5 * sum(sizes)
    for offset, k, n, _, _ in places:
        seq, (fi, fp, ri, rp) = reads[k]
        own = blob[5 * offset : 5 * (offset + n)].reshape(5, n)
        assert own[0].tolist() == ["ACGTN".index(b) for b in seq] and own[1:].tolist() == [fi, fp, ri[::-1], rp[::-1]]
    samples = [(k, i, r.choice([-1, 0, 1, 5])) for k, (seq, _) in reads.items() for i, b in enumerate(seq) if b in "CG"]
    (tmp_path / "samples").write_text("".join(f"{k} {i}\t{y} \n" for k, i, y in samples))
    for kmer in (1, 21, 401):
        got = training.training_windows(spark, str(tmp_path / "t"), training.read_samples(spark, str(tmp_path / "samples")), kmer).collect()
        assert sorted((x.id, x.qoff, x.label) for x in got) == sorted((k, i, int(y > 0)) for k, i, y in samples)
        for x in got[:: max(1, len(got) // 60)]:
            seq, arrays = reads[x.id]
            features = kinetics.base_features(seq, *[kinetics.decode_array(np.array(a)).astype(np.float32) for a in arrays])
            want = kinetics.windows(features, np.array([x.qoff]), kmer)[0]
            if seq[x.qoff] == "G":  # the window as the other strand runs
                want = want[::-1][:, [3, 2, 1, 0, 6, 7, 4, 5]]
            assert np.array_equal(training.expanded(np.frombuffer(bytes(x.window), dtype=np.uint8), kmer)[0], want)
            assert want[kmer // 2, 1] == 1
    for bad, message in (((0, 10**6, 1), "no C or G"), ((1, 0, 1), "no read 1")):
        with pytest.raises(Exception, match=message):
            training.training_windows(spark, str(tmp_path / "t"), spark.createDataFrame([bad], "id long, qoff int, label int"), 21).collect()
    training.write_blob(df.filter(F.lit(False)), str(tmp_path / "none"))
    assert (tmp_path / "none" / "features").read_bytes() == b"" if (tmp_path / "none" / "features").exists() else True

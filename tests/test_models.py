"""Model files against onnxruntime, gradients against differences, and training on a planted signal."""

import numpy as np
import pytest

from methspark.operators import scoring, training
from methspark.sources import onnx_file

SMALL = dict(filters=(6, 4), widths=(5, 3), dense=7)


def noisy(kmer, seed, **shape):
    r = np.random.default_rng(seed)
    p = training.fresh_parameters(kmer, seed=seed, **shape)
    return {k: v + r.normal(0, 0.2, v.shape) if not k.startswith("norm") else np.stack([r.normal(0, 0.2, v.shape[1]), r.uniform(0.5, 2, v.shape[1]), r.uniform(0.5, 2, v.shape[1]), r.normal(0, 0.2, v.shape[1])]) for k, v in p.items()}


@pytest.mark.parametrize("kmer", [401, 701])
def test_a_written_model_scores_the_same_in_onnxruntime_and_comes_back(tmp_path, kmer):
    scorer = scoring.ConvScorer.untrained("CpG", kmer)
    scorer.save(str(tmp_path / "m.onnx"))
    x = np.random.default_rng(0).random((7, kmer, 8)).astype(np.float32)
    other = scoring.OnnxScorer("CpG", str(tmp_path / "m.onnx"), kmer)
    assert np.allclose(other.score(x), scorer.score(x), rtol=1e-5, atol=1e-5)
    back = scoring.ConvScorer.load("CpG", kmer, str(tmp_path / "m.onnx"))
    assert all(np.array_equal(back.parameters[k], v) for k, v in scorer.parameters.items())
    with pytest.raises(ValueError, match="windows of"):
        scoring.ConvScorer.load("CpG", 21, str(tmp_path / "m.onnx"))
    with pytest.raises(ValueError, match="expected"):
        scoring.OnnxScorer("CpG", str(tmp_path / "m.onnx"), 21).score(x)


def test_exported_forms_are_read(tmp_path):
    """Normalisations folded into convolutions, dense layers as MatMul and Add: as onnxruntime scores them, so do we."""
    kmer, p = 61, noisy(61, 3, **SMALL)
    node, tensor, data, weights, nodes, last = onnx_file._node, onnx_file._tensor, onnx_file._bytes, [], [], "input"

    def add(kind, extra, **attributes):
        nonlocal last
        out = "output" if kind == "Add" and "b2" in extra else f"v{len(nodes)}"
        weights.extend(tensor(k, v) for k, v in extra.items())
        nodes.append(node(kind, [last, *extra], out, **attributes))
        last = out

    add("Transpose", {}, perm=[0, 2, 1])
    mean, variance, factor, offset = p["norm0"]
    add("BatchNormalization", {"f": factor, "o": offset, "m": mean, "v": variance}, epsilon=1e-3)
    for k in (1, 2):
        mean, variance, factor, offset = p[f"norm{k}"]
        scale = factor / np.sqrt(variance + 1e-5)
        add("Conv", {f"w{k}": p[f"conv{k}"] * scale[:, None, None], f"c{k}": offset - mean * scale}, strides=[2], pads=[1, 1], kernel_shape=[p[f"conv{k}"].shape[2]])
        add("Relu", {})
    add("Flatten", {}, axis=1)
    add("MatMul", {"d1": p["dense1"].T})
    add("Add", {"b1": p["bias1"]})
    add("Relu", {})
    add("MatMul", {"d2": p["dense2"].T})
    add("Add", {"b2": p["bias2"]})
    graph = b"".join(data(1, n) for n in nodes) + data(2, "g") + b"".join(data(5, w) for w in weights) + data(11, onnx_file._value("input", ["b", kmer, 8])) + data(12, onnx_file._value("output", ["b", 2]))
    (tmp_path / "x.onnx").write_bytes(onnx_file._number(1, 6) + data(7, graph) + data(8, data(1, "") + onnx_file._number(2, 11)))
    x = np.random.default_rng(1).random((5, kmer, 8)).astype(np.float32)
    ours = scoring.ConvScorer.load("CHG", kmer, str(tmp_path / "x.onnx"))
    assert np.allclose(scoring.OnnxScorer("CHG", str(tmp_path / "x.onnx"), kmer).score(x), ours.score(x), rtol=1e-4, atol=1e-5)


def test_other_files_are_refused(tmp_path):
    scorer = scoring.ConvScorer("CpG", 61, noisy(61, 1, **SMALL))
    whole = onnx_file.model_bytes(scorer.parameters, 61)
    for bad in (b"", b"text", whole[: len(whole) // 2], whole.replace(b"Relu", b"Selu"), whole.replace(b"strides", b"stridez")):
        with pytest.raises((ValueError, IndexError, KeyError)):
            onnx_file.read_parameters(bad)


def test_gradients_equal_differences():
    kmer = 41
    p = noisy(kmer, 7, **SMALL)
    r = np.random.default_rng(2)
    x, y = r.random((9, kmer, 8)), r.integers(0, 2, 9)
    loss, grads = training.gradients(p, x, y)
    assert loss > 0 and grads.keys() == p.keys()
    for name, value in p.items():
        places = list(np.ndindex(value.shape))
        for place in [places[k] for k in r.permutation(len(places))[:12]]:
            if name.startswith("norm") and place[0] < 2:
                continue
            around = []
            for step in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in p.items()}
                moved[name][place] += step
                around.append(training.gradients(moved, x, y)[0])
            assert abs((around[0] - around[1]) / 2e-6 - grads[name][place]) < 1e-5, (name, place)
    assert np.allclose(grads["norm0"][0], x.mean(axis=(0, 1))) and np.allclose(grads["norm0"][1], x.reshape(-1, 8).var(axis=0, ddof=1))


def test_the_running_network_is_the_scorer():
    """With the batch's statistics as running ones the scorer's loss is the one trained on."""
    kmer, r = 41, np.random.default_rng(4)
    p = noisy(kmer, 9, **SMALL)
    x, y = r.random((400, kmer, 8)), r.integers(0, 2, 400)
    loss, grads = training.gradients(p, x, y)
    own = {k: np.concatenate([grads[k][:2], v[2:]]) if k.startswith("norm") else v for k, v in p.items()}
    z = scoring.ConvScorer("CpG", kmer, own).score(x.astype(np.float32)).astype(float)
    log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert abs(-log_p[np.arange(400), y].mean() - loss) < 1e-2


def test_a_planted_signal_is_learned_whatever_the_partitions(spark):
    kmer, r = 21, np.random.default_rng(6)
    rows = []
    for k in range(600):
        planes = np.stack([r.integers(0, 4, kmer), *r.integers(0, 120, (4, kmer))]).astype(np.uint8)
        label = k % 2
        planes[0, kmer // 2] = 1
        if label:
            planes[1, kmer // 2 - 2 : kmer // 2 + 2] = 230  # long intervals where the base is modified
        rows.append((k // 3, k % 3, label, bytearray(planes.tobytes())))
    schema = "id long, qoff int, label int, window binary"
    start = training.fresh_parameters(kmer, seed=2, **SMALL)
    got = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, schema).repartition(parts)
        got.append(training.train(df, "CpG", kmer, start, epochs=2, batch=40, micro=20, rate=0.2))
    (one, losses), (other, _) = got
    assert all(np.allclose(one.parameters[k], other.parameters[k], rtol=1e-4, atol=1e-5) for k in one.parameters)
    assert np.mean(losses[-2:]) < 0.5 * losses[0]
    x = training.expanded(np.frombuffer(b"".join(bytes(row[3]) for row in rows), dtype=np.uint8), kmer)
    called = scoring.quantised(one.score(x)) >= 128
    assert (called == np.array([row[2] for row in rows], dtype=bool)).mean() > 0.95

"""Model files of the network in ONNX's wire format: written from, and read to, the parameters of ``scoring.ConvScorer``.

Only what such a network needs of the format is here: a chain of nodes (batch normalisations, strided convolutions, rectifiers, dense layers) and their
weights as 32-bit floats. Reading takes the chain as exporters write it, with normalisations as nodes or folded into a convolution's offsets, and dense
layers as Gemm or as MatMul and Add; any other node, stride or padding is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

#: Numbers of the fields and types used (fixed values of the format).
FLOAT, INTS, INT, FLOAT_ATTRIBUTE = 1, 7, 2, 1
OPSET, IR_VERSION = 11, 6
STRIDE, PADDING, EPSILON = 2, 1, 1e-5


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def fields(data: memoryview) -> Iterator[tuple[int, object]]:
    """Number and value of a message's fields: whole numbers, or the bytes of anything else."""
    at = 0
    while at < len(data):
        key, at = _read_varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _read_varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _read_varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("not a model file")
        if at > len(data):
            raise ValueError("a model file that is cut off")
        yield key >> 3, value


def _tensor(name: str, x: np.ndarray) -> bytes:
    return b"".join(_number(1, n) for n in x.shape) + _number(2, FLOAT) + _bytes(8, name) + _bytes(9, np.ascontiguousarray(x, dtype="<f4").tobytes())


def _attribute(name: str, value: int | float | list[int]) -> bytes:
    if isinstance(value, list):
        return _bytes(1, name) + b"".join(_number(8, n) for n in value) + _number(20, INTS)
    if isinstance(value, float):
        return _bytes(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", value) + _number(20, FLOAT_ATTRIBUTE)
    return _bytes(1, name) + _number(3, value) + _number(20, INT)


def _node(kind: str, inputs: list[str], output: str, **attributes) -> bytes:
    return b"".join(_bytes(1, n) for n in inputs) + _bytes(2, output) + _bytes(3, f"{kind}_{output}") + _bytes(4, kind) + b"".join(_bytes(5, _attribute(k, v)) for k, v in attributes.items())


def _value(name: str, shape: list[int | str]) -> bytes:
    dims = b"".join(_bytes(1, _bytes(2, n) if isinstance(n, str) else _number(1, n)) for n in shape)
    return _bytes(1, name) + _bytes(2, _bytes(1, _number(1, FLOAT) + _bytes(2, dims)))


def model_bytes(parameters: dict[str, np.ndarray], kmer: int) -> bytes:
    """A model with input (batch, kmer, channels) and output (batch, 2)."""
    nodes, weights, last = [], [], "input"
    layers = sum(name.startswith("conv") for name in parameters)

    def add(kind: str, extra: dict[str, np.ndarray], **attributes) -> None:
        nonlocal last
        out = "output" if kind == "Gemm" and "dense2" in extra else f"v{len(nodes)}"
        weights.extend(_tensor(name, x) for name, x in extra.items())
        nodes.append(_node(kind, [last, *extra], out, **attributes))
        last = out

    def normed(k: int) -> None:
        mean, variance, factor, offset = parameters[f"norm{k}"]
        add("BatchNormalization", {f"norm{k}.factor": factor, f"norm{k}.offset": offset, f"norm{k}.mean": mean, f"norm{k}.variance": variance}, epsilon=EPSILON)

    add("Transpose", {}, perm=[0, 2, 1])
    normed(0)
    for k in range(1, layers + 1):
        add("Conv", {f"conv{k}": parameters[f"conv{k}"]}, strides=[STRIDE], pads=[PADDING, PADDING], kernel_shape=[parameters[f"conv{k}"].shape[2]], dilations=[1], group=1)
        normed(k)
        add("Relu", {})
    add("Flatten", {}, axis=1)
    add("Gemm", {"dense1": parameters["dense1"], "bias1": parameters["bias1"]}, transB=1)
    add("Relu", {})
    add("Gemm", {"dense2": parameters["dense2"], "bias2": parameters["bias2"]}, transB=1)
    channels = parameters["norm0"].shape[1]
    graph = b"".join(_bytes(1, n) for n in nodes) + _bytes(2, "calls") + b"".join(_bytes(5, w) for w in weights) + _bytes(11, _value("input", ["batch", kmer, channels])) + _bytes(12, _value("output", ["batch", 2]))
    return _number(1, IR_VERSION) + _bytes(2, "methspark") + _bytes(7, graph) + _bytes(8, _bytes(1, "") + _number(2, OPSET))


def _read_tensor(data: memoryview) -> tuple[str, np.ndarray]:
    dims, name, raw, floats, kind = [], "", None, [], FLOAT
    for number, value in fields(data):
        if number == 1:
            dims += [value] if isinstance(value, int) else _packed(value)
        elif number == 2:
            kind = value
        elif number == 4:
            floats.append(np.frombuffer(value, dtype="<f4"))
        elif number == 8:
            name = bytes(value).decode()
        elif number == 9:
            raw = np.frombuffer(value, dtype="<f4") if kind == FLOAT else None
    if kind != FLOAT:
        return name, np.zeros(0, dtype=np.float32)
    return name, (raw if raw is not None else np.concatenate([*floats, np.zeros(0, dtype=np.float32)])).reshape(dims)


def _packed(data: memoryview) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = _read_varint(data, at)
        out.append(n)
    return out


def _read_node(data: memoryview) -> tuple[str, list[str], list[str], dict]:
    kind, inputs, outputs, attributes = "", [], [], {}
    for number, value in fields(data):
        if number == 1:
            inputs.append(bytes(value).decode())
        elif number == 2:
            outputs.append(bytes(value).decode())
        elif number == 4:
            kind = bytes(value).decode()
        elif number == 5:
            name, own = "", []
            for n, v in fields(value):
                if n == 1:
                    name = bytes(v).decode()
                elif n == 2:
                    own = struct.unpack("<f", v)[0]
                elif n == 3:
                    own = v
                elif n == 8:
                    own += [v] if isinstance(v, int) else _packed(v)
            attributes[name] = own
    return kind, inputs, outputs, attributes


def read_parameters(data: bytes) -> tuple[dict[str, np.ndarray], int | None]:
    """The parameters of a model file, and the length of its windows if the file says it."""
    graph = next((v for n, v in fields(memoryview(data)) if n == 7), None)
    if graph is None:
        raise ValueError("not a model file")
    weights, nodes, shapes = {}, [], {}
    for number, value in fields(graph):
        if number == 1:
            nodes.append(_read_node(value))
        elif number == 5:
            name, x = _read_tensor(value)
            weights[name] = x
        elif number == 11:
            own = dict(fields(value))
            kind = dict(fields(dict(fields(own[2]))[1]))
            shapes[bytes(own[1]).decode()] = [dict(fields(d)).get(1) for n, d in fields(kind[2]) if n == 1] if 2 in kind else []
    shape = next((s for name, s in shapes.items() if name not in weights), [])
    out: dict[str, np.ndarray] = {}
    convs = dense = 0
    for kind, inputs, _, attributes in nodes:
        own = [weights[i] for i in inputs if i in weights]
        if kind == "BatchNormalization":
            factor, offset, mean, variance = own
            if abs(attributes.get("epsilon", EPSILON) - EPSILON) > 1e-9:
                variance = variance + np.float32(attributes["epsilon"] - EPSILON)
            if f"norm{convs}" in out:  # after a convolution with an offset: both are one
                held = out[f"norm{convs}"][3]
                mean = mean - held
            out[f"norm{convs}"] = np.stack([mean, variance, factor, offset])
        elif kind == "Conv":
            if attributes.get("strides") != [STRIDE] or attributes.get("pads") != [PADDING, PADDING] or attributes.get("dilations", [1]) != [1] or attributes.get("group", 1) != 1:
                raise ValueError(f"a convolution with {attributes}")
            if not convs and "norm0" not in out:
                out["norm0"] = _no_norm(own[0].shape[1])
            convs += 1
            out[f"conv{convs}"] = own[0]
            if len(own) > 1:
                out[f"norm{convs}"] = _no_norm(len(own[1]), own[1])
        elif kind in ("Gemm", "MatMul"):
            dense += 1
            turned = kind == "Gemm" and attributes.get("transB", 0)
            out[f"dense{dense}"] = own[0] if turned else own[0].T
            out[f"bias{dense}"] = own[1] if len(own) > 1 else np.zeros(out[f"dense{dense}"].shape[0], dtype=np.float32)
        elif kind == "Add" and own and dense:
            out[f"bias{dense}"] = out[f"bias{dense}"] + own[0].ravel()
        elif kind not in ("Transpose", "Relu", "Flatten", "Identity", "Reshape", "Constant", "Shape"):
            raise ValueError(f"a node {kind!r} is no part of the network")
    if not convs or dense != 2:
        raise ValueError("not the network's chain of layers")
    for k in range(1, convs + 1):
        if f"norm{k}" not in out:
            out[f"norm{k}"] = _no_norm(out[f"conv{k}"].shape[0])
    return out, shape[1] if len(shape) == 3 and shape[1] else None


def _no_norm(n: int, offset: np.ndarray | None = None) -> np.ndarray:
    """A normalisation that adds an offset and changes nothing else."""
    return np.stack([np.zeros(n), np.full(n, 1 - EPSILON), np.ones(n), np.zeros(n) if offset is None else offset]).astype(np.float32)

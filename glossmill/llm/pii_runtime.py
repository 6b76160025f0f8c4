"""The network of `pii` as a model for ONNX Runtime, written byte by byte: two scans over time, one for each direction.

It computes what `pii.scores` does in numpy, in single precision as well; the runtime's tanh and sigmoid are several times as fast.
"""

from __future__ import annotations

import numpy as np

FLOAT, INT64 = 1, 7  # element types


def _number(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _part(field: int, body: int | str | bytes) -> bytes:
    if isinstance(body, int):
        return _number(field << 3) + _number(body)
    body = body.encode() if isinstance(body, str) else body
    return _number(field << 3 | 2) + _number(len(body)) + body


def _tensor(name: str, a: np.ndarray) -> bytes:
    kind = {"float32": FLOAT, "int64": INT64}[a.dtype.name]
    return b"".join(_part(1, d) for d in a.shape) + _part(2, kind) + _part(8, name) + _part(9, np.ascontiguousarray(a).tobytes())


def _value(name: str, kind: int, *dims: int | str) -> bytes:
    shape = b"".join(_part(1, _part(2 if isinstance(d, str) else 1, d)) for d in dims)
    return _part(1, name) + _part(2, _part(1, _part(1, kind) + _part(2, shape)))


def _attribute(name: str, v: int | bytes | list[int]) -> bytes:
    if isinstance(v, int):
        return _part(1, name) + _part(20, 2) + _part(3, v)
    if isinstance(v, bytes):  # a graph
        return _part(1, name) + _part(20, 5) + _part(6, v)
    return _part(1, name) + _part(20, 7) + b"".join(_part(8, i) for i in v)


def _node(op: str, inputs: str, outputs: str, **attributes: int | bytes | list[int]) -> bytes:
    names = b"".join(_part(1, i) for i in inputs.split()) + b"".join(_part(2, o) for o in outputs.split())
    return names + _part(4, op) + b"".join(_part(5, _attribute(k, v)) for k, v in attributes.items())


def _graph(name: str, nodes: list[bytes], tensors: list[bytes], inputs: list[bytes], outputs: list[bytes]) -> bytes:
    fields = ((1, nodes), (2, [name]), (5, tensors), (11, inputs), (12, outputs))
    return b"".join(_part(field, body) for field, bodies in fields for body in bodies)


def _step(d: str, size: int, tags: int) -> bytes:
    """One step of direction `d` for all columns: gates from a character's row and the state, then the tags' scores, added to
    the bias or, from the end, to what the other direction said."""
    nodes = [
        _node("Gather", f"table_{d} x", "input"),
        _node("Gemm", f"h wh_{d} input", "gates"),
        _node("Split", "gates quarters", "i f o u", axis=1),
        *(_node("Sigmoid", g, f"{g}_on") for g in "ifo"),
        _node("Tanh", "u", "u_on"),
        _node("Mul", "i_on u_on", "new"),
        _node("Mul", "f_on c", "kept"),
        _node("Add", "new kept", "c_next"),
        _node("Tanh", "c_next", "c_on"),
        _node("Mul", "o_on c_on", "h_next"),
        _node("Gemm", f"out_{d} h_next {'bias' if d == 'f' else 'before'}", "said", transB=1),
    ]
    inputs = [_value("h", FLOAT, "batch", size), _value("c", FLOAT, "batch", size), _value("x", INT64, "batch")]
    inputs += [_value("before", FLOAT, tags, "batch")] if d == "b" else []
    outputs = [_value("h_next", FLOAT, "batch", size), _value("c_next", FLOAT, "batch", size), _value("said", FLOAT, tags, "batch")]
    return _graph(f"step_{d}", nodes, [], inputs, outputs)


def model(m: dict[str, np.ndarray]) -> bytes:
    """From characters (time, batch) and a state of zeros (batch, size) to scores (time, tags, batch).

    Padding, character 0, has zeros as its row: a state of zeros stays exactly zero, so the direction from the end begins at
    each column's own last character. What stands beyond a column's end means nothing.
    """
    size, tags = m["wh_f"].shape[0], len(m["out_b"])
    tensors = [_tensor("quarters", np.full(4, size, np.int64)), _tensor("bias", m["out_b"][:, None])]
    for d, out in (("f", m["out"][:size]), ("b", m["out"][size:])):
        table = m["embed"] @ m[f"wx_{d}"] + m[f"b_{d}"]
        table[0] = 0.0
        tensors += [_tensor(f"table_{d}", table), _tensor(f"wh_{d}", m[f"wh_{d}"]), _tensor(f"out_{d}", out.T)]
    nodes = [
        _node("Scan", "zeros zeros x", "h_f c_f said_f", body=_step("f", size, tags), num_scan_inputs=1),
        _node("Scan", "zeros zeros x said_f", "h_b c_b scores", body=_step("b", size, tags), num_scan_inputs=2, scan_input_directions=[1, 1], scan_output_directions=[1]),
    ]
    inputs = [_value("x", INT64, "time", "batch"), _value("zeros", FLOAT, "batch", size)]
    graph = _graph("tagger", nodes, tensors, inputs, [_value("scores", FLOAT, "time", tags, "batch")])
    return _part(1, 8) + _part(7, graph) + _part(8, _part(2, 17))


def session(m: dict[str, np.ndarray]):
    """A session of one thread, or None where the runtime isn't installed."""
    try:
        import onnxruntime
    except ImportError:
        return None
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return onnxruntime.InferenceSession(model(m), options, providers=["CPUExecutionProvider"])

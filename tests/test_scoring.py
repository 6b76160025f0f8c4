"""Scoring with a model file, written here byte by byte, and whole texts through it; reading features by epoch."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from glossmill.operators import dataset, packing, scoring
from glossmill.plans import corpus
from glossmill.plans.settings import Settings


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def number(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def part(field, body):  # a field of bytes, text or a number
    if isinstance(body, int):
        return number(field << 3) + number(body)
    body = body.encode() if isinstance(body, str) else body
    return number(field << 3 | 2) + number(len(body)) + body


def tensor(name, a):
    return b"".join(part(1, d) for d in a.shape) + part(2, {"float32": 1, "int64": 7}[a.dtype.name]) + part(8, name) + part(9, a.tobytes())


def value(name, kind, dims):
    shape = b"".join(part(1, part(2, d) if isinstance(d, str) else part(1, d)) for d in dims)
    return part(1, name) + part(2, part(1, part(1, kind) + part(2, shape)))


def node(op, inputs, output, *attributes):
    return b"".join(part(1, i) for i in inputs) + part(2, output) + part(4, op) + b"".join(part(5, a) for a in attributes)


@pytest.fixture(scope="session")
def model(tmp_path_factory):
    """Scores that are rows of two tables by token id modulo 12, and a mask of tokens that aren't id 9 modulo 12."""
    pytest.importorskip("onnxruntime")
    case, punct = np.eye(12, 3, dtype=np.float32)[[i % 3 for i in range(12)]], np.eye(12, 6, dtype=np.float32)[[i % 6 for i in range(12)]]
    mask = np.array([i != 9 for i in range(12)], np.float32)[:, None]
    nodes = [node("Cast", ["ids"], "wide", part(1, "to") + part(3, 7) + part(20, 2)), node("Mod", ["wide", "twelve"], "at")]
    nodes += [node("Gather", [t, "at"], f"{t}_out") for t in ("case", "punct", "mask")]
    graph = b"".join(part(1, n) for n in nodes) + part(2, "tiny") + b"".join(part(5, tensor(n, a)) for n, a in (("twelve", np.array([12], np.int64)), ("case", case), ("punct", punct), ("mask", mask)))
    graph += b"".join(part(11, value(n, k, d)) for n, k, d in (("ids", 6, ["n", "t"]), ("valid", 6, ["n", "t"]), ("lens", 7, ["n"])))
    graph += b"".join(part(12, value(f"{t}_out", 1, ["n", "t", k])) for t, k in (("case", 3), ("punct", 6), ("mask", 1)))
    path = tmp_path_factory.mktemp("onnx") / "tiny.onnx"
    path.write_bytes(part(1, 8) + part(7, graph) + part(8, part(2, 13)))
    return str(path)


class Compacting:
    """The tiny model knows nothing of valid ids, so what it says of tokens is moved to word positions here."""

    def __init__(self, path):
        self.inner = scoring.OnnxScorer(path)

    def __call__(self, ids, valid, lengths):
        out = self.inner(ids, valid, lengths)
        assert len(out) == 3
        moved = [np.zeros_like(x) for x in out]
        for r in range(len(ids)):
            at = np.flatnonzero(valid[r])
            for x, y in zip(out, moved):
                y[r, : len(at)] = x[r, at]
        return moved[0], moved[1], moved[2][..., 0] > 0


def test_a_model_file_is_run(spark, model):
    text = "labas rytas kaip sekasi šiandien vilniuje upė teka pro miestą"
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "  ", 0), (4, "— !", 0)], "doc_id long, text string, row int").select("doc_id", "text")
    tokenizer = packing.FixedChunk(4)
    got = {r["doc_id"]: r["text"] for r in corpus.punctuated(docs, Settings(length=20), tokenizer, Compacting(model)).collect()}
    ids = {r["w"]: r["i"] for r in spark.createDataFrame([(w,) for w in text.split()], "w string").select("w", F.get(tokenizer.encode(F.col("w")), F.lit(0)).alias("i")).collect()}
    shown = []
    for w in text.split():
        i = ids[w] % 12
        if i != 9:
            shown.append([w, w.upper(), w.title()][i % 3] + ["", ",", ".", "?", ":", "—"][i % 6])
    assert got == {1: " ".join(shown)}


def test_epochs_deal_out_every_row_once(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(100)], "doc int, row int").repartition(3)
    seen = []
    for epoch in (0, 1):
        got = dataset.epoch_batches(rows, ["doc", "row"], 2, 2, 8, 5, epoch).collect()
        assert len({r["doc"] for r in got}) == 100
        assert {(r["doc"], r["shard"]) for r in got} == {(i, i % 4) for i in range(100)}
        for shard in range(4):
            at = sorted(r["batch_no"] * 8 + r["batch_pos"] for r in got if r["shard"] == shard)
            assert at == list(range(25))
        seen.append([r["doc"] for r in sorted(got, key=lambda r: (r["shard"], r["batch_no"], r["batch_pos"]))])
    assert seen[0] != seen[1]


def test_first_features_need_no_others(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(50)], "doc_id long, text string")
    make = lambda d: d.where("doc_id % 10 = 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("row"))
    got = dataset.first_features(docs, "doc_id", 4, make)
    assert {r["doc_id"] for r in got.collect()} >= {0, 10} and got.count() < 10
    assert dataset.first_features(docs, "doc_id", 1000, make).count() == 10
    assert dataset.first_features(docs.limit(0), "doc_id", 4, make).count() == 0


def test_masks_and_lookups(spark):
    rows = spark.createDataFrame([([5, 0, 7, 0],)], "ids array<int>")
    assert rows.select(packing.nonpad_mask(F.col("ids")).alias("m")).first()["m"] == [1, 0, 1, 0]
    table = spark.createDataFrame([(5, [1.0]), (7, [2.0])], "id int, v array<double>")
    got = packing.embedded(rows.select(F.posexplode("ids").alias("pos", "token")), table, "token", "id", "v").orderBy("pos").collect()
    assert [r["embedding"] for r in got] == [[1.0], None, [2.0], None]

"""Trains the tagger of `pii` in numpy and writes `pii_model.npz`.

    python -m glossmill.llm.pii_fit FOLDER [PROCESSES]

Examples: a third are sentences of `pii_examples.sentence`, which come from no corpus; the others are windows of at most DOCUMENTS
documents of FOLDER (those with the smallest hashed ids), labelled by `pii_examples.annotate`, with their spans renamed anew
each time. The shipped model was trained on /root/testdata/sf0.1, whose ids and texts are others than those it is tested
on. The loss is the CRF's negative log-likelihood; gradients are written out by hand (forward-backward for the CRF,
back-propagation through time for the LSTMs) and added up over processes, each of which makes its own examples.
"""

from __future__ import annotations

import random
import re
import sys
import time
from collections import Counter
from multiprocessing import Barrier, Process, RawArray

import numpy as np

from . import pii
from .pii_examples import annotate, sentence, varied

DOCUMENTS, STEPS, SIZE, EMBED, LENGTH, BATCH, RATE = 10_000, 9_000, 32, 24, 128, 32, 4e-3


def _lstm(x, table, wh):
    n, b = x.shape
    s = wh.shape[0]
    h, c = np.zeros((b, s), np.float32), np.zeros((b, s), np.float32)
    keep = []
    out = np.empty((n, b, s), np.float32)
    for t in range(n):
        z = table[x[t]] + h @ wh
        g = 1 / (1 + np.exp(-z[:, : 3 * s]))
        u = np.tanh(z[:, 3 * s :])
        c2 = g[:, s : 2 * s] * c + g[:, :s] * u
        tc = np.tanh(c2)
        keep.append((h, c, g, u, tc))
        h, c = g[:, 2 * s :] * tc, c2
        out[t] = h
    return out, keep


def _lstm_back(dout, keep, wh):
    n, b, s = dout.shape
    dz_all = np.empty((n, b, 4 * s), np.float32)
    dwh = np.zeros_like(wh)
    dh, dc = np.zeros((b, s), np.float32), np.zeros((b, s), np.float32)
    for t in range(n - 1, -1, -1):
        h, c, g, u, tc = keep[t]
        dh = dh + dout[t]
        i, f, o = g[:, :s], g[:, s : 2 * s], g[:, 2 * s :]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[t]
        dz[:, :s] = dc * u * i * (1 - i)
        dz[:, s : 2 * s] = dc * c * f * (1 - f)
        dz[:, 2 * s : 3 * s] = dh * tc * o * (1 - o)
        dz[:, 3 * s :] = dc * i * (1 - u * u)
        dwh += h.T @ dz
        dh = dz @ wh.T
        dc = dc * f
    return dz_all, dwh


def _crf(e, y, trans):
    """Mean negative log-likelihood and its gradients for scores (time, batch, tags) and tags (time, batch).

    Forward and backward sums run on probabilities that are scaled at every step, so each step is one matrix product.
    """
    n, b, _ = e.shape
    top = e.max(2, keepdims=True)
    p, m = np.exp((e - top).astype(np.float64)), np.exp(trans.astype(np.float64))
    alpha, beta, scale = np.empty_like(p), np.empty_like(p), np.empty((n, b))
    for t in range(n):
        a = p[t] * (alpha[t - 1] @ m if t else 1.0)
        scale[t] = a.sum(1)
        alpha[t] = a / scale[t][:, None]
    beta[-1] = 1.0
    for t in range(n - 2, -1, -1):
        beta[t] = (p[t + 1] * beta[t + 1]) @ m.T / scale[t + 1][:, None]
    de = alpha * beta
    right = p[1:] * beta[1:] / scale[1:][:, :, None]
    dtrans = np.tensordot(alpha[:-1], right, ((0, 1), (0, 1))) * m
    z = np.log(scale).sum(0) + top[:, :, 0].sum(0)
    ti, bi = np.arange(n)[:, None], np.arange(b)[None]
    gold = e[ti, bi, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
    de[ti, bi, y] -= 1
    np.add.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), -1)
    return float((z - gold).mean()), (de / b).astype(e.dtype), (dtrans / b).astype(trans.dtype)


def tags_of(n: int, spans) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for a, b, kind in spans:
        k = pii.KINDS.index(kind)
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


def _cropped(text: str, spans, at: int, size: int):
    """`size` characters around `at` with the spans in them; what a crop cuts off a span stays a span."""
    a = max(0, min(at, len(text) - size))
    return text[a : a + size], [(max(0, x - a), min(size, y - a), k) for x, y, k in spans if x < a + size and y > a]


def examples(docs: list[tuple[str, list]], index: np.ndarray, rng: random.Random):
    """Endless windows (characters, tags): of corpus texts, of sentences from no corpus, and of both one after another."""
    with_spans = [d for d in docs if d[1]]
    while True:
        u = rng.random()
        size = rng.randrange(16, LENGTH) if rng.random() < 0.25 else LENGTH  # as where a text ends
        if u < 0.65:
            text, spans = rng.choice(with_spans) if rng.random() < 0.5 else rng.choice(docs)
            at = rng.choice(spans)[0] - rng.randrange(size) if spans and rng.random() < 0.6 else rng.randrange(-20, len(text))
            text, spans = varied(*_cropped(text, spans, at, 2 * LENGTH), rng)
            text, spans = _cropped(text, spans, 0 if rng.random() < 0.5 else len(text) - size, size) if len(text) > size else (text, spans)
        else:
            text, spans = sentence(rng)
            if u < 0.8:
                other = rng.choice(docs)[0]
                at = rng.randrange(len(other))
                before = other[at : at + LENGTH]
                if not annotate(before):
                    before = before[: max(before.rfind(". "), before.rfind("\n")) + 2]
                    text, spans = before + text, [(a + len(before), b + len(before), k) for a, b, k in spans]
            if rng.random() < 0.06 and len(text.lower()) == len(text):
                text = text.lower()
            text, spans = _cropped(text, spans, rng.randrange(max(1, len(text) - size // 2)), size)
        if not text:
            continue
        x = index[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        if rng.random() < 0.3:  # characters outside the vocabulary
            for i in [i for i in range(len(text)) if rng.random() < 0.03]:
                x[i] = pii.kind_of(text[i])
        y = tags_of(len(text), spans)
        yield np.pad(x, (0, LENGTH - len(x))), np.pad(y, (0, LENGTH - len(y)))


def gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, r: np.random.Generator) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of windows (time, batch)."""
    hs, keeps = [], []
    for d in "fb":
        h, keep = _lstm(x if d == "f" else x[::-1], p["embed"] @ p[f"wx_{d}"] + p[f"b_{d}"], p[f"wh_{d}"])
        hs.append(h if d == "f" else h[::-1])
        keeps.append(keep)
    h = np.concatenate(hs, 2)
    drop = (r.random((1, *h.shape[1:]), np.float32) < 0.9).astype(np.float32) / 0.9
    hd = h * drop
    loss, de, dtrans = _crf(hd @ p["out"] + p["out_b"], y, p["trans"])
    g = {"out": np.tensordot(hd, de, ((0, 1), (0, 1))), "out_b": de.sum((0, 1)), "trans": dtrans, "embed": np.zeros_like(p["embed"])}
    dh = (de @ p["out"].T) * drop
    for d, keep in zip("fb", keeps):
        own = dh[:, :, :SIZE] if d == "f" else dh[::-1, :, SIZE:]
        dz, g[f"wh_{d}"] = _lstm_back(np.ascontiguousarray(own), keep, p[f"wh_{d}"])
        flat, ids = dz.reshape(-1, 4 * SIZE), (x if d == "f" else x[::-1]).ravel()
        order = np.argsort(ids, kind="stable")
        firsts = np.flatnonzero(np.concatenate([[True], np.diff(ids[order].astype(np.int64)) != 0]))
        dtable = np.zeros((len(p["embed"]), 4 * SIZE), np.float32)
        dtable[ids[order][firsts]] = np.add.reduceat(flat[order], firsts, axis=0)
        g[f"wx_{d}"], g[f"b_{d}"] = p["embed"].T @ dtable, flat.sum(0)
        g["embed"] += dtable @ p[f"wx_{d}"].T
    return loss, g


def _views(shapes: dict[str, tuple], shared) -> dict[str, np.ndarray]:
    flat, at, out = np.frombuffer(shared, np.float32), 0, {}
    for k, s in shapes.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def _work(k: int, steps: int, shapes, params, grads, losses, barrier, docs, index, seed: int) -> None:
    p, g = _views(shapes, params), _views(shapes, grads[k])
    source, r = examples(docs, index, random.Random(f"{seed}-{k}")), np.random.default_rng([seed, k])
    for _ in range(steps):
        batch = [next(source) for _ in range(BATCH)]
        loss, got = gradient(p, np.stack([b[0] for b in batch], 1), np.stack([b[1] for b in batch], 1), r)
        for name, a in got.items():
            g[name][:] = a
        losses[k] = loss
        barrier.wait()  # all gradients are there
        barrier.wait()  # the parameters are new


def fit(docs: list[str], seed: int = 0, steps: int = STEPS, processes: int = 8) -> None:
    rng, r = random.Random(seed), np.random.default_rng(seed)
    counts = Counter(c for t in docs for c in t)
    for _ in range(20_000):
        counts.update(sentence(rng)[0])
    chars = np.array(sorted(ord(c) for c, n in counts.items() if n >= 20 and not 0x0E00 <= ord(c) < 0x0E80 and ord(c) < 0x2E80 or c == "\uff20"), np.uint32)
    plain = frozenset(w for t in docs if t != t.lower() for w in re.findall(r"(?<![\w@.+-])[^\W\d_]+(?![\w@+-]|\.\w)", t) if w == w.lower())
    labelled = [(t, annotate(t, plain)) for t in docs]
    v = len(pii.OTHERS) + len(chars)
    init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    first = {"embed": init(v, EMBED) * np.sqrt(v) * 0.3, "out": init(2 * SIZE, pii.TAGS), "out_b": np.zeros(pii.TAGS, np.float32), "trans": np.zeros((pii.TAGS, pii.TAGS), np.float32)}
    for d in "fb":
        first |= {f"wx_{d}": init(EMBED, 4 * SIZE), f"wh_{d}": init(SIZE, 4 * SIZE), f"b_{d}": np.zeros(4 * SIZE, np.float32)}
        first[f"b_{d}"][SIZE : 2 * SIZE] = 1
    bad = [(i, j) for i in range(pii.TAGS) for j in range(2, pii.TAGS, 2) if i not in (j, j - 1)]
    shapes = {k: a.shape for k, a in first.items()}
    total = sum(int(np.prod(s)) for s in shapes.values())
    params, grads, losses = RawArray("f", total), [RawArray("f", total) for _ in range(processes)], RawArray("d", processes)
    p = _views(shapes, params)
    for k, a in first.items():
        p[k][:] = a
    for i, j in bad:
        p["trans"][i, j] = -20
    index = pii.index_of(chars).astype(np.intp)
    barrier = Barrier(processes + 1)
    team = [Process(target=_work, args=(k, steps, shapes, params, grads, losses, barrier, labelled, index, seed), daemon=True) for k in range(processes)]
    for t in team:
        t.start()
    flat, m1, m2 = np.frombuffer(params, np.float32), np.zeros(total, np.float32), np.zeros(total, np.float32)
    slow = np.zeros(total)  # a running mean of the parameters is what is kept
    began, mean = time.time(), None
    for step in range(1, steps + 1):
        barrier.wait()
        a = np.mean([np.frombuffer(g, np.float32) for g in grads], 0)
        a *= min(1.0, 5.0 / float(np.sqrt((a * a).sum())))
        rate = RATE * min(1, step / 100) * (1 - 0.98 * step / steps)
        m1 = 0.9 * m1 + 0.1 * a
        m2 = 0.999 * m2 + 0.001 * a * a
        flat -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        for i, j in bad:
            p["trans"][i, j] = -20
        slow = flat.astype(float) if step == 1 else slow + (flat - slow) * 0.01
        loss = float(np.mean(losses))
        mean = loss if mean is None else 0.98 * mean + 0.02 * loss
        barrier.wait()
        if step % 250 == 0 or step == steps:
            print(f"step {step}: loss {mean:.3f}, {time.time() - began:.0f} s", flush=True)
            kept = RawArray("f", total)
            np.frombuffer(kept, np.float32)[:] = slow
            np.savez_compressed(pii.MODEL, chars=chars, **{k: a.astype(np.float16) for k, a in _views(shapes, kept).items()})
    for t in team:
        t.join()


def main(folder: str, processes: str = "8") -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.getOrCreate()
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) > 0").orderBy(F.xxhash64("doc_id")).limit(DOCUMENTS)
    texts = [r["text"] for r in docs.select("text").collect()]
    spark.stop()
    fit(texts, processes=int(processes))


if __name__ == "__main__":
    main(*sys.argv[1:])

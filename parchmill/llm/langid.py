"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes in both directions, gives every
byte a distribution over the languages and over "no language", and a document
gets the mean over all its bytes. It is trained here, in numpy, by
backpropagation through time and Adam, on a bounded sample of labelled rows
(``TRAIN_ROWS`` documents, as many of each label, chosen by a hash of the id) and on generated noise
for the class ``und``. Every document is read whole, window after window, at
any length.

A document is rejected when "no language" has a mean probability of at least
``REJECT_FROM``; else it is accepted in its best language, whose mean
probability is the confidence.

Defined cases: a null, empty or blank text has lang_pred ``und``, confidence 0
and is rejected; null labels are left out of training; with no labelled row at
all every document is ``und``; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, read, slices, worker_kept

HIDDEN = 8
WINDOW = 96
#: Windows that are stepped through side by side.
LANES = 1024
#: Bound of the training sample: documents, and windows of each.
TRAIN_ROWS = 1200
#: Documents of each label, where it has them, however many labels there are.
LABEL_ROWS = 30
TRAIN_WINDOWS = 3
STEPS = 340
#: Mean probability of "no language" from which a document is rejected.
REJECT_FROM = 0.5
UNKNOWN = "und"
SCHEMA = "doc_id bigint, lang_pred string, confidence double, accepted boolean"


class Model(NamedTuple):
    """Weights; index 0 of the first axis reads forwards, 1 backwards. Gates are ordered update, reset, candidate."""

    labels: list[str]
    table: np.ndarray  # (2, 256, 3H): input weights of each byte, biases included
    gates: np.ndarray  # (2, H, 2H)
    cand: np.ndarray  # (2, H, H)
    out: np.ndarray  # (2H, K)
    bias: np.ndarray  # (K,)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1.0
    x *= 0.5
    return x


def _forward(m: Model, x: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hidden states, forwards and backwards (T, B, H), of byte windows x (T, B); the backward half starts at each window's own end."""
    steps, lanes = x.shape
    size = m.cand.shape[1]
    turned = np.where(np.arange(steps)[:, None] < lengths, lengths - 1 - np.arange(steps)[:, None], 0)
    both = np.stack([x, np.take_along_axis(x, turned, 0)])
    states = np.empty((2, steps, lanes, size), m.table.dtype)
    h = np.zeros((2, lanes, size), m.table.dtype)
    tables = m.table.reshape(512, -1)
    both = both + np.array([0, 256])[:, None, None]
    for t in range(steps):
        fixed = tables[both[:, t]]
        zr = np.matmul(h, m.gates)
        zr += fixed[:, :, : 2 * size]
        _sigmoid(zr)
        z, r = zr[:, :, :size], zr[:, :, size:]
        c = np.matmul(h * r, m.cand)
        c += fixed[:, :, 2 * size :]
        np.tanh(c, out=c)
        new = states[:, t]
        np.subtract(h, c, out=new)
        new *= z
        new += c
        if keep is not None:
            keep.append((h, z.copy(), r.copy(), c))
        h = new
    return states[0], np.take_along_axis(states[1], turned[:, :, None], 0)


def _logits(m: Model, states: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    size = m.cand.shape[1]
    return states[0] @ m.out[:size] + states[1] @ m.out[size:] + m.bias


def _windows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    at = np.minimum(starts + np.arange(WINDOW)[:, None], len(data) - 1)
    return np.where(np.arange(WINDOW)[:, None] < lengths, data[at], 0).astype(np.int64)


def train(texts: list[bytes], langs: list[str], steps: int = STEPS, seed: int = 0) -> Model:
    """Fit by backpropagation through time; ``und`` is learnt from generated noise."""
    rng = np.random.default_rng(seed)
    labels = [*sorted(set(langs)), UNKNOWN]
    size, count = HIDDEN, len(labels)
    noise = [bytes(rng.integers(33, 127, WINDOW, dtype=np.uint8)) for _ in range(len(texts) // 3 + 8)]
    noise += [bytes(rng.integers(0, 256, WINDOW, dtype=np.uint8)) for _ in range(len(texts) // 3 + 8)]
    noise += [bytes(rng.choice(np.frombuffer(b"0123456789 .,:;-/|#*", np.uint8), WINDOW)) for _ in range(len(texts) // 6 + 8)]
    rows: list[tuple[bytes, int]] = [(w, count - 1) for w in noise]
    for text, lang in zip(texts, langs, strict=True):
        for k in range(min(TRAIN_WINDOWS, -(-len(text) // WINDOW))):
            a = 0 if len(text) <= WINDOW else int(rng.integers(0, len(text) - WINDOW + 1))
            rows.append((text[a : a + WINDOW], labels.index(lang)))
    x = np.zeros((WINDOW, len(rows)), np.int64)
    lengths = np.array([len(r[0]) for r in rows])
    for k, (w, _) in enumerate(rows):
        x[: len(w), k] = np.frombuffer(w, np.uint8)
    y = np.array([r[1] for r in rows])
    # each class weighs the same, and so does each byte of a window
    weight = (1.0 / np.maximum(np.bincount(y, minlength=count), 1))[y]
    p = {
        "table": rng.normal(0, 0.3, (2, 256, 3 * size)),
        "gates": rng.normal(0, 0.3, (2, size, 2 * size)),
        "cand": rng.normal(0, 0.3, (2, size, size)),
        "out": rng.normal(0, 0.3, (2 * size, count)),
        "bias": np.zeros(count),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    draw = weight / weight.sum()
    for step in range(1, steps + 1):
        pick = rng.choice(len(rows), min(192, len(rows)), p=draw)
        _, g = loss_and_gradient(p, x[:, pick], y[pick], lengths[pick])
        norm = float(np.sqrt(sum((v.astype(np.float64) ** 2).sum() for v in g.values())))
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            grad = g[k] * min(1.0, 1.0 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad**2
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(labels, **p)


def loss_and_gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of windows x (T, B), whose bytes count alike, and its derivatives by backpropagation through time."""
    size, count, kind = p["cand"].shape[1], len(y), p["table"].dtype
    m = Model([], **p)
    keep: list = []
    states = _forward(m, x, lengths, keep)
    logits = _logits(m, states)
    top = logits.max(-1, keepdims=True)
    e = np.exp(logits - top)
    total = e.sum(-1, keepdims=True)
    inside = (np.arange(len(x))[:, None] < lengths).astype(kind)
    share = (inside / np.maximum(lengths, 1) / count).astype(kind)
    of = (slice(None), np.arange(count), y)
    loss = float(((top[..., 0] + np.log(total[..., 0]) - logits[of]) * share).sum())
    d = e / total
    d[of] -= 1
    d *= share[:, :, None]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["bias"] = d.sum((0, 1))
    for half in (0, 1):
        g["out"][half * size : (half + 1) * size] = np.einsum("tbh,tbk->hk", states[half], d)
    ds = np.stack([d @ p["out"][:size].T, d @ p["out"][size:].T])
    turned = np.where(np.arange(len(x))[:, None] < lengths, lengths - 1 - np.arange(len(x))[:, None], 0)
    back = np.take_along_axis(ds[1], turned[:, :, None], 0)
    ds[1] = back * inside[:, :, None]
    both = np.stack([x, np.take_along_axis(x, turned, 0)])
    dh = np.zeros((2, count, size), kind)
    flows: list[np.ndarray] = []
    for t in range(len(x) - 1, -1, -1):
        h, z, r, c = keep[t]
        dh = dh + ds[:, t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        drh = np.matmul(dc, p["cand"].transpose(0, 2, 1))
        dr = drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], -1)
        g["cand"] += np.matmul((h * r).transpose(0, 2, 1), dc)
        g["gates"] += np.matmul(h.transpose(0, 2, 1), dzr)
        fixed = np.concatenate([dzr, dc], -1)
        flows.append(fixed)
        dh = dh * z + drh * r + np.matmul(dzr, p["gates"].transpose(0, 2, 1))
    flow = np.stack(flows[::-1], 1).reshape(2, -1, 3 * size)
    for half in (0, 1):
        for k in range(3 * size):
            g["table"][half, :, k] = np.bincount(both[half].ravel(), flow[half, :, k], 256)
    return loss, g


def pooled(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean class probabilities over the bytes of each document (rows of zeros for documents without bytes)."""
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    starts = offsets[:-1][owner] + nth * WINDOW
    lengths = np.minimum(WINDOW, offsets[1:][owner] - starts)
    total = np.zeros((len(sizes), len(m.labels)))
    for a in range(0, len(owner), LANES):
        part = slice(a, a + LANES)
        states = _forward(m, _windows(data, starts[part], lengths[part]), lengths[part])
        logits = _logits(m, states)
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        logits *= (np.arange(WINDOW)[:, None] < lengths[part])[:, :, None]
        np.add.at(total, owner[part], logits.sum(0))
    return total / np.maximum(sizes, 1)[:, None]


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Train on documents whose ``lang`` is known: of each label ``rows`` / labels, at least ``LABEL_ROWS``, or all it has, by a hash of
    the id. Blank texts among them are left out."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and doc_id is not null")
    order = [F.xxhash64("doc_id", F.lit(5)), "doc_id"]
    each = max(LABEL_ROWS, rows // max(1, known.select("lang").distinct().count()))
    nth = F.row_number().over(W.partitionBy("lang").orderBy(*order))
    # ids and labels alone decide who is drawn; texts are read once, for those
    drawn = known.select("doc_id", "lang").withColumn("nth", nth).where(F.col("nth") <= each).select("doc_id").distinct()
    got = known.join(F.broadcast(drawn), "doc_id", "left_semi").where("trim(text) <> ''").select("doc_id", "lang", F.encode("text", "UTF-8").alias("bytes")).collect()
    if not got:
        return None
    got = list({r["doc_id"]: r for r in sorted(got, key=lambda r: (r["doc_id"], bytes(r["bytes"])))}.values())
    return train([bytes(r["bytes"]) for r in got], [r["lang"] for r in got])


def _verdicts(m: Model | None, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, list[bool]]:
    worker_kept("langid", lambda: None)  # what an earlier stage remembered goes
    texts = [b if b and not b.isspace() else b"" for b in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    if m is None:
        names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
    else:
        mean = pooled(m, np.frombuffer(b"".join(texts), np.uint8), offsets)
        last = len(m.labels) - 1
        best = mean[:, :last].max(1)
        named = (best > 0) & (mean[:, last] < REJECT_FROM)
        names = [m.labels[k] if ok else UNKNOWN for k, ok in zip(mean[:, :last].argmax(1), named, strict=True)]
    return names, best, [n != UNKNOWN for n in names]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Language, confidence and verdict for each row of ``docs(doc_id, text)``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names, best, good = _verdicts(shared.value, binary(batch.column(1)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(np.round(best, 6)), pa.array(good, pa.bool_())], names=["doc_id", "lang_pred", "confidence", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def accepted_language(spark: SparkSession, text: Column, model: Model | None) -> Column:
    """The language of an accepted text, null for a rejected one: :func:`identify` as an expression."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text"):
            names, _, good = _verdicts(shared.value, binary(part.column(0)).to_pylist())
            out += [n if g else None for n, g in zip(names, good, strict=True)]
        return pa.array(out, pa.string())

    # declared so, a filter on the result is not pushed below, where the network would run again
    return run.asNondeterministic()(text.cast("string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs))

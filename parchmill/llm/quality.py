"""Quality by ordinal regression: one hashed-text score, ordered thresholds.

A rated document has grade ``1 + quality - toxic`` (0 poor and toxic, 1 one
fault, 2 clean). The cumulative-link model is
``P(grade <= k) = sigmoid(theta_k - w.x)`` with theta_0 < theta_1: all grades
share the weights w, which belong to hashed features. Features are the distinct
words (folded, without edge punctuation), their first letters, what hangs on a
word's edges, its case, and coarse counts of the whole text; each counts once, as present.
``expected_grade`` is the model's mean grade, ``p_clean`` the probability of
the best grade, and ``selected`` says whether that is at least ``SELECT_FROM``.

It is fitted in numpy on a bounded sample of rated rows (``TRAIN_ROWS``, chosen
by a hash of the id); every document is then scored on its whole text.

Defined cases: a null, empty or blank text has grade 0, p_clean 0 and is not
selected; null ratings are left out; a document that is rated more than once
counts with its worst rating; of rated rows that repeat a doc_id with differing
texts one, the same in any order of rows, is learnt from; with no rated row every score is null and every
document that has words is selected; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Memo, binary, look_up, read, slices, word_hash, words_of, worker_kept

BITS = 18
SPACE = 1 << BITS
#: Letters of a word's beginning that make a feature.
PREFIX = 4
#: Bound of the training sample.
TRAIN_ROWS = 20_000
SEEN = 3
#: Rows that one step of the fit works on: bounds its memory, not its result.
STEP = 1000
ROUNDS = 80
PENALTY = 1e-4
SELECT_FROM = 0.8
SCHEMA = "doc_id bigint, expected_grade double, p_clean double, selected boolean"
_EDGES = b".,;:!?\"'()[]{}<>*#$%&|/\\-_=+~`@^"


class Model(NamedTuple):
    weights: np.ndarray  # (SPACE,) float32
    thresholds: np.ndarray  # (2,), ascending


def _features(word: bytes) -> int:
    """Three features of a word in one integer: its folded core, that core's beginning, its edges and case."""
    core = word.strip(_EDGES)
    head, tail = (word.split(core, 1) if core else (word, b""))
    text = core.decode("utf-8", "replace")
    case = b"U" if text.isupper() and len(text) > 1 else b"D" if text.isdigit() else b"w"
    shape = b"\0" + case + head[:3] + b"\1" + tail[-3:]
    text = text.casefold()
    begin = "\3" + text[:PREFIX]
    return (word_hash(text.encode()) % SPACE << 2 * BITS) | (word_hash(begin.encode()) % SPACE << BITS) | word_hash(shape) % SPACE


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids of each text, one after another, and their offsets."""
    memo = worker_kept("quality-words", lambda: Memo(_features))
    memo.trim()
    parts, offsets = words_of(texts)
    packed = look_up(parts, memo, int(offsets[-1]))
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), counts) << np.uint64(32)
    mask = np.uint64(SPACE - 1)
    cores = np.unique(owner | packed >> np.uint64(2 * BITS))
    begins = np.unique(owner | (packed >> np.uint64(BITS)) & mask)
    shapes = np.unique(owner | packed & mask)
    words = np.bincount((cores >> np.uint64(32)).astype(np.int64), minlength=len(texts))
    whole = []
    for k, (n, distinct) in enumerate(zip(counts.tolist(), words.tolist(), strict=True)):
        if n:
            for tag in (f"\2distinct {int(10 * distinct / n)} {int(np.log2(n))}", f"\2words {int(np.log2(n))}"):
                whole.append(k << 32 | word_hash(tag.encode()) % SPACE)
    all_ = np.unique(np.concatenate([cores, begins, shapes, np.array(whole, np.uint64)]))
    ends = np.searchsorted(all_, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    return (all_ & np.uint64(0xFFFFFFFF)).astype(np.int32), ends


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def probabilities(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade = 0, 1, 2) for each score."""
    upto = _sigmoid(thresholds[None, :] - score[:, None])
    return np.stack([upto[:, 0], upto[:, 1] - upto[:, 0], 1 - upto[:, 1]], 1)


def objective(ids: np.ndarray, offsets: np.ndarray, grades: np.ndarray, count: int, penalty: float):
    """``loss(w)``: mean negative log likelihood with its penalty, and its derivatives.

    ``w`` holds ``count`` weights (an id of ``count`` has none), the lower threshold, and the logarithm of the gap to the upper one.
    """
    n = len(grades)
    sizes = np.diff(offsets)
    blocks = [(a, min(a + STEP, n), np.repeat(np.arange(min(STEP, n - a), dtype=np.int16), sizes[a : a + STEP])) for a in range(0, n, STEP)]
    least, most = grades == 0, grades == 2

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        theta = np.array([w[-2], w[-2] + np.exp(min(w[-1], 20.0))])
        weights = np.append(w[:-2], 0.0)
        score = np.zeros(n)
        for a, b, row in blocks:
            score[a:b] = np.bincount(row, weights[ids[offsets[a] : offsets[b]]], b - a)
        upper = np.where(most, 1.0, _sigmoid(theta[np.minimum(grades, 1)] - score))
        lower = np.where(least, 0.0, _sigmoid(theta[np.maximum(grades - 1, 0)] - score))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        t0 = -du[least].sum() + dl[grades == 1].sum()
        t1 = -du[grades == 1].sum() + dl[most].sum()
        flow, slope = du - dl, np.zeros(count + 1)
        for a, b, row in blocks:
            slope += np.bincount(ids[offsets[a] : offsets[b]], flow[a:b][row], count + 1)
        g = np.append(slope[:-1] / n + penalty * w[:-2], [(t0 + t1) / n, t1 * (theta[1] - theta[0]) / n])
        return float(-np.log(p).mean() + 0.5 * penalty * (w[:-2] @ w[:-2])), g

    return loss


def train(ids: np.ndarray, offsets: np.ndarray, grades: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> Model:
    """Maximum likelihood with an L2 penalty, by L-BFGS on all rows, block by block. Features seen in fewer than ``SEEN`` rows stay at 0."""
    n = len(grades)
    often = sum(np.bincount(ids[offsets[a] : offsets[min(a + STEP, n)]], minlength=SPACE) for a in range(0, n, STEP)) >= SEEN
    names = np.flatnonzero(often)
    # one more place, always 0, for the features that are left out
    short = np.where(often, np.cumsum(often) - 1, len(names)).astype(np.int32)
    loss = objective(short[ids], offsets, grades, len(names), penalty)
    share = np.array([(grades <= k).mean() for k in (0, 1)]).clip(1e-3, 1 - 1e-3)
    low = float(np.log(share[0] / (1 - share[0])))
    gap = float(np.log(max(np.log(share[1] / (1 - share[1])) - low, 0.1)))
    w = np.zeros(len(names) + 2)
    w[-2:] = low, gap
    value, g = loss(w)
    memory: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, rho in reversed(memory):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if memory:
            s, y, _rho = memory[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(float(np.linalg.norm(q)), 1e-12)
        for (s, y, rho), a in zip(memory, reversed(alphas), strict=True):
            q += s * (a - rho * (y @ q))
        slope, step = -float(g @ q), 1.0
        while step > 1e-8:
            after, g2 = loss(w - step * q)
            if after <= value + 1e-4 * step * slope:
                break
            step *= 0.5
        else:
            break
        s, y = -step * q, g2 - g
        if s @ y > 1e-12:
            memory = [*memory[-7:], (s, y, 1.0 / float(s @ y))]
        done = value - after < 1e-7
        w, value, g = w + s, after, g2
        if done:
            break
    full = np.zeros(SPACE, np.float32)
    full[names] = w[:-2]
    return Model(full, np.array([w[-2], w[-2] + np.exp(w[-1])]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most ``rows`` rated documents; features are made on the executors, so no text reaches the driver."""
    rated = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (1 + F.col("quality").cast("int") - F.col("toxic").cast("int")).alias("grade"))
        .where("doc_id is not null and grade between 0 and 2")
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
    )
    sample = rated.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, ends = features(binary(batch.column(1)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()), batch.column(2)], names=["doc_id", "ids", "grade"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    got = chosen.select("doc_id", "text", "grade").mapInArrow(run, "doc_id bigint, ids binary, grade int").where("length(ids) > 0").toArrow().sort_by([("doc_id", "ascending"), ("ids", "ascending")])
    # of rows that repeat an id with other texts the one with the least features counts, in whatever order they came
    keys = got.column("doc_id").to_numpy()
    got = got.filter(pa.array(np.append(True, keys[1:] != keys[:-1])[: len(keys)]))
    if not len(got):
        return None
    grades = got.column("grade").to_numpy().astype(np.int64)
    parts = [np.frombuffer(p.as_py(), np.int32) for p in got.column("ids")]
    del got
    return train(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))), grades)


def grade(docs: DataFrame, model: Model | None, select_from: float = SELECT_FROM) -> DataFrame:
    """Expected grade, tail probability and selection for each row of ``docs(doc_id, text)``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text", CHUNK_BYTES):
            ids, ends = features(binary(batch.column(1)).to_pylist())
            none = np.diff(ends) == 0
            if m is None:
                mean = best = pa.nulls(batch.num_rows, pa.float64())
                chosen = ~none
            else:
                score = np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(ends)), m.weights[ids].astype(np.float64), batch.num_rows)
                p = probabilities(score, m.thresholds)
                p[none] = (1.0, 0.0, 0.0)
                chosen = p[:, 2] >= select_from
                mean, best = pa.array(np.round(p[:, 1] + 2 * p[:, 2], 6)), pa.array(np.round(p[:, 2], 6))
            yield pa.RecordBatch.from_arrays([batch.column(0), mean, best, pa.array(chosen)], names=["doc_id", "expected_grade", "p_clean", "selected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return grade(docs, fit(docs, read(spark, sf_dir, "labels")))

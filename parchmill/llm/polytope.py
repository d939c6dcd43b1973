"""Near-duplicate vectors by cross-polytope hashing.

A vector is normalised, padded to a power of two and turned by three rounds of
random signs and a fast Hadamard transform. The turned vector's largest entry
in absolute value, with its sign, is the nearest vertex of the cross-polytope
and its hash. ``width`` hashes in a row name a bucket, in each of ``TABLES``
tables; ``width`` grows with the logarithm of the number of vectors, so that
buckets of unlike vectors stay small. Each vector also visits the ``PROBES``
buckets that cost least to reach by taking a second-best vertex.

In a bucket, every pair counts whose cosine is at least ``THRESHOLD``. Leaders
are taken in order of id; whoever reaches one joins it, and vectors outside
the largest such cluster are compared with all others, so no pair of the bucket
goes unseen while a bucket of n copies gives n edges. A bucket of more than
``BLOCK`` vectors is searched block by block, and then block against block for
what is not connected yet. Groups are the connected components of the verified
pairs, and the least id is kept. Equal vectors are searched once; the others
follow it by two hashes of the vector, each in a row of its own.

Defined cases: vectors that are null, hold nulls or numbers that are not
finite or reach 1e18, or have nothing above 1e-18 belong to no group; vectors of different lengths never
meet; a row without id is left out; of several vectors of one id the least
counts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, components, materialize, mix, read
from .vectors import by_dimension, cosine, matrix, usable

TABLES = 10
PROBES = 4
THRESHOLD = 0.95
#: Entries of turned vectors that one step holds.
_STEP = 1 << 19
#: Vectors of one bucket that one step of a worker compares with each other.
BLOCK = 1 << 14


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.float32(math.sqrt(d))


def turned(x: np.ndarray, seed: int) -> np.ndarray:
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), size), np.float32)
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([10, seed])
    for _ in range(3):
        y = hadamard(y * rng.choice(np.array([-1, 1], np.float32), size))
    return y


def buckets(x: np.ndarray, table: int, width: int, probes: int = PROBES) -> np.ndarray:
    """``(rows, 1 + probes)`` bucket hashes: a vector's own one, then those that its second vertices reach most cheaply."""
    best, second, loss = [], [], []
    rows = np.arange(len(x))
    for k in range(width):
        y = turned(x, table * 64 + k)
        size = np.abs(y)
        a = size.argmax(1)
        top = size[rows, a].copy()
        best.append(2 * a + (y[rows, a] > 0))
        size[rows, a] = -1
        b = size.argmax(1)
        second.append(2 * b + (y[rows, b] > 0))
        loss.append(top - size[rows, b])
    first, other, cost = np.stack(best, 1), np.stack(second, 1), np.stack(loss, 1)
    # sets of hashes to change, cheapest first: every single one and every pair
    moves = [(k,) for k in range(width)] + [(k, j) for k in range(width) for j in range(k)]
    price = np.stack([sum(cost[:, k] for k in m) for m in moves], 1)
    order = np.argsort(price, axis=1, kind="stable")[:, :probes]
    changed = np.zeros((len(moves), width), bool)
    for i, m in enumerate(moves):
        changed[i, list(m)] = True
    flip = np.concatenate([np.zeros((len(x), 1, width), bool), changed[order]], axis=1)
    vertices = np.where(flip, other[:, None], first[:, None]).astype(np.uint64)
    h = np.full(vertices.shape[:2], table + 1000 * x.shape[1], np.uint64)
    for k in range(width):
        h = mix(h * U64(0x9E3779B97F4A7C15) + vertices[:, :, k])
    return h


def bucket_edges(ids: np.ndarray, x: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs of cosine >= threshold connect; rows are sorted by id."""
    n = len(ids)
    if n * n <= _STEP:
        # most buckets hold a few unlike vectors: all pairs at once, unless they are so many that leaders save edges
        i, j = np.nonzero(np.triu(x @ x.T >= np.float32(threshold - 1e-4), 1))
        if len(i) <= 4 * n:
            good = cosine(x[i], x[j]) >= threshold
            return ids[i[good]], ids[j[good]]
    leader = np.full(n, -1)
    u: list[np.ndarray] = []
    v: list[np.ndarray] = []
    near = np.float32(threshold - 1e-4)  # single precision proposes, double decides
    for k in range(n - 1):
        if leader[k] >= 0:
            continue
        leader[k] = k
        rest = k + 1 + np.flatnonzero(leader[k + 1 :] < 0)
        got = rest[x[rest] @ x[k] >= near]
        got = got[cosine(x[got], np.broadcast_to(x[k], (len(got), x.shape[1]))) >= threshold] if len(got) else got
        leader[got] = k
        u.append(np.full(len(got), k))
        v.append(got)
    leader[n - 1] = n - 1 if leader[n - 1] < 0 else leader[n - 1]
    i, j = cross_pairs(x, leader, np.zeros(n, int), threshold)
    a, b = np.concatenate([*u, i]), np.concatenate([*v, j])
    return ids[a], ids[b]


def cross_pairs(x: np.ndarray, label: np.ndarray, side: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of cosine >= threshold across labels, and across sides where there are two."""
    names, nth, counts = np.unique(label, return_inverse=True, return_counts=True)
    near = np.float32(threshold - 1e-4)
    two = bool((side != side[0]).any())
    outside = np.flatnonzero(nth != counts.argmax()) if len(names) > 1 else np.empty(0, int)
    step = max(1, _STEP // len(x))
    found = [(np.empty(0, int), np.empty(0, int))]
    for a in range(0, len(outside), step):
        part = outside[a : a + step]
        i, j = np.nonzero(x[part] @ x.T >= near)
        i = part[i]
        cross = (nth[i] != nth[j]) & (side[i] != side[j]) if two else nth[i] != nth[j]
        i, j = i[cross], j[cross]
        good = cosine(x[i], x[j]) >= threshold
        found.append((i[good], j[good]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _place(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_dimension(whole, "v"):
                x = matrix(batch.column("v"))
                step = max(1, _STEP // max(1, x.shape[1]))
                for a in range(0, len(x), step):
                    part = batch.slice(a, step)
                    for table in range(TABLES):
                        h = buckets(x[a : a + step], table, width)
                        yield pa.RecordBatch.from_arrays([part.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(h.view(np.int64).ravel()), h.shape[1]).cast(pa.list_(pa.int64()))], names=["id", "hs"])

    return run


def _search(across: bool):
    """Arrow worker over buckets, or blocks and pairs of blocks of large ones; rows are sorted by (g, id), and a bucket may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()
            held.clear()
            for batch in by_dimension(rows[0], "v") if rows and rows[0].num_rows > 1 else ():
                if batch.num_rows < 2:
                    continue
                ids, x = batch.column("id").to_numpy(), matrix(batch.column("v"))
                if across:
                    i, j = cross_pairs(x, batch.column("label").to_numpy(), batch.column("side").to_numpy())
                    u, v = ids[i], ids[j]
                else:
                    u, v = bucket_edges(ids, x)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and g[a] != last:
                    yield from close()
                last = g[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    return run


def near_duplicates(table: DataFrame) -> DataFrame:
    """One row per vector that is not the first of its group: ``vec_id, kept_id, similarity``, the cosine of both."""
    rows = materialize(usable(table), "cp-vectors")
    # grouped are hashes and ids only, which combine before the shuffle
    named = rows.select("id", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(10), "v").alias("b"))
    one = named.groupBy("a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    equal = named.join(one.where("copies > 1"), ["a", "b"]).where("id <> rep").select("id", "rep")
    reps = materialize(rows.join(equal.select("id"), "id", "left_anti"), "cp-distinct")
    count = reps.count()
    width = max(2, math.ceil(math.log(max(count, 2)) / math.log(128)))
    placed = reps.mapInArrow(_place(width), "id bigint, hs array<bigint>").select("id", F.explode("hs").alias("h")).distinct()
    placed = materialize(placed, "cp-placed")
    shared = placed.join(placed.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"), "h")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")

    def search(members: DataFrame, across: bool) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), blocks - 1)) if across else own
        sided = members.select("id", "h", "label", own.alias("side"), other.alias("other")).select("id", "label", "side", F.xxhash64("h", F.least("side", "other"), F.greatest("side", "other")).alias("g"))
        met = sided.join(reps, "id").select("g", "id", "label", "side", "v")
        return materialize(met.repartition("g").sortWithinPartitions("g", "id").mapInArrow(_search(across), "u bigint, v bigint").distinct(), "cp-edges")

    edges = search(shared.withColumn("label", F.col("id")), False)
    roots = components(edges, "cp")
    large = shared.where(F.col("size") > BLOCK)
    if not large.isEmpty():
        label = F.coalesce("root", "id")
        labelled = large.join(roots.withColumnRenamed("id", "m"), large["id"] == F.col("m"), "left").select("id", "h", "size", label.alias("label"))
        split = labelled.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
        edges = edges.union(search(labelled.join(split, "h", "left_semi"), True))
        roots = components(edges, "cp")
    alike = roots.where("id <> root").select("id", "root")
    follow = equal.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    out = alike.union(follow).join(rows, "id").withColumnRenamed("v", "own").join(rows.toDF("root", "first"), "root")
    # in double precision and in order of the entries, as SQL has it
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    similarity = F.round(dot("own", "first") / F.sqrt(dot("own", "own") * dot("first", "first")), 6)
    return out.select(F.col("id").alias("vec_id"), F.col("root").alias("kept_id"), similarity.alias("similarity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


#: Exact pairs, then their connected components; equal vectors are folded first, which keeps the recursion small.
ORACLE = f"""
WITH RECURSIVE u AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 1e18)) = 0
    AND len(list_filter(embedding, lambda x: abs(x) > 1e-18)) > 0 GROUP BY vec_id
), f AS (SELECT vec_id, e, min(vec_id) OVER (PARTITION BY e) AS rep FROM u),
r AS (SELECT vec_id, e FROM f WHERE vec_id = rep),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT x, y FROM p UNION SELECT reach.x, p.y FROM reach JOIN p ON p.x = reach.y),
roots AS (SELECT x, least(x, min(y)) AS root FROM reach GROUP BY x),
g AS (SELECT f.vec_id, f.e, coalesce(roots.root, f.rep) AS kept_id FROM f LEFT JOIN roots ON roots.x = f.rep)
SELECT g.vec_id, g.kept_id, round(list_cosine_similarity(g.e, u.e), 6) AS similarity FROM g JOIN u ON u.vec_id = g.kept_id WHERE g.vec_id <> g.kept_id
"""

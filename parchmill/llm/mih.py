"""Nearest neighbours by multi-index hashing of learned binary codes.

Queries are the rows whose id is divisible by ``STEP``; every row is indexed and can be an answer.

Unit vectors are centred, turned to their principal axes and then by a rotation
that iterative quantisation learns; signs give the code. Mean, axes and
rotation come from sums over all vectors. The code is split into m substrings
of about log2(n / ``OCCUPANCY``) bits. Codes within Hamming radius m - 1 agree
in at least one substring (pigeonhole), so the buckets of equal substrings hold
every code within that radius; these are reranked by their floats.

How far out the k nearest can lie is known afterwards. If the k-th cosine
found is c, a nearer vector is at most D = sqrt(2 - 2c) away, before and after
centring; seen from the mean, at the query's projected distance a, it is at
most asin(D / a) off (anywhere, if D >= a). Codes at that angle differ in about
bits * angle / pi bits, give or take. A query is settled once the searched
radius exceeds that by ``MARGIN`` standard deviations. Wider radii reach most
buckets of every substring, so the remaining queries are compared with all
vectors exactly. Nothing is capped.

Vectors are written once, to files of the shared folder. A task holds the
tables of a block of queries, reads the files of its slice through and keeps
each query's k best, so vectors are neither shuffled nor paired on disk, and
what tasks return is k rows a query and slice. There are as many slices as
keep the cores busy, or as long tables need. Of more than k + 1 equal vectors
those of the k + 1 least ids are indexed, as no query can list another; the
others are still queries.

Defined cases: vectors that are null, hold nulls or numbers that are not
finite or reach 1e18, or have nothing above 1e-18 are neither query nor answer; a row without id is left
out; of several vectors of one id the least counts; vectors of different
lengths are searched among their like; with fewer than k others a query has
fewer neighbours; equal cosines (6 digits) are ordered by id; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder
from .common import materialize, ragged, read
from .vectors import matrix, plain, unit, usable

NEIGHBOURS = 10
#: Rows whose id is divisible by this are queries.
STEP = 50
MAX_BITS = 64
ROUNDS = 8
OCCUPANCY = 48
MARGIN = 1.7
#: Queries that a task holds when it looks into buckets, and when it compares with all vectors.
BUCKET_BLOCK, SCAN_BLOCK = 65_536, 4096
#: Vectors of a file, files that a task reads at most, and tasks that a pass should have at least.
FILE_ROWS, SLICE_FILES, TASKS = 65_536, 256, 48
#: Pairs that a task looks at in one step, of those in a bucket and of all (these stay in the cache).
PAIRS, TILE = 1 << 20, 1 << 19
#: By how much a cosine in single precision may fall short of what decides, rounding to 6 digits included.
SLACK = 4e-6
SCHEMA = "vec_id bigint, neighbor_id bigint, similarity double"


class Coder(NamedTuple):
    mean: np.ndarray
    turn: np.ndarray  # (d, bits)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.turn

    def code(self, x: np.ndarray) -> np.ndarray:
        bits = self.project(x) > 0
        return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)


def _total(df: DataFrame, part, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``part(matrix)`` over all rows: one array per task, then one per group of tasks, then on the driver."""

    def blob(a: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], names=["x"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(batch.column("v")))
        yield blob(total)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in batch.column("x").to_pylist():
                total += np.frombuffer(x).reshape(shape)
        yield blob(total)

    sums = df.select("v").mapInArrow(first, "x binary").repartition(8).mapInArrow(second, "x binary").collect()
    return np.sum([np.frombuffer(r["x"]).reshape(shape) for r in sums], axis=0)


def learn(vectors: DataFrame, d: int, count: int) -> Coder:
    """Mean and Gram matrix of all vectors, then iterative quantisation over all of them."""

    def moments(x: np.ndarray) -> np.ndarray:
        one = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        return one.T @ one

    m = _total(vectors, moments, (d + 1, d + 1))
    mean = m[0, 1:] / count
    spread, axes = np.linalg.eigh(m[1:, 1:] / count - np.outer(mean, mean))
    bits = min(d, MAX_BITS)
    axes = axes[:, np.argsort(-spread, kind="stable")[:bits]]
    rotation = np.linalg.qr(np.random.default_rng(3).normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        turn = axes @ rotation

        def agreement(x: np.ndarray, turn: np.ndarray = turn) -> np.ndarray:
            y = (x - mean) @ axes
            return np.where((x - mean) @ turn > 0, 1.0, -1.0).T @ y

        left, _, right = np.linalg.svd(_total(vectors, agreement, (bits, bits)))
        rotation = (left @ right).T
    return Coder(mean.astype(np.float32), (axes @ rotation).astype(np.float32))


def pieces(bits: int, count: int) -> list[tuple[int, int]]:
    """First bit and length of each substring."""
    size = min(bits, max(4, round(math.log2(max(count / OCCUPANCY, 2)))))
    m = max(1, bits // size)
    edges = [bits * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _cosines(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows i of q and j of c in double precision, to 6 digits."""
    out = np.empty(len(i))
    for a in range(0, len(i), 1 << 15):
        x, y = q[i[a : a + (1 << 15)]].astype(np.float64), c[j[a : a + (1 << 15)]].astype(np.float64)
        out[a : a + (1 << 15)] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
    return np.round(out, 6)


class _Best:
    """The k best answers of each query of a block so far, equal cosines by id; -2 marks a free place."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.v, self.k, self.x = ids, v, k, unit(v)
        self.cosine, self.answer = np.full((len(ids), k), -2.0), np.zeros((len(ids), k), np.int64)

    def least(self) -> np.ndarray:
        """What a cosine in single precision has to reach."""
        return (self.cosine[:, -1] - SLACK).astype(np.float32)

    def add(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Rows j of ``v`` as answers to queries i. Double precision decides."""
        other = self.ids[i] != ids[j]
        i, j = i[other], j[other]
        cosine = _cosines(self.v, v, i, j)
        good = cosine >= self.cosine[i, -1]
        i, answer, cosine = i[good], ids[j[good]], cosine[good]
        if not len(i):
            return
        old = np.unique(i)
        i = np.concatenate([np.repeat(old, self.k), i])
        answer = np.concatenate([self.answer[old].ravel(), answer])
        cosine = np.concatenate([self.cosine[old].ravel(), cosine])
        order = np.lexsort((answer, -cosine, i))
        i, answer, cosine = i[order], answer[order], cosine[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < self.k
        self.cosine[i[top], place[top]], self.answer[i[top], place[top]] = cosine[top], answer[top]

    def rows(self) -> pa.RecordBatch:
        i, place = np.nonzero(self.cosine > -2)
        columns = [self.ids[i], self.answer[i, place], self.cosine[i, place]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["vec_id", "neighbor_id", "similarity"])


def _stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder, in files of ``FILE_ROWS`` rows at most."""
    path = scratch_folder(df.sparkSession, tag)
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _vectors(files: list[str], d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of length d in these files, step by step."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow import fs

    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(min(16_384, max(256, (1 << 21) // d)), columns=["id", "v"]):
                batch = batch.filter(pc.equal(pc.list_value_length(batch.column("v")), d))
                if batch.num_rows:
                    yield batch.column("id").to_numpy(), plain(batch.column("v"))


def _keys(codes: np.ndarray, piece: tuple[int, int]) -> np.ndarray:
    return (codes >> np.uint64(piece[0])) & np.uint64((1 << piece[1]) - 1)


def _bucket_pairs(q_codes: np.ndarray, buckets: list[tuple[np.ndarray, np.ndarray]], codes: np.ndarray, cut: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries i and rows j that share a bucket and lie inside the radius, each pair once. buckets: for each piece the queries by key, and the keys."""
    first = [np.searchsorted(keys, _keys(codes, piece)) for (_, keys), piece in zip(buckets, cut, strict=True)]
    count = [np.searchsorted(keys, _keys(codes, piece), "right") - x for (_, keys), piece, x in zip(buckets, cut, first, strict=True)]
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sum(count)) // PAIRS)) + 1).tolist(), len(codes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        pairs = []
        for (order, _), x, n in zip(buckets, first, count, strict=True):
            i, j = order[ragged(x[a:b], n[a:b])], np.repeat(np.arange(a, b), n[a:b])
            near = np.bitwise_count(q_codes[i] ^ codes[j]) < len(cut)
            pairs.append(i[near] * len(codes) + j[near])
        yield np.divmod(np.unique(np.concatenate(pairs)), len(codes))


def _probe(coder: Coder, cut: list[tuple[int, int]]):
    """A block of queries against the vectors in its buckets."""

    def run(best: _Best, batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        q_codes = coder.code(best.x)
        orders = [np.argsort(_keys(q_codes, piece), kind="stable") for piece in cut]
        buckets = [(order, _keys(q_codes, piece)[order]) for order, piece in zip(orders, cut, strict=True)]
        for ids, v in batches:
            x = unit(v)
            for i, j in _bucket_pairs(q_codes, buckets, coder.code(x), cut):
                for a in range(0, len(i), 1 << 15):
                    p, r = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
                    good = np.einsum("ij,ij->i", best.x[p], x[r]) >= best.least()[p]
                    best.add(p[good], r[good], ids, v)

    return run


def _scan(best: _Best, batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
    """A block of queries against all vectors."""
    rows = max(best.k + 2, TILE // len(best.ids))
    room = np.empty(len(best.ids) * rows, np.float32)
    for ids, v in batches:
        x = unit(v)
        for a in range(0, len(ids), rows):
            part = x[a : a + rows]
            scores = np.matmul(best.x, part.T, out=room[: len(best.ids) * len(part)].reshape(-1, len(part)))
            least = best.least()
            if len(part) > best.k + 1 and (least < -1.5).any():  # one more, as the query itself may be among them
                least = np.maximum(least, np.partition(scores, -best.k - 1, axis=1)[:, -best.k - 1] - np.float32(SLACK))
            i, j = np.divmod(np.flatnonzero(scores >= least[:, None]), len(part))
            best.add(i, j + a, ids, v)


def _pass(queries: DataFrame, files: list[str], d: int, k: int, compare) -> DataFrame:
    """``compare`` for every file of queries and every slice of the files of vectors, each a task."""
    blocks = queries.inputFiles()
    spark = queries.sparkSession
    tasks = max(TASKS, 2 * spark.sparkContext.defaultParallelism)
    slices = min(len(files), max(-(-tasks // len(blocks)), -(-len(files) // SLICE_FILES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("id").to_pylist():
                block, part = divmod(t, slices)
                held = list(_vectors([blocks[block]], d))
                if held:
                    best = _Best(np.concatenate([ids for ids, _ in held]), np.concatenate([v for _, v in held]), k)
                    compare(best, _vectors(files[part::slices], d))
                    yield best.rows()

    count = len(blocks) * slices
    return spark.range(0, count, 1, count).mapInArrow(run, SCHEMA)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(vectors: DataFrame, files: list[str], queries: DataFrame, d: int, count: int, asked: int, k: int) -> DataFrame:
    coder = learn(vectors, d, count)
    bits = min(d, MAX_BITS)
    cut = pieces(bits, count)

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                off = np.linalg.norm(coder.project(matrix(batch.column("v"))).astype(np.float64), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(off)], names=["id", "off"])

    queries = materialize(queries.repartition(-(-asked // BUCKET_BLOCK), "id"), "mih-queries")
    near = materialize(_ranked(_pass(queries, files, d, k, _probe(coder, cut)), k), "mih-near")

    kth = near.groupBy(F.col("vec_id").alias("id")).agg(F.count("*").alias("n"), F.min("similarity").alias("last")).where(F.col("n") >= k)
    away = F.sqrt(F.greatest(2 - 2 * F.col("last"), F.lit(0.0)))
    p = F.when(away < F.col("off"), F.asin(away / F.col("off")) / math.pi).otherwise(1.0)
    reach = bits * p + MARGIN * F.sqrt(bits * p * (1 - p))
    settled = kth.join(queries.mapInArrow(distance, "id bigint, off double"), "id").where(reach <= len(cut) - 1).select("id")
    settled = materialize(settled, "mih-settled")
    left = asked - settled.count()
    done = near.join(settled.withColumnRenamed("id", "vec_id"), "vec_id", "left_semi").select("vec_id", "neighbor_id", "rank", "similarity")
    if not left:
        return done
    open_ = materialize(queries.join(settled, "id", "left_anti").repartition(-(-left // SCAN_BLOCK), "id"), "mih-open")
    far = _ranked(_pass(open_, files, d, k, _scan), k)
    return done.union(far.select("vec_id", "neighbor_id", "rank", "similarity"))


def neighbours(table: DataFrame, k: int = NEIGHBOURS, step: int = 1) -> DataFrame:
    """``vec_id, neighbor_id, rank, similarity``: the k nearest others by cosine of every vector whose id is divisible by ``step``."""
    every = _stored(usable(table), "mih-vectors")
    named = every.select("id", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(3), "v").alias("b"))
    nth = F.row_number().over(W.partitionBy("a", "b").orderBy("id"))
    last = materialize(named.withColumn("nth", nth).where(F.col("nth") == k + 1).select("a", "b", F.col("id").alias("last")), "mih-equal")
    vectors = every
    if not last.isEmpty():
        beyond = materialize(named.join(last, ["a", "b"]).where(F.col("id") > F.col("last")).select("id"), "mih-beyond")
        vectors = _stored(every.join(beyond, "id", "left_anti"), "mih-distinct")
    ask = F.col("id") % step == 0
    asked = {r["d"]: r["n"] for r in every.where(ask).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    sizes = sorted((r["d"], r["n"]) for r in vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect() if r["d"] in asked)
    files = sorted(vectors.inputFiles())
    parts = [_search(vectors.where(F.size("v") == d), files, every.where((F.size("v") == d) & ask), d, n, asked[d], k) for d, n in sizes]
    empty = table.sparkSession.createDataFrame([], "vec_id bigint, neighbor_id bigint, rank int, similarity double")
    return reduce(DataFrame.union, parts) if parts else empty


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "embeddings"), step=STEP)


def oracle(step: int) -> str:
    """Exact search; on the small tables the operator finds the same."""
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {step} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbor_id)::INT AS rank FROM p)
SELECT vec_id, neighbor_id, rank, similarity FROM r WHERE rank <= {NEIGHBOURS}
"""


ORACLE = oracle(STEP)

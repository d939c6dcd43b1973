"""Mixing sources to target weights by balanced sampling with the cube method.

Target: source s should hold a share of all tokens in proportion to (its
tokens) ** ``TEMPER``. Every document of a source has the same inclusion
probability, and the scale is the largest at which none exceeds 1, so the
source that is scarcest against its target is kept whole. Where that would keep
less than ``KEEP`` of all tokens, as one tiny source would have it, the scale is
the one that keeps so many: sources scarcer than it asks for are kept whole and
fall short of their target by the rest, the others hold theirs.

The flight moves the probabilities of p + 1 documents at a time through the
null space of their p balancing equations (documents and tokens of the source)
until one of them is 0 or 1. It runs side by side in groups of documents of
one source, each balanced exactly; what stays fractional, at most p documents
a group, flies again in fewer groups, round by round, until at most p
documents of each source are left. These fly on across sources, which keeps
the totals of documents and tokens, until at most p are left in all. They land
by giving up one equation at a time: first tokens, so that two of them trade
against each other, then documents, so that the last one is drawn by its
probability. Every move keeps all expectations, so each document is drawn with
exactly its source's rate, and the rounds end after about log(documents) of
them whatever the number and sizes of sources.

Tokens are counted as words. Defined cases: a null source is a source of its
own; a null or empty text has no tokens and counts as a document; a source
without tokens is kept whole; the choice depends on ids and the seed alone, not on partitioning; repeated
rows are sampled as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns, fresh, materialize, mix, read

TEMPER = 0.7
#: Share of all tokens that is kept at least, though scarce sources fall short of their targets then.
KEEP = 0.3
SEED = 6
#: Documents of one flight group: bounds a worker's memory and time, not the result's balance; 3 at least.
GROUP = 20_000
EPS = 1e-9


def flight(x: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves inclusion probabilities until at most 2 are fractional; keeps sum(x) and sum(x * tokens) as they are.

    The null vector of three units' equations (1, 1, 1) and (t1, t2, t3) is
    (t2 - t3, t3 - t1, t1 - t2); two units with equal tokens already allow
    the move (1, -1).
    """
    x = x.tolist()
    t = tokens.tolist()
    draws = iter(rng.random(2 * len(x) + 8).tolist())
    live: list[int] = []
    for k in range(len(x)):
        if not EPS < x[k] < 1 - EPS:
            continue
        live.append(k)
        while len(live) > 1:
            if len(live) == 2:
                a, b = live
                if t[a] != t[b]:
                    break
                units, move = (a, b), (1.0, -1.0)
            else:
                a, b, c = live
                units, move = (a, b, c), (t[b] - t[c], t[c] - t[a], t[a] - t[b])
                if not any(move):
                    move = (1.0, -1.0, 0.0)
            up = min((1 - x[u]) / v if v > 0 else x[u] / -v for u, v in zip(units, move, strict=True) if v)
            down = min(x[u] / v if v > 0 else (1 - x[u]) / -v for u, v in zip(units, move, strict=True) if v)
            by = up if next(draws) * (up + down) < down else -down
            for u, v in zip(units, move, strict=True):
                x[u] += by * v
            live = [u for u in live if EPS < x[u] < 1 - EPS]
    return np.array(x)


def land(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settles what a flight leaves: a flight without the equation of tokens leaves at most one unit, which is drawn."""
    x = flight(x, np.zeros(len(x)), rng)
    open_ = np.flatnonzero((x > EPS) & (x < 1 - EPS))
    x[open_] = rng.random(len(open_)) < x[open_]
    return np.round(x)


def scale(sources: DataFrame, temper: float = TEMPER) -> float:
    """What ``tokens ** temper`` is multiplied by, from rows (source, n, t); 0 where no source has tokens.

    The tokens kept grow with the scale along a concave line of straight
    pieces, so steps along the tangent reach the budget from below, in a few
    small aggregates. Sums are of exact numbers, so their order changes nothing.
    """
    held = sources.where("t > 0").select("t", F.pow(F.col("t").cast("double"), F.lit(temper)).cast("decimal(28,6)").alias("w"), F.pow(F.col("t").cast("double"), F.lit(1 - temper)).alias("full"))
    least, total = held.agg(F.min("full"), F.sum("t")).first()
    if least is None:
        return 0.0
    while True:
        whole, open_ = held.agg(F.sum(F.when(F.col("full") <= least, F.col("t")).otherwise(0)), F.sum(F.when(F.col("full") > least, F.col("w")))).first()
        if not open_ or whole + least * float(open_) >= KEEP * total * (1 - 1e-12):
            return least
        after = (KEEP * total - whole) / float(open_)
        if after <= least:
            return least
        least = after


def _rng(seed: int, key: int) -> np.random.Generator:
    return np.random.default_rng([seed, key])


def _fly(seed: int, last: bool):
    """Arrow worker: groups arrive in order of g; a group's rows may span batches."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        g, x, t, k = (rows.column(c).to_numpy() for c in ("g", "x", "t", "k"))
        rng = _rng(seed, int(mix(g[:1].astype(np.uint64) ^ k[:1].view(np.uint64))[0] >> np.uint64(1)))
        x = flight(x, t.astype(np.float64), rng)
        return land(x, rng) if last else np.where(x < EPS, 0.0, np.where(x > 1 - EPS, 1.0, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def close():
            rows = pa.Table.from_batches(held)
            done = rows.set_column(rows.schema.get_field_index("x"), "x", pa.array(work(rows))).combine_chunks().to_batches()
            held.clear()
            return done

        for batch in batches:
            g = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and g[a] != at:
                    yield from close()
                at = g[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    return run


def row_key() -> Column:
    """A hash of doc_id, source and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def sample(docs: DataFrame, temper: float = TEMPER, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """``(doc_id, source, n_tokens, rate, k)`` of the documents drawn from ``docs(doc_id, text, source)``.

    Only ids, sources and token counts are shuffled, never texts. ``k`` is
    :func:`row_key`.
    """
    text = F.col("text").cast("string")
    units = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.size(F.filter(F.split(text, r"[ \t\r\n\x0B\f]+"), lambda w: w != "")), F.lit(0)).cast("long").alias("t"),
            row_key().alias("k"),
        ),
        "mix-units",
    )
    sources = materialize(units.groupBy("source").agg(F.count("*").alias("n"), F.sum("t").alias("total")), "mix-sources")
    by = scale(sources.withColumnRenamed("total", "t"), temper)
    # the list of sources stays a table, at any length
    rate = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.lit(by) * F.pow(F.col("total").cast("double"), F.lit(temper - 1)))).otherwise(1.0)
    plan = sources.select(F.col("source").alias("of"), rate.alias("rate"), F.ceil(F.col("n") / group).alias("groups"), F.xxhash64("source", F.col("source").isNull()).alias("nth"))
    first = (
        units.join(plan, F.col("source").eqNullSafe(F.col("of")))
        .select("doc_id", "source", "t", "k", "rate", F.col("rate").alias("x"), "nth", F.xxhash64("k", F.lit(seed)).alias("r"), "groups")
        .withColumn("g", F.xxhash64("nth", F.pmod(F.col("r"), F.col("groups"))))
        .drop("groups")
    )
    schema = "doc_id bigint, source string, t bigint, k bigint, rate double, x double, nth bigint, r bigint, g bigint"

    def fly(df: DataFrame, last: bool, turn: int) -> DataFrame:
        # long documents first, so that what is left to the landing is short
        ordered = df.repartition("g").sortWithinPartitions("g", F.desc("t"), "r", "doc_id")
        return ordered.select(*[c.split()[0] for c in schema.split(", ")]).mapInArrow(_fly(seed + 1000 * turn, last), schema)

    open_ = (F.col("x") > 0) & (F.col("x") < 1)
    rounds = [materialize(fly(first, False, 0), "mix-flight")]

    def again(key: Column, count: Column, tag: int, last: bool) -> None:
        """What the last round left, in new groups of one source or of all."""
        counted = rounds[-1].where(open_).withColumn("n", count)
        part = F.pmod(F.xxhash64("r", F.lit(len(rounds))), F.ceil(F.col("n") / group))
        rounds.append(materialize(fly(counted.withColumn("g", F.xxhash64(key, part, F.lit(tag))), last, len(rounds)), "mix-flight"))

    most = sources.agg(F.max("n")).first()[0] or 0
    while most > group:
        most = rounds[-1].where(open_).groupBy("nth").count().agg(F.max("count")).first()[0] or 0
        again(F.col("nth"), F.count("*").over(W.partitionBy("nth")), 1, False)
    left = 2 * group
    while left > group:
        left = rounds[-1].where(open_).count()
        again(F.lit(0), F.lit(left), 2, left <= group)
    return reduce(DataFrame.union, [r.where("x = 1") for r in rounds]).select("doc_id", "source", F.col("t").alias("n_tokens"), F.round("rate", 9).alias("rate"), "k")


def drawn(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`sample` draws; of equal rows as many as were drawn."""
    key, count, place = fresh(docs, "k", "n", "nth")
    wanted = sample(docs).groupBy(F.col("k").alias(key)).agg(F.count("*").alias(count))
    keyed = docs.withColumn(key, row_key()).join(wanted, key)
    nth = F.row_number().over(W.partitionBy(key).orderBy(key))
    return keyed.withColumn(place, nth).where(F.col(place) <= F.col(count)).select(*columns(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(read(spark, sf_dir, "documents")).drop("k")

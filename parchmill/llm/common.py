"""What the operators share: cut lineage, walk Arrow batches, hash words.

Conventions of every operator here:

* a null or empty text is a document without content, never an error;
* only the named columns of a table are read, so extra columns may have any
  name; what passes extra columns on takes its inner names from :func:`fresh`;
* cut lineage goes through :func:`materialize`, a Parquet table in the folder
  that ``spark.checkpoint.dir`` names, which outlives a lost executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder

#: Bytes of text that one step of a Python worker holds as Python objects.
CHUNK_BYTES = 3_000_000
#: Distinct words that a worker remembers before it starts afresh.
MEMO_WORDS = 400_000

U64 = np.uint64


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it nor depend on executors."""
    spark = df.sparkSession
    path = scratch_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__pm_{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def columns(df: DataFrame) -> list[str]:
    """All columns, quoted for ``select``."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Memo(dict):
    """``memo[word]`` computes ``make(word)`` once."""

    def __init__(self, make: Callable[[bytes], object]):
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes) -> object:
        value = self[word] = self.make(word)
        return value

    def trim(self, limit: int = MEMO_WORDS) -> None:
        if len(self) > limit:
            self.clear()


_kept: dict[object, object] = {}


def worker_kept(key: object, make: Callable[[], object]) -> object:
    """``make()`` once for each Python worker and key: what is remembered serves the worker's later tasks too.

    A worker keeps one thing at a time, as the stages of a job share workers.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def binary(column: pa.Array) -> pa.Array:
    """The UTF-8 bytes of a string column, without a copy."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``limit`` bytes in each (one long value may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        size = np.nan_to_num(np.asarray(binary_length(values), dtype=np.float64))
        # a cut before each row whose running size enters another multiple of the limit
        step = np.floor((np.cumsum(size) - 1) / limit)
        cuts = [0, *(np.flatnonzero(np.diff(step) > 0) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def binary_length(values: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)


def words_of(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray]:
    """Words (runs of non-blank bytes; ASCII white space separates) and the offsets of each text's words."""
    parts = [t.split() if t else [] for t in texts]
    return parts, np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))


def look_up(parts: list[list[bytes]], memo: Memo, count: int, dtype: type = np.uint64) -> np.ndarray:
    get = memo.__getitem__
    return np.fromiter(chain.from_iterable(map(get, p) for p in parts), dtype, count)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i]+lengths[i]-1`` of every i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of ``edges(u, v)``: rows ``(id, root)``, the root being the component's least id.

    Every round takes the least label among neighbours and then the label of
    that label, so a chain of n links needs about log n rounds. Both tables of
    a round are written out, so a lost executor costs one round at most.
    """
    both = materialize(
        edges.where(F.col("u") != F.col("v")).select("u", "v").union(edges.where(F.col("u") != F.col("v")).select("v", "u")).toDF("u", "v").distinct(), f"{tag}-edges"
    )
    labels = materialize(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("id")).alias("root")), f"{tag}-labels")
    while True:
        near = both.join(labels.toDF("v", "near"), "v").groupBy(F.col("u").alias("id")).agg(F.min("near").alias("near"))
        hooked = labels.join(near, "id").select("id", "root", F.least("root", "near").alias("next"))
        # what a root hooks to, its members follow
        follow = hooked.groupBy("root").agg(F.min("next").alias("far")).withColumnRenamed("root", "r")
        step = hooked.join(follow, hooked["root"] == follow["r"], "left").select("id", "root", F.least("next", "far").alias("step"))
        after = materialize(step.select("id", F.col("step").alias("root"), (F.col("step") != F.col("root")).alias("moved")), f"{tag}-labels")
        labels = after.select("id", "root")
        if after.where("moved").isEmpty():
            return labels

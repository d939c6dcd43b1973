"""Exact substring dedup: every run of ``RUN`` words that occurred before is removed.

"Before" is the order of (doc_id, place). The work is split by content so that
equal runs meet: a run's minimizer is the least hash among its ``SEED``-word
pieces (the first of equal ones), and its key is that together with the piece
right before it, or after it where the run holds none before. Consecutive runs
with one key form one stretch of text. A repeated run has a repeated key, so
stretches whose key is unique cannot hold one and go no further. Equal
stretches are ranked by hash; all but the first are covered whole. The distinct
stretches of each key then enter :class:`SuffixOrder`, column by column through
files of the shared folder, and wherever the common prefix of neighbours
reaches ``RUN`` words, all but the first occurrence are covered. Stretches, of
at most 92 words, are the strings of the collection, as a round passes over
the whole transform: whole documents would need as many rounds as the longest
has words.

Words are runs of non-blank bytes, compared as they are, through hashes (64
bits to find, 32 bits a word in the suffix order, of which ``RUN`` must agree).

Defined cases: null and empty texts and texts of fewer than ``RUN`` words stay
as they are, as does every text from which nothing is removed; what is left of
another is its remaining words, one blank between words of a line, lines
without words dropped; a text may end up empty; a run that overlaps its own
earlier occurrence counts as repeated; rows that repeat both doc_id and text
count as one document; a null doc_id comes before all others; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch_folder
from .common import U64, Memo, binary, look_up, materialize, mix, ragged, read, slices, word_hash, words_of, worker_kept
from .spans import keyed
from .suffix import SuffixOrder

RUN = 50
SEED = 8
#: Symbols that one suffix order takes before the next key starts another.
COLLECTION = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    memo = worker_kept("suffix-words", lambda: Memo(word_hash))
    memo.trim()
    parts, offsets = words_of(texts)
    return look_up(parts, memo, int(offsets[-1])), offsets


def stretches(values: np.ndarray, offsets: np.ndarray, run: int = RUN, seed: int = SEED) -> dict[str, np.ndarray]:
    """Stretches of all texts: row, first word ``s``, number ``c`` of runs, key ``m``, hash ``h`` of the words,
    and ``again``: whether the minimizer stands more than once in the stretch."""
    none = {"row": np.empty(0, np.int64), "s": np.empty(0, np.int64), "c": np.empty(0, np.int64), "m": np.empty(0, np.uint64), "h": np.empty(0, np.uint64), "again": np.empty(0, bool)}
    n, width = len(values), run - seed + 1
    assert run >= 3 * seed, "a run must hold a piece before or after its minimizer"
    at = ragged(offsets[:-1], np.maximum(np.diff(offsets) - run + 1, 0))
    if not len(at):
        return none
    with np.errstate(over="ignore"):
        mixed = mix(values)
        pieces = np.zeros(n, np.uint64)
        for j in range(seed):
            pieces[: n - j] += mixed[j:] * U64(pow(_BASE, j + 1, 1 << 64))
        pieces = mix(pieces)
        least, place, span = pieces.copy(), np.arange(n), 1
        while span < width:
            step = min(span, width - span)
            later = least[step:] < least[:-step]
            place[:-step] = np.where(later, place[step:], place[:-step])
            least[:-step] = np.where(later, least[step:], least[:-step])
            span += step
        pivot = place[at]
        beside = pieces[np.where(pivot - at >= seed, pivot - seed, pivot + seed)]
        m = mix(least[at] + beside * U64(_BASE))
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (m[1:] != m[:-1])))
        # runs of one minimizer without end (one word over and over) are cut at a fixed length
        head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        new |= (np.arange(len(at)) - head) % width == 0
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        start = at[first]
        up = np.cumprod(np.full(n, _BASE, np.uint64))
        down = np.cumprod(np.full(n, _BACK, np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * up, dtype=np.uint64)))
        size = count - 1 + run
        h = mix((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64))
        inside = count - 1 + width
        seen = pieces[ragged(start, inside)] == np.repeat(least[start], inside)
        again = np.add.reduceat(seen.astype(np.int64), np.cumsum(inside) - inside) > 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return {"row": row, "s": start - offsets[row], "c": count, "m": m[first], "h": h, "again": again}


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x = stretches(*hashed_words(binary(batch.column("text")).to_pylist()))
        take = pa.array(x["row"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("d").take(take), batch.column("k").take(take), pa.array(x["s"].astype(np.int32)), pa.array(x["c"].astype(np.int32)), pa.array(x["m"].view(np.int64)), pa.array(x["h"].view(np.int64)), pa.array(x["again"])],
            names=["d", "k", "s", "c", "m", "h", "again"],
        )


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, k, text, list of stretches) to one row per stretch with its 32-bit symbols."""
    for batch in slices(batches, "text"):
        values, offsets = hashed_words(binary(batch.column("text")).to_pylist())
        short = (values >> U64(32)).astype(np.uint32).view(np.int32)
        lists = batch.column("x")
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        s, c, m = (flat.field(k).to_numpy() for k in ("s", "c", "m"))
        a = offsets[row] + s
        symbols = [short[x:y].tobytes() for x, y in zip(a, a + c - 1 + RUN, strict=True)]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(m), batch.column("d").take(take), batch.column("k").take(take), pa.array(s), pa.array(c), pa.array(symbols, pa.binary())], names=["m", "d", "k", "s", "c", "w"])


def _covered(folder: str):
    """Arrow worker over stretches sorted by key and place: the runs that the suffix order shows to be repeats."""

    def repeats(built: SuffixOrder, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        who = built.build().repeats(RUN)
        owner = pa.Table.from_batches(rows)
        # neighbouring runs of a stretch become one interval
        new = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1] + 1))) if len(who) else np.empty(0, np.int64)
        size = np.diff(np.append(new, len(who)))
        row = pa.array(who[new] >> np.int64(8))
        a = owner.column("s").to_numpy()[who[new] >> np.int64(8)] + (who[new] & np.int64(255))
        return pa.RecordBatch.from_arrays([_one(owner.column("d").take(row)), _one(owner.column("k").take(row)), pa.array(a.astype(np.int32)), pa.array((a + size - 1 + RUN).astype(np.int32))], names=["d", "k", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: SuffixOrder | None = None
        rows: list[pa.RecordBatch] = []
        size, last = 0, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = batch.column("m").to_numpy()
                cuts = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)]
                lengths = batch.column("c").to_numpy() - 1 + RUN
                weight = np.concatenate(([0], np.cumsum(lengths)))
                begin = 0

                def take(a: int, b: int) -> None:
                    nonlocal built, size
                    if a < b:
                        built = built or SuffixOrder(folder)
                        built.add(np.frombuffer(b"".join(batch.column("w").slice(a, b - a).to_pylist()), np.int32), lengths[a:b])
                        rows.append(batch.select(["d", "k", "s"]).slice(a, b - a))
                        size += int(weight[b] - weight[a])

                for a, b in zip(cuts, cuts[1:], strict=False):
                    if m[a] != last and size + weight[a] - weight[begin] >= COLLECTION:
                        take(begin, a)
                        yield repeats(built, rows)
                        built.close()
                        built, rows, size, begin = None, [], 0, a
                    last = m[b - 1]
                take(begin, len(m))
            if built:
                yield repeats(built, rows)
        finally:
            if built:
                built.close()

    return run


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``d, k, s, e``: word intervals of each text that repeat earlier ones.

    Shuffled are 41 bytes a stretch, the texts of documents that hold a
    repeated key, and 4 bytes a word of the distinct stretches among them.
    """
    base = keyed(docs)
    found = base.mapInArrow(_stretches, "d bigint, k bigint, s int, c int, m bigint, h bigint, again boolean")
    kind, by_content = W.partitionBy("m"), W.partitionBy("m", "h").orderBy("d", "k", "s")
    ranked = found.withColumn("size", F.count("*").over(kind)).where("size > 1 or again").withColumn("nth", F.dense_rank().over(by_content))
    ranked = materialize(ranked.select("d", "k", "s", "c", "m", "nth").distinct(), "sa-stretches")
    copies = ranked.where("nth > 1").select("d", "k", "s", (F.col("s") + F.col("c") - 1 + RUN).alias("e"))
    first = ranked.where("nth = 1").groupBy("d", "k").agg(F.collect_list(F.struct("s", "c", "m")).alias("x"))
    # no filter on the texts here: their exchange is then the one of the last join, and is shuffled once for both
    texts = base.join(first, base["d"].eqNullSafe(first["d"]) & base["k"].eqNullSafe(first["k"])).select(base["d"], base["k"], "text", "x").dropDuplicates(["d", "k"])
    contents = texts.select("d", "k", "text", "x").mapInArrow(_contents, "m bigint, d bigint, k bigint, s int, c int, w binary")
    # ascending, a null id first, as everywhere: of equal runs the least place is the first
    folder = scratch_folder(docs.sparkSession, "suffix")
    ordered = contents.repartition("m").sortWithinPartitions("m", "d", "k", "s").mapInArrow(_covered(folder), "d bigint, k bigint, s int, e int")
    return copies.union(ordered)


def without(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the words that ``runs`` cover, and their number."""
    lines = [line.split() for line in text.split(b"\n")]
    n = sum(map(len, lines))
    gone = np.zeros(n + 1, np.int64)
    for a, b in runs:
        gone[min(a, n)] += 1
        gone[min(b, n)] -= 1
    drop = (np.cumsum(gone[:-1]) > 0).tolist()
    out, at = [], 0
    for words in lines:
        kept = [w for w, x in zip(words, drop[at : at + len(words)], strict=True) if not x]
        at += len(words)
        if kept:
            out.append(b" ".join(kept))
    return b"\n".join(out), sum(drop)


_CLEANED = T.StructType([T.StructField("text", T.StringType()), T.StructField("gone", T.IntegerType())])


def _cleaned(text: Column, runs: Column) -> Column:
    @F.arrow_udf(_CLEANED)
    def run(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out: list[dict | None] = []
        for t, r in zip(texts.to_pylist(), runs.to_pylist(), strict=True):
            if t is None or r is None:
                out.append(None)
                continue
            left, gone = without(t.encode(), [(x["s"], x["e"]) for x in r])
            out.append({"text": left.decode(), "gone": gone})
        return pa.array(out, pa.struct([("text", pa.string()), ("gone", pa.int32())]))

    return run(F.when(runs.isNotNull(), text), runs)


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_removed, text`` of every document after the words of repeated runs are taken out."""
    runs = repeated_runs(docs).groupBy("d", "k").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    base = keyed(docs)
    joined = base.join(runs, base["d"].eqNullSafe(runs["d"]) & base["k"].eqNullSafe(runs["k"]), "left").select(base["d"], base["text"], "runs")
    done = joined.withColumn("z", _cleaned(F.col("text"), F.col("runs")))
    return done.select(F.col("d").alias("doc_id"), F.coalesce("z.gone", F.lit(0)).alias("n_removed"), F.coalesce("z.text", "text").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, ln, list_filter(string_split_regex(line, '[ \t\r\x0B\f]+'), lambda w: w <> '') AS ws
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents)
), words AS (
  SELECT doc_id, ln, w, row_number() OVER (PARTITION BY doc_id ORDER BY ln, pos) AS i
  FROM (SELECT doc_id, ln, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM lines)
), runs AS (
  SELECT doc_id, i, string_agg(w, ' ') OVER o AS body, count(*) OVER o AS n
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS nth FROM runs WHERE n = {RUN}
), marked AS (
  SELECT w.*, coalesce(max(CASE WHEN r.nth > 1 THEN w.i END) OVER (PARTITION BY w.doc_id ORDER BY w.i) > w.i - {RUN}, false) AS gone
  FROM words w LEFT JOIN ranked r ON r.doc_id = w.doc_id AND r.i = w.i
), counts AS (
  SELECT doc_id, sum(gone::INT) AS n_removed FROM marked GROUP BY 1
), kept AS (
  SELECT doc_id, ln, string_agg(w, ' ' ORDER BY i) AS line FROM marked WHERE NOT gone GROUP BY ALL
), rebuilt AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS text FROM kept GROUP BY 1
)
SELECT d.doc_id, coalesce(c.n_removed, 0)::INT AS n_removed, CASE WHEN coalesce(c.n_removed, 0) = 0 THEN d.text ELSE coalesce(r.text, '') END AS text
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN rebuilt r ON r.doc_id = d.doc_id
"""

"""Substring dedup over sliding sentence spans.

A text is a sequence of words; a word that ends in ``.``, ``!`` or ``?`` ends
its sentence, and so does a line's end. A sentence longer than ``UNIT_WORDS``
words is read as several of that length, counted from its start, so that a
passage out of a long sentence can be found at all: measured on 10,000
documents, whole sentences catch 75 % of the words in exact repeats of 50
words, cuts at words chosen by their hash 80 to 84 %, these 94 %. A span is a
run of consecutive sentences: from each sentence on, the shortest run of at
least ``SENTENCES`` sentences and ``SPAN_WORDS`` words. All spans of all
documents are hashed and meet in one join; of equal spans only the first (by
doc_id, then place) stays, and every sentence that any other of them covers is
removed.

Defined cases: null and empty texts have no sentences and stay as they are; a
text from which nothing is removed stays as it is, byte for byte; what is left
of another is its remaining words, one blank between words of a line, lines
without words dropped; a text may end up empty; rows that repeat both doc_id
and text count as one document and get one result each; a null doc_id comes
before all others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Memo, binary, mix, ragged, read, slices, word_hash, worker_kept

SENTENCES = 3
SPAN_WORDS = 20
UNIT_WORDS = 12
_ENDS = (b".", b"!", b"?")


def _word(word: bytes) -> int:
    """The word's hash; its lowest bit says whether the word ends a sentence."""
    return word_hash(word) & ~1 | word.endswith(_ENDS)


def cut(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: hash of each sentence unit, number of its words, and each text's offsets into both."""
    memo = worker_kept("span-words", lambda: Memo(_word))
    memo.trim()
    get = memo.__getitem__
    flat: list[int] = []
    breaks: list[int] = []
    ends = [0]
    for t in texts:
        if t:
            for line in t.split(b"\n"):
                flat += map(get, line.split())
                breaks.append(len(flat))
        ends.append(len(flat))
    values, bounds = np.array(flat, np.uint64), np.array(ends, np.int64)
    return units(values, np.array(breaks, np.int64), bounds)


def units(values: np.ndarray, breaks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    ends = (values & U64(1)).astype(bool)
    ends[breaks[breaks > 0] - 1] = True
    starts = np.concatenate(([0], np.flatnonzero(ends[:-1]) + 1))
    sizes = np.diff(np.append(starts, n))
    per = -(-sizes // UNIT_WORDS)
    nth = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    starts = np.repeat(starts, per) + nth * UNIT_WORDS
    sizes = np.diff(np.append(starts, n))
    place = np.arange(n) - np.repeat(starts, sizes)
    spread = mix((place + 1).astype(np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    return mix(np.add.reduceat(mix(values) * spread, starts) + sizes.astype(np.uint64)), sizes, np.searchsorted(starts, bounds)


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def span_hashes(hashes: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each span's hash, first unit and end unit (counted over all texts)."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    words = np.concatenate(([0], np.cumsum(sizes)))
    end = np.maximum(np.searchsorted(words, words[:-1] + SPAN_WORDS), np.arange(n) + SENTENCES)
    last = np.repeat(offsets[1:], np.diff(offsets))
    start = np.flatnonzero(end <= last)
    end = end[start]
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, _BASE, np.uint64))
        down = np.cumprod(np.full(n, _BACK, np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)))
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def _later(h: np.ndarray, d: pa.Array, k: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether an equal span stands before each of these, among these."""
    later = np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    of = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(h) else order
    if len(of):
        known = d.is_valid().to_numpy(zero_copy_only=False)[of]
        ids = d.fill_null(0).to_numpy()[of]
        of_order = np.lexsort((s[of], k[of], ids, known, h[of]))
        of, known, ids = of[of_order], known[of_order], ids[of_order]
        first = np.maximum.accumulate(np.where(np.concatenate(([True], h[of][1:] != h[of][:-1])), np.arange(len(of)), 0))
        later[of] = (known != known[first]) | (ids != ids[first]) | (k[of] != k[of][first]) | (s[of] != s[of][first])
    return later


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, sizes, offsets = cut(binary(batch.column("text")).to_pylist())
        h, a, b = span_hashes(hashes, sizes, offsets)
        row = np.searchsorted(offsets, a, side="right") - 1
        take = pa.array(row)
        d, k, first = batch.column("d").take(take), batch.column("k").take(take), (a - offsets[row]).astype(np.int32)
        later = _later(h, d, k.to_numpy(), first)
        # what is known to be a repeat need not meet the others: a key of its own spreads it over the tasks
        h[later] = mix(np.arange(int(later.sum()), dtype=np.uint64) + h[later])
        yield pa.RecordBatch.from_arrays([d, k, pa.array(h.view(np.int64)), pa.array(first), pa.array((b - offsets[row]).astype(np.int32)), pa.array(later)], names=["d", "k", "h", "s", "e", "later"])


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the units that ``spans`` cover, the number of units, and of units removed."""
    _, sizes, _ = cut([text])
    gone = np.zeros(len(sizes) + 1, np.int64)
    for a, b in spans:
        gone[min(a, len(sizes))] += 1
        gone[min(b, len(sizes))] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    dropped = np.repeat(gone, sizes).tolist()
    lines, at = [], 0
    for line in text.split(b"\n"):
        words = line.split()
        kept = [w for w, x in zip(words, dropped[at : at + len(words)], strict=True) if not x]
        at += len(words)
        if kept:
            lines.append(b" ".join(kept))
    return b"\n".join(lines), len(sizes), int(gone.sum())


def keyed(docs: DataFrame) -> DataFrame:
    """``d`` (doc_id), ``text`` and ``k``, a hash of the text that tells rows with one id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("d"), text.alias("text"), F.xxhash64(text).alias("k"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``d, k, s, e`` of every span that is not the first of its kind.

    One shuffle, of 37 bytes a span and no text. Of equal spans in one step of
    a worker only the first goes on to meet the others, which thins a span that
    millions of documents share; those of a kind are ranked one after another,
    without memory.
    """
    spans = keyed(docs).mapInArrow(_spans, "d bigint, k bigint, h bigint, s int, e int, later boolean")
    rank = F.dense_rank().over(W.partitionBy("h", "later").orderBy("d", "k", "s"))
    return spans.withColumn("nth", rank).where("later or nth > 1").select("d", "k", "s", "e").distinct()


_CLEANED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("gone", T.IntegerType())])


def cleaned(text: Column, spans: Column) -> Column:
    """Struct of the cleaned text and counts, null where ``spans`` is; only texts that change reach Python."""

    @F.arrow_udf(_CLEANED)
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out: list[dict | None] = []
        for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if t is None or s is None:
                out.append(None)
                continue
            left, n, gone = without(t.encode(), [(x["s"], x["e"]) for x in s])
            out.append({"text": left.decode(), "n": n, "gone": gone})
        return pa.array(out, pa.struct([("text", pa.string()), ("n", pa.int32()), ("gone", pa.int32())]))

    return run(F.when(spans.isNotNull(), text), spans)


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_removed, text`` of every document after the repeated spans are taken out."""
    gone = repeated_spans(docs).groupBy("d", "k").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    base = keyed(docs)
    joined = base.join(gone, base["d"].eqNullSafe(gone["d"]) & base["k"].eqNullSafe(gone["k"]), "left").select(base["d"], base["text"], "spans")
    done = joined.withColumn("c", cleaned(F.col("text"), F.col("spans")))
    return done.select(F.col("d").alias("doc_id"), F.coalesce("c.gone", F.lit(0)).alias("n_removed"), F.coalesce("c.text", "text").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, ln, list_filter(string_split_regex(line, '[ \t\r\x0B\f]+'), lambda w: w <> '') AS ws
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents)
), words AS (
  SELECT doc_id, ln, w, pos, len(ws) AS in_line FROM (SELECT doc_id, ln, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM lines)
), marked AS (
  SELECT *, row_number() OVER d AS i, (pos = in_line OR right(w, 1) IN ('.', '!', '?'))::INT AS ends
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY ln, pos)
), sentences AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM marked
), placed AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, sent ORDER BY i) - 1) // {UNIT_WORDS} AS piece FROM sentences
), tagged AS (
  SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY sent, piece) - 1 AS u FROM placed
), units AS (
  SELECT doc_id, u, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM tagged GROUP BY ALL
), running AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY u) AS upto FROM units
), reach AS (
  SELECT a.doc_id, a.u AS s, min(b.u) AS e FROM running a JOIN running b
  ON a.doc_id = b.doc_id AND b.u >= a.u + {SENTENCES - 1} AND b.upto >= a.upto - a.n + {SPAN_WORDS} GROUP BY ALL
), spans AS (
  SELECT r.doc_id, r.s, r.e, string_agg(x.t, chr(10) ORDER BY x.u) AS body FROM reach r JOIN units x ON x.doc_id = r.doc_id AND x.u BETWEEN r.s AND r.e GROUP BY ALL
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS nth FROM spans) WHERE nth > 1
), gone AS (
  SELECT DISTINCT x.doc_id, x.u FROM later r JOIN units x ON x.doc_id = r.doc_id AND x.u BETWEEN r.s AND r.e
), counts AS (
  SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1
), kept AS (
  SELECT t.doc_id, t.ln, string_agg(t.w, ' ' ORDER BY t.i) AS line FROM tagged t ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.u = t.u GROUP BY ALL
), rebuilt AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS text FROM kept GROUP BY 1
)
SELECT d.doc_id, coalesce(c.n_removed, 0)::INT AS n_removed, CASE WHEN c.n_removed IS NULL THEN d.text ELSE coalesce(r.text, '') END AS text
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN rebuilt r ON r.doc_id = d.doc_id
"""

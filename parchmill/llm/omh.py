"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text's words are folded and stripped of edge punctuation. Its k-mers of
``K`` words carry their occurrence number, so a repeated k-mer is a different
element each time. Each of ``SKETCHES`` hash functions picks the ``PICK``
least elements; the sketch hashes them *in text order*, which makes equal
sketches likely for texts of small edit distance, not merely of like content.

Documents that share a sketch meet in a bucket. Texts of edit similarity 0.8
have a Jaccard overlap of at least 2/3 in their occurrence-labelled words, so
only pairs count as candidates whose lengths allow that similarity and whose
overlap, estimated from ``BINS`` bins of least word hashes, is at least
``OVERLAP`` (three standard deviations below). Documents that merely share a
passage meet in a bucket too, and end there.

In a bucket the least id that is candidate to no earlier leader becomes a
leader, and every document is paired with every leader it is candidate to, so
a bucket of n copies gives n pairs. Then, in buckets whose documents verified
pairs do not yet connect, everything outside the largest connected part is
paired with all its candidates outside its own part, first with the
``NEAREST`` most alike, then with all, so that no rejected leader hides a
pair. Nothing is capped: a bucket of more than ``BLOCK`` documents is met block
by block, and later block against block, each of which is a task's work. A pair
counts when the alignment of its word sequences shows an edit similarity
``1 - distance / longer`` of at least ``THRESHOLD``; the band is doubled
until the pair is accepted or the band holds every alignment that could pass.
Groups are the connected components of such pairs, and the least id is kept.
Texts that are equal after folding share one signature: only one of them is
searched, the others follow it.

Defined cases: null, empty and wordless texts and rows without doc_id belong
to no group; a text of fewer than ``K`` words is one k-mer; rows that repeat a
doc_id count as one document (of differing texts the one with the least hash
is searched); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Memo, U64, binary, columns, components, fresh, look_up, materialize, mix, ragged, read, slices, word_hash, words_of, worker_kept

K = 3
PICK = 2
SKETCHES = 28
#: Bins of the word overlap's estimate, and the least estimate of a candidate pair.
BINS = 128
OVERLAP = 0.54
#: Documents of one bucket that one step of a worker compares with each other.
BLOCK = 8192
#: Partners of each unlinked document that are aligned before all its others: saves alignments, changes no result.
NEAREST = 4
THRESHOLD = 0.8
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|/\\-_=+~`@^«»„“”"
#: Bits of a k-mer's position beside the upper bits of its hash, and the same for texts of more k-mers than those count.
PLACE_BITS = 24
LONG_PLACE_BITS = 40
_MOST = U64(0xFFFFFFFFFFFFFFFF)


def _folded(word: bytes) -> int:
    core = word.decode("utf-8", "replace").strip(_EDGES).casefold()
    return word_hash(core.encode()) | 1 if core else 0


def folded_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the folded words of all texts, and each text's offsets; punctuation alone is no word."""
    memo = worker_kept("omh-words", lambda: Memo(_folded))
    memo.trim()
    parts, offsets = words_of(texts)
    values = look_up(parts, memo, int(offsets[-1]))
    word = values != 0
    return values[word], np.concatenate(([0], np.cumsum(word)))[offsets]


def _factors(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def kmers(values: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mer hashes of all texts, and each text's offsets."""
    counts = np.diff(offsets)
    per = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    at = ragged(offsets[:-1], per)
    end = np.repeat(offsets[1:], per)
    owner = np.repeat(np.arange(len(per), dtype=np.uint64), per)
    h = np.zeros(len(at), np.uint64)
    for j, f in enumerate(_factors(k)):
        inside = at + j < end
        h += np.where(inside, values[np.minimum(at + j, len(values) - 1)], U64(0)) * f
    h = mix(h)
    key = mix(h + owner * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0)) if len(ranked) else np.empty(0, np.int64)
    occurrence = np.empty(len(ranked), np.uint64)
    occurrence[order] = (np.arange(len(ranked)) - first).astype(np.uint64)
    return mix(h + occurrence * U64(0xD1B54A32D192ED03)), np.concatenate(([0], np.cumsum(per)))


def sketch(elements: np.ndarray, offsets: np.ndarray, count: int = SKETCHES) -> np.ndarray:
    """The order-min sketches (documents, count); all documents must have an element."""
    starts = offsets[:-1]
    out = np.empty((len(starts), count), np.uint64)
    if not len(starts):
        return out
    counts = np.diff(offsets)
    place = (np.arange(len(elements)) - np.repeat(starts, counts)).astype(np.uint64)
    long_ = counts >= 1 << PLACE_BITS
    bits = np.where(long_, U64(LONG_PLACE_BITS), U64(PLACE_BITS))
    low = (U64(1) << bits) - U64(1)
    keep = np.repeat(~low, counts) if long_.any() else ~low[0]
    y = np.empty_like(elements)
    for i, f in enumerate(_factors(count)):
        np.multiply(elements, f, out=y)
        np.bitwise_and(y, keep, out=y)
        np.bitwise_or(y, place, out=y)
        picks = []
        for _ in range(PICK):
            least = np.minimum.reduceat(y, starts)
            at = starts + np.where(least == _MOST, picks[-1] - starts if picks else 0, (least & low).astype(np.int64))
            picks.append(at)
            y[at] = _MOST
        h = np.full(len(starts), i, np.uint64)
        for at in np.sort(np.stack(picks), axis=0):
            h = mix(h * U64(0x9E3779B97F4A7C15) + elements[at])
        out[:, i] = h
    return out


def bags(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``(documents, BINS)`` bytes: of each bin of a text's occurrence-labelled words 8 bits of the least hash, 0 for an empty bin."""
    rows = len(offsets) - 1
    room = U64(40)  # bits of a word's hash, the same whatever texts share the batch; its row is above
    top = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(offsets)) << room
    ranked = np.sort(top | values >> (U64(64) - room))
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, bool)
    nth = np.arange(len(ranked)) - np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))
    labelled = mix((ranked << (U64(64) - room)) + nth.astype(np.uint64) * U64(0xD1B54A32D192ED03))
    ranked = np.sort(ranked >> room << room | labelled >> (U64(64) - room))
    slot = (ranked >> room).astype(np.int64) * BINS + (ranked << (U64(64) - room) >> U64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.empty(0, np.int64)
    out = np.zeros(rows * BINS, np.uint8)
    out[slot[first]] = np.maximum((ranked[first] << (U64(71) - room) >> U64(56)).astype(np.uint8), 1)
    return out.reshape(rows, BINS)


def overlaps(one: np.ndarray, bag: np.ndarray) -> np.ndarray:
    """Estimated Jaccard overlaps of one bag with each of ``bag``."""
    same = np.bitwise_count((bag == one).view(np.uint64)).sum(1, dtype=np.int32)
    neither = np.bitwise_count((bag | one == 0).view(np.uint64)).sum(1, dtype=np.int32)
    return (same - neither) / np.maximum(BINS - neither, 1)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, hash ``key`` of the folded words, their number ``n``, bucket hashes ``sk`` and ``bag`` for the word overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            values, offsets = folded_words(binary(batch.column(1)).to_pylist())
            has = np.diff(offsets) > 0
            keys = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b, h in zip(offsets, offsets[1:], has, strict=False) if h]
            within = np.concatenate((offsets[:-1][has], offsets[-1:]))
            sk, bag = sketch(*kmers(values, within)), bags(values, within)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sk) + 1, dtype=np.int32) * SKETCHES), pa.array(sk.view(np.int64).ravel()))
            ids = batch.column(0).filter(pa.array(has))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(np.diff(offsets)[has].astype(np.int32)), lists, pa.array([b.tobytes() for b in bag], pa.binary())], names=["doc_id", "key", "n", "sk", "bag"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id bigint, key binary, n int, sk array<bigint>, bag binary")


def _like(n: np.ndarray, bag: np.ndarray, k: int, of: np.ndarray) -> np.ndarray:
    """Estimated overlap of row k with each row of ``of``, 0 where it is no candidate."""
    fits = np.minimum(n[of], n[k]) >= THRESHOLD * np.maximum(n[of], n[k])
    out = np.zeros(len(of))
    out[fits] = overlaps(bag[k], bag[of[fits]])
    return np.where(out >= OVERLAP, out, 0.0)


def _leaders(ids: np.ndarray, n: np.ndarray, bag: np.ndarray, label: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (leader, member) of one bucket or block of it, whose rows are sorted by id."""
    led = np.zeros(len(ids), bool)
    for k in range(len(ids) - 1):
        if led[k]:
            continue
        rest = np.arange(k + 1, len(ids))
        got = rest[_like(n, bag, k, rest) > 0]
        led[got] = True
        yield np.full(len(got), ids[k]), ids[got]


def _unlinked(ids: np.ndarray, n: np.ndarray, bag: np.ndarray, label: np.ndarray, side: np.ndarray, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs across labels, and across sides where there are two; with ``most``, only each one's most alike.

    Of all pairs across labels one is outside the largest label, so only those rows are gone through.
    """
    names, nth, counts = np.unique(label, return_inverse=True, return_counts=True)
    two = bool((side != side[0]).any())
    for k in np.flatnonzero(nth != counts.argmax()) if len(names) > 1 else ():
        rest = np.flatnonzero((nth != nth[k]) & (side != side[k]) if two else nth != nth[k])
        like = _like(n, bag, k, rest)
        if most is not None and len(rest) > most:
            chosen = np.argpartition(-like, most - 1)[:most]
            rest, like = rest[chosen], like[chosen]
        got = rest[like > 0]
        yield np.minimum(ids[k], ids[got]), np.maximum(ids[k], ids[got])


def _bucket_pairs(of: Callable[..., Iterable[tuple[np.ndarray, np.ndarray]]]):
    """Arrow worker: ``of`` each bucket, or block (pair) of a large one. They arrive sorted by (g, doc_id); one may span batches."""

    def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        g, *columns = (np.concatenate(c) for c in zip(*rows, strict=True))
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for x, y in zip(cuts, cuts[1:], strict=False):
            for pair in of(*(c[x:y] for c in columns)) if y - x > 1 else ():
                found.append(pair)
                size += len(pair[0])
                if size > 500_000:
                    yield batch_of(found)
                    found, size = [], 0
        if found:
            yield batch_of(found)

    def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        both = np.unique(np.stack([np.concatenate(c) for c in zip(*found, strict=True)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g, ids, n, label, side = (batch.column(c).to_numpy() for c in ("g", "doc_id", "n", "label", "side"))
            bag = np.frombuffer(b"".join(batch.column("bag").to_pylist()), np.uint8).reshape(len(g), BINS)
            last = int(np.flatnonzero(g[1:] != g[:-1])[-1]) + 1 if (g[1:] != g[:-1]).any() else 0
            if last or (held and held[-1][0][-1] != g[0]):
                held.append((g[:last], ids[:last], n[:last], bag[:last], label[:last], side[:last]))
                yield from emit(held)
                held = []
            held.append((g[last:], ids[last:], n[last:], bag[last:], label[last:], side[last:]))
        yield from emit(held)

    return run


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Edit distances of word arrays along a band of half width ``band``: exact up to that distance, else an upper bound."""
    count = len(pairs)
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    rows, width = int(n.max()), 2 * band + 1
    left = np.full((count, rows + 1), -1, np.int32)
    right = np.full((count, rows + width + 1), -2, np.int32)
    for k, (a, b) in enumerate(pairs):
        left[k, : len(a)] = a
        b = b[: rows + band]
        right[k, band + 1 : band + 1 + len(b)] = b
    far = np.int32(1 << 28)
    shift = np.arange(width, dtype=np.int32)
    prev = np.tile(np.where(shift >= band, shift - band, far), (count, 1)).astype(np.int32)
    end = m - n + band
    inside = (end >= 0) & (end < width)
    out = np.full(count, far, np.int64)
    todo = n == 0
    out[todo & inside] = prev[todo & inside, end[todo & inside]]
    cur = np.empty_like(prev)
    for i in range(1, rows + 1):
        np.not_equal(left[:, i - 1 : i], right[:, i : i + width], out=cur, casting="unsafe")
        cur += prev
        np.minimum(cur[:, :-1], prev[:, 1:] + 1, out=cur[:, :-1])
        if i < band:
            cur[:, : band - i] = far
        cur -= shift
        np.minimum.accumulate(cur, axis=1, out=cur)
        cur += shift
        prev, cur = cur, prev
        done = np.flatnonzero((n == i) & inside)
        if len(done):
            out[done] = prev[done, end[done]]
    return out


def similarities(pairs: list[tuple[np.ndarray, np.ndarray]], threshold: float = THRESHOLD) -> np.ndarray:
    """Edit similarity of each pair, or -1 where it is certainly below ``threshold``."""
    result = np.full(len(pairs), -1.0)
    todo: list[tuple[int, int]] = []  # band, pair
    for k, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        if not longer:
            continue
        limit = int((1 - threshold) * longer + 1e-9)
        # no alignment keeps more words than both have in common
        words, counts = np.unique(a, return_counts=True)
        at = np.minimum(np.searchsorted(words, b), len(words) - 1) if len(words) else np.zeros(0, int)
        common = int(np.minimum(counts, np.bincount(at[words[at] == b], minlength=len(words))).sum()) if len(words) else 0
        if longer - common <= limit:
            todo.append((min(limit, abs(len(a) - len(b)) + 8), k))
    while todo:
        # alike in band and length, so that the steps of many pairs are one array operation
        todo.sort(key=lambda x: (x[0].bit_length(), len(pairs[x[1]][0])))
        again, at = [], 0
        while at < len(todo):
            take = todo[at : at + 1]
            band, size = take[0][0], 0
            for x in todo[at + 1 : at + 2000]:
                size = (len(take) + 1) * len(pairs[x[1]][0])
                if x[0].bit_length() != take[0][0].bit_length() or size > 3_000_000 or (len(take) + 1) * (2 * max(band, x[0]) + 1) > 60_000:
                    break
                band = max(band, x[0])
                take.append(x)
            at += len(take)
            got = distances([pairs[k] for _, k in take], band)
            for (_, k), d in zip(take, got.tolist(), strict=True):
                longer = max(map(len, pairs[k]))
                limit = int((1 - threshold) * longer + 1e-9)
                if d <= limit:
                    result[k] = 1 - d / longer
                elif band < limit:
                    again.append((min(limit, 2 * band), k))
        todo = again
    return result


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "wa", 8_000_000):
        a, b = ([np.frombuffer(w, np.int32) for w in batch.column(c).to_pylist()] for c in ("wa", "wb"))
        sim = similarities(list(zip(a, b, strict=True)))
        good = pa.array(sim >= 0)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good), pa.array(np.round(sim, 6)).filter(good)], names=["u", "v", "similarity"])


def _word_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        values, offsets = folded_words(binary(batch.column(1)).to_pylist())
        keys = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
        short = (values >> U64(32)).astype(np.uint32).view(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array([short[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())], names=["doc_id", "key", "words"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document that is not the first of its group: ``doc_id, kept_id, partner_id, similarity``.

    ``partner_id`` is the most similar document it was verified against
    (similarity 1 for texts equal after folding).
    """
    found = materialize(signatures(docs), "omh-signatures")
    # only ids and keys are grouped, and they combine before the shuffle: a text of millions of copies is one row of each task
    one = found.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = found.select("doc_id", "key").join(one.where("copies > 1").select("key", "rep"), "key").where("doc_id <> rep").select("doc_id", "rep").distinct()
    chosen = one.groupBy(F.col("rep").alias("doc_id")).agg(F.min("key").alias("key"))
    reps = materialize(found.join(chosen, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id"]).drop("key"), "omh-reps")
    buckets = reps.select("doc_id", F.explode("sk").alias("h"))
    shared = materialize(buckets.withColumn("size", F.count("*").over(W.partitionBy("h"))).where("size > 1").select("h", "doc_id", "size"), "omh-shared")
    marks = reps.select("doc_id", "n", "bag")
    wanted = shared.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    # a merge join at every size: with few ids they would be broadcast, with many not, and no small run would foretell a large one
    words = texts.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_word_arrays, "doc_id bigint, key binary, words binary")
    words = materialize(words.groupBy("doc_id").agg(F.min_by("words", "key").alias("words")), "omh-words")

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")

    def meet(labelled: DataFrame, of: Callable, across: bool) -> DataFrame:
        """Pairs within each block of a bucket, or also of each two blocks."""
        other = F.explode(F.sequence(F.lit(0), blocks - 1)) if across else own
        placed = labelled.select("h", "doc_id", "label", own.alias("side"), other.alias("other"))
        placed = placed.select(F.xxhash64("h", F.least("side", "other"), F.greatest("side", "other")).alias("g"), "doc_id", "label", "side")
        met = placed.join(marks, "doc_id").select("g", "doc_id", "n", "bag", "label", "side")
        return met.repartition("g").sortWithinPartitions("g", "doc_id").mapInArrow(_bucket_pairs(of), "a bigint, b bigint").distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(words.toDF("a", "wa"), "a").join(words.toDF("b", "wb"), "b").select("a", "b", "wa", "wb")
        # cheap rows, costly work: as many tasks as cores, whatever the bytes
        return materialize(joined.mapInArrow(_verify, "u bigint, v bigint, similarity double"), "omh-edges")

    tried = materialize(meet(shared.withColumn("label", F.col("doc_id")), _leaders, False), "omh-pairs")
    edges = verified(tried)
    roots = components(edges, "omh")
    for most in (NEAREST, None):
        labelled = shared.join(roots.toDF("doc_id", "root"), "doc_id", "left").select("h", "doc_id", "size", F.coalesce("root", "doc_id").alias("label"))
        split = labelled.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
        more = materialize(meet(labelled.join(split, "h", "left_semi"), partial(_unlinked, most=most), True).join(tried, ["a", "b"], "left_anti"), "omh-pairs")
        if not more.isEmpty():
            tried, edges = tried.union(more), edges.union(verified(more))
            roots = components(edges, "omh")
    best = (
        edges.union(edges.select("v", "u", "similarity"))
        .groupBy(F.col("u").alias("rep"))
        .agg(F.max_by(F.struct(F.col("v").alias("partner"), "similarity"), F.struct("similarity", -F.col("v"))).alias("b"))
    )
    alike = roots.where("id <> root").join(best, roots["id"] == best["rep"], "left").select(F.col("id").alias("doc_id"), F.col("root").alias("kept_id"), F.col("b.partner").alias("partner_id"), F.col("b.similarity").alias("similarity"))
    equal = copies.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("kept_id"), F.col("rep").alias("partner_id"), F.lit(1.0).alias("similarity"))
    return alike.union(equal).where("doc_id <> kept_id").groupBy("doc_id").agg(F.min("kept_id").alias("kept_id"), F.min_by("partner_id", F.struct("kept_id", -F.col("similarity"), "partner_id")).alias("partner_id"), F.max("similarity").alias("similarity"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one document of each group stays.

    Rows equal in doc_id and text are copies too, of which one stays; rows without doc_id all stay.
    """
    id_, key, place = fresh(docs, "id", "k", "nth")
    gone = near_duplicates(docs).select(F.col("doc_id").alias(id_))
    row = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64(F.col("text").cast("string")))
    nth = F.row_number().over(W.partitionBy(id_, key).orderBy(key))
    kept = row.join(gone, id_, "left_anti").withColumn(place, nth)
    return kept.where((F.col(place) == 1) | F.col(id_).isNull()).select(*columns(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))

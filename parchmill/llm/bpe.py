"""BPE encoding by backtracking, decoding by an offset table.

An Aho-Corasick pass finds every vocabulary token in a piece of text. Encoding
walks from left to right with the longest token at each place; a token may
follow another only if merging both in order of rank could leave that boundary
in place, which a pair-compatibility walk over the table of merges decides. If
no token fits, the last one is taken back and shortened. Places that failed are
marked, so no place is tried twice and the time is linear. The result equals
that of merging in order of rank, exactly. Decoding looks tokens up in one
byte string through a table of offsets.

Text is first cut by the vocabulary's pattern. Single blanks and line breaks
between words are cut points of the pattern, so most text is cut by plain
splitting; a text with any other white space goes through the pattern itself.
Every distinct piece is encoded once per worker while it is remembered.

Defined cases: null gives null ids, null counts and a null flag; an empty text
gives an empty list and a true flag; any length and any Unicode text encodes,
as every byte is a token; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, binary, ragged, read, slices, worker_kept

#: Where the vocabulary lies, unless the session's ``spark.parchmill.vocabulary`` or a caller names another.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_PIECES = 600_000
SCHEMA = "doc_id bigint, token_ids array<int>, n_tokens int, round_trip boolean"


class Tables(NamedTuple):
    """A vocabulary as the encoder needs it; token t's last merge joined left[t] and right[t] (t itself for a byte)."""

    tokens: list[bytes]
    left: list[int]
    right: list[int]
    shorter: list[int]
    reachable: list[bool]


def _merge(word: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], below)
            if rank < best:
                best, at = rank, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def load_tables(path: str = VOCABULARY) -> Tables:
    """Read a rank file (base64 token, rank) and work out each token's last merge and its longest shorter prefix."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    size = max(ranks.values()) + 1
    tokens, left, right, shorter, reachable = [b""] * size, list(range(size)), list(range(size)), [-1] * size, [False] * size
    for word, rank in ranks.items():
        tokens[rank] = word
        shorter[rank] = next((ranks[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in ranks), -1)
        if len(word) == 1:
            reachable[rank] = True
            continue
        parts = _merge(word, ranks, rank)
        if len(parts) == 2:
            left[rank], right[rank], reachable[rank] = ranks[parts[0]], ranks[parts[1]], True
    return Tables(tokens, left, right, shorter, reachable)


class Encoder:
    """Encodes pieces of bytes; ``encode`` is exact for any input."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.length = [len(w) for w in tables.tokens]
        self.whole = {w: k for k, w in enumerate(tables.tokens) if tables.reachable[k]}
        self.pairs = {(tables.left[k], tables.right[k]): k for k, w in enumerate(tables.tokens) if len(w) > 1 and tables.reachable[k]}
        self.automaton = ahocorasick.Automaton()
        for k, w in enumerate(tables.tokens):
            if tables.reachable[k]:
                self.automaton.add_word(w.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging in order of rank can end with token a right before token b."""
        key = (a, b)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > MEMO_PIECES:
                self.known.clear()
            got = self.known[key] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        # undo merges on both sides of the boundary, latest first; a pair that
        # would have merged before what was just undone breaks the boundary
        left, right, pairs = self.t.left, self.t.right, self.pairs
        bound = len(left)
        while True:
            joined = pairs.get((a, b))
            if joined is not None and joined < bound:
                return False
            if a > b:
                bound, inner = a, right[a]
                if inner != a:
                    a = inner
                    continue
                bound, inner = b + 1, left[b]
                if inner == b:
                    return True
                b = inner
            else:
                bound, inner = b + 1, left[b]
                if inner != b:
                    b = inner
                    continue
                bound, inner = a, right[a]
                if inner == a:
                    return True
                a = inner

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        one = self.whole.get(piece)
        if one is not None:
            return [one]
        n, length, shorter, reachable = len(piece), self.length, self.t.shorter, self.t.reachable
        longest = [0] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length[token] + 1] = token  # longer ones end later
        out: list[int] = []
        open_ = bytearray(b"\1" * (n + 1))
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if open_[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            token = shorter[token]
            while token >= 0 and not reachable[token]:
                token = shorter[token]
            if token < 0:  # no token fits here: never come back, and shorten the one before
                open_[at] = 0
                token = out.pop()
                at -= length[token]
                # fall through to the shorter prefixes of the token taken back
        return out


class BatchEncoder:
    """Encodes many texts at once: distinct pieces through :class:`Encoder`, the rest by array look-up."""

    def __init__(self, tables: Tables, pattern: str = PATTERN):
        self.encoder = Encoder(tables)
        self.cut = regex.compile(pattern)
        self.blank = regex.compile(r"\s")
        self._reset()

    def _reset(self) -> None:
        self.flat, self.starts, self.lengths = array("i"), array("q"), array("q")
        self.pieces = Memo(self._add)
        self.after_blank, self.bare = Memo(lambda w: self._word(" ", w)), Memo(lambda w: self._word("", w))
        self.line_break = self.pieces["\n"]

    def _store(self, ids: list[int]) -> int:
        self.starts.append(len(self.flat))
        self.lengths.append(len(ids))
        self.flat.extend(ids)
        return len(self.starts) - 1

    def _add(self, piece: str) -> int:
        return self._store(self.encoder.encode(piece.encode("utf-8", "surrogatepass")))

    def _word(self, before: str, word: str) -> int:
        """The unit of a word after ``before``; -1 if splitting at blanks would not agree with the pattern."""
        if not word or self.blank.search(word):
            return -1
        parts = self.cut.findall(before + word)
        if len(parts) == 1:
            return self.pieces[parts[0]]
        ids: list[int] = []
        for p in parts:
            unit = self.pieces[p]
            a = self.starts[unit]
            ids += self.flat[a : a + self.lengths[unit]]
        return self._store(ids)

    def _units(self, text: str) -> list[int]:
        units: list[int] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                units.append(self.line_break)
            first, *rest = line.split(" ")
            units.append(self.bare[first])
            units += map(self.after_blank.__getitem__, rest)
        if -1 in units:
            return [self.pieces[p] for p in self.cut.findall(text)]
        return units

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids one after another, and the offsets of each text's ids (null and empty texts have none)."""
        if len(self.starts) > MEMO_PIECES:
            self._reset()
        units = [self._units(t) if t else [] for t in texts]
        each = np.fromiter(map(len, units), np.int64, len(units))
        of = np.fromiter((u for x in units for u in x), np.int64, int(each.sum()))
        starts, lengths = np.frombuffer(self.starts, np.int64)[of], np.frombuffer(self.lengths, np.int64)[of]
        ids = np.frombuffer(self.flat, np.int32)[ragged(starts, lengths)] if len(of) else np.empty(0, np.int32)
        done = np.concatenate(([0], np.cumsum(lengths)))
        return ids, done[np.concatenate(([0], np.cumsum(each)))]


class Decoder:
    """Decodes through one byte string that holds every token, and the table of where each begins."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(w) for w in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the running length after each id."""
        lengths = self.lengths[ids]
        return self.bytes[ragged(self.starts[ids], lengths)], np.concatenate(([0], np.cumsum(lengths)))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token ids of ``docs(doc_id, text)``, their number, and whether decoding them gives back the very bytes.

    The tables (bounded by the vocabulary, not by the data) are built once and
    broadcast; the documents are not shuffled.
    """
    spark = docs.sparkSession
    path = path or spark.conf.get("spark.parchmill.vocabulary", VOCABULARY)
    shared = spark.sparkContext.broadcast(load_tables(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = worker_kept(("bpe", path), lambda: (BatchEncoder(shared.value), Decoder(shared.value.tokens)))
        for batch in slices(batches, "text"):
            column = batch.column(1)
            ids, offsets = encoder.encode(column.to_pylist())
            raw, ends = decoder.decode(ids)
            back = memoryview(np.ascontiguousarray(raw))
            null = np.asarray(column.is_null())
            same = [None if b is None else bytes(back[ends[x] : ends[y]]) == b for b, x, y in zip(binary(column).to_pylist(), offsets[:-1], offsets[1:], strict=True)]
            counts = pa.array(np.diff(offsets).astype(np.int32), mask=null)
            at = pa.array(offsets.astype(np.int32), mask=np.append(null, False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(ids)), counts, pa.array(same, pa.bool_())], names=["doc_id", "token_ids", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))

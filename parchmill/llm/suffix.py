"""Collection suffix order built column by column, with its common prefixes.

``SuffixOrder`` sorts all suffixes of many strings by inserting one symbol per
string and round, from the strings' ends to their starts. A suffix ``c + S``
goes behind all suffixes that begin with a lesser symbol and behind those
``c + R`` whose tail R precedes S: its place follows from the Burrows-Wheeler
transform of the round before. The length of its common prefix with a
neighbour is 1 plus the least common prefix between both tails, found in the
array of the round before.

The transform, the order and the common prefixes are files, one for each, that
each round reads from front to back, chunk by chunk, three times (to find the
places, to find the common prefixes, to merge) and writes anew in that order.
The symbols are a file too, laid out by round. In memory there are only the
symbols and places of one round, and one chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

#: Entries that are read at a time.
CHUNK = 1 << 19
LOWEST = np.int64(np.iinfo(np.int32).min)
_HALF = np.int64(1) << np.int64(32)
COLUMNS = {"key": np.int64, "lcp": np.uint8, "who": np.int64, "bwt": np.int32}
#: Longest string: common prefixes are kept in a byte, string offsets in 8 bits.
MAX_LENGTH = 250


class Files:
    """The columns as files of one folder; a round writes new ones from front to back and drops those of the round before."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        self.fs, path = fs.FileSystem.from_uri(folder)
        self.path = f"{path}/{uuid.uuid4().hex}"
        self.fs.create_dir(self.path, recursive=True)
        self.round = 0
        self.sizes: list[int] = []
        self.coming: list[int] = []
        self.inputs: dict = {}
        self.outputs = self._open()
        self.symbols = self.fs.open_output_stream(f"{self.path}/symbols")
        #: Strings, longest string and first byte of each part of the file of symbols.
        self.parts: list[tuple[int, int, int]] = []
        self.written = 0

    def _open(self) -> dict:
        return {c: self.fs.open_output_stream(f"{self.path}/{self.round + 1}-{c}") for c in COLUMNS}

    def put_symbols(self, rounds: np.ndarray) -> None:
        """The symbols of some strings, a row for each round."""
        self.parts.append((rounds.shape[1], rounds.shape[0], self.written))
        data = np.ascontiguousarray(rounds, np.int32).tobytes()
        self.symbols.write(data)
        self.written += len(data)

    def end_symbols(self) -> None:
        self.symbols.close()
        self.symbols = self.fs.open_input_file(f"{self.path}/symbols")

    def symbols_of(self, turn: int) -> np.ndarray:
        """Symbols of all strings in this round; any number where a string has ended."""
        out = [np.empty(0, np.int32)]
        for count, longest, begin in self.parts:
            if turn <= longest:
                self.symbols.seek(begin + 4 * count * (turn - 1))
                out.append(np.frombuffer(self.symbols.read(4 * count), np.int32))
            else:
                out.append(np.zeros(count, np.int32))
        return np.concatenate(out)

    def read(self, k: int, column: str) -> np.ndarray:
        kind = np.dtype(COLUMNS[column])
        f = self.inputs[column]
        f.seek(kind.itemsize * sum(self.sizes[:k]))
        return np.frombuffer(f.read(kind.itemsize * self.sizes[k]), kind)

    def write(self, entries: dict[str, np.ndarray], chunk: int) -> None:
        for column, values in entries.items():
            self.outputs[column].write(np.ascontiguousarray(values, COLUMNS[column]).tobytes())
        size = len(entries["who"])
        pieces = max(1, size // chunk)
        self.coming += [size * (p + 1) // pieces - size * p // pieces for p in range(pieces)]

    def turn(self) -> None:
        for c in COLUMNS:
            self.outputs[c].close()
            if c in self.inputs:
                self.inputs[c].close()
                self.fs.delete_file(f"{self.path}/{self.round}-{c}")
        self.round += 1
        self.sizes, self.coming = self.coming, []
        self.inputs = {c: self.fs.open_input_file(f"{self.path}/{self.round}-{c}") for c in COLUMNS}
        self.outputs = self._open()

    def close(self) -> None:
        for f in (*self.outputs.values(), *self.inputs.values(), self.symbols):
            f.close()
        self.fs.delete_dir(self.path)


def _block_minima(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Running minima from each block's start and end, and minima over 2**k blocks from each block on."""
    blocks = np.full((-(-len(values) // 64), 64), 255, np.uint8)
    blocks.ravel()[: len(values)] = values
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return fore, back, _doubling(blocks.min(axis=1))


def _doubling(least: np.ndarray) -> list[np.ndarray]:
    table = [least]
    while 2 << (len(table) - 1) <= len(least):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    return table


def _between(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of the blocks lo..hi-1, or 255 where there are none."""
    out = np.full(len(lo), 255, np.uint8)
    some = np.flatnonzero(hi > lo)
    if len(some):
        a, b = lo[some], hi[some]
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in np.unique(level):
            of = level == k
            out[some[of]] = np.minimum(table[k][a[of]], table[k][b[of] - (1 << int(k))])
    return out


def range_min(values: np.ndarray, made: tuple, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of ``values[lo..hi]`` (both included, lo <= hi)."""
    fore, back, table = made
    a, b = lo >> 6, hi >> 6
    out = np.minimum(back[lo], fore[hi])
    far = _between(table, a + 1, b)
    np.minimum(out, far, out=out)
    near = np.flatnonzero(a == b)
    if len(near):
        at, end = lo[near], hi[near]
        least = values[at]
        for step in range(1, int((end - at).max()) + 1 if len(near) else 0):
            np.minimum(least, values[np.minimum(at + step, end)], out=least)
        out[near] = least
    return out


class SuffixOrder:
    """Suffixes of strings (int32 arrays of at most ``MAX_LENGTH``) in order, by rounds of one symbol each."""

    def __init__(self, folder: str, chunk: int = CHUNK):
        self.chunk = chunk
        self.store = Files(folder)
        self.sizes: list[np.ndarray] = []

    def add(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        """More strings, behind those before; their symbols go to the file at once."""
        lengths = lengths.astype(np.int64)
        if not len(lengths):
            return
        longest = int(lengths.max())
        if longest > MAX_LENGTH:
            raise ValueError(f"a string has {longest} symbols, more than {MAX_LENGTH}")
        ends = np.cumsum(lengths)
        rounds = np.zeros((longest, len(lengths)), np.int32)
        nth = np.repeat(ends, lengths) - np.arange(len(symbols)) - 1
        rounds[nth, np.repeat(np.arange(len(lengths)), lengths)] = np.maximum(symbols, np.int32(LOWEST + 1))
        self.store.put_symbols(rounds)
        self.sizes.append(lengths.astype(np.uint8))

    def build(self) -> SuffixOrder:
        self.lengths = np.concatenate([np.empty(0, np.uint8), *self.sizes]).astype(np.int64)
        self.store.end_symbols()
        count = len(self.lengths)
        # the empty suffixes, one per string and in its order
        for a in range(0, count, self.chunk):
            ids = np.arange(a, min(a + self.chunk, count), dtype=np.int64)
            self.store.write({"key": LOWEST * _HALF + ids, "lcp": np.zeros(len(ids), np.uint8), "who": ids << np.int64(8) | self.lengths[ids], "bwt": np.full(len(ids), LOWEST, np.int32)}, self.chunk)
        self.store.turn()
        self.place = np.arange(count, dtype=np.int64)
        for turn in range(1, int(self.lengths.max()) + 1 if count else 0):
            self._round(turn)
        return self

    def _round(self, turn: int) -> None:
        active = np.flatnonzero(self.lengths >= turn)
        symbol = self.store.symbols_of(turn)[active]
        tail = self.place[active]
        keys = symbol.astype(np.int64) * _HALF + tail
        order = np.argsort(keys, kind="stable")
        keys, ids, symbol, tail = keys[order], active[order], symbol[order], tail[order]
        store, sizes = self.store, self.store.sizes
        starts = np.concatenate(([0], np.cumsum(sizes)))
        # 1: where each new suffix goes, and the keys around that place
        at = np.empty(len(keys), np.int64)
        before, after = np.full(len(keys), LOWEST * _HALF), np.full(len(keys), np.int64(np.iinfo(np.int64).max))
        done, last = 0, LOWEST * _HALF
        for k, size in enumerate(sizes):
            held = store.read(k, "key")
            stop = len(keys) if k == len(sizes) - 1 else int(np.searchsorted(keys, held[-1]))
            here = np.searchsorted(held, keys[done:stop])
            at[done:stop] = starts[k] + here
            before[done:stop] = np.where(here > 0, held[here - 1], last)
            inside = here < size
            after[done:stop][inside] = held[here[inside]]
            done, last = stop, held[-1]
        joined = np.flatnonzero(at[1:] == at[:-1])
        before[joined + 1] = keys[joined]
        ahead = after.copy()
        ahead[joined] = keys[joined + 1]
        # 2: common prefixes with both neighbours; of those between old and old nothing changes
        lone = np.ones(len(keys), bool)
        lone[joined] = False
        down = np.zeros(len(keys), np.uint8)
        up, down[lone] = np.split(self._common(np.concatenate([before, keys[lone]]), np.concatenate([keys, ahead[lone]]), starts), [len(keys)])
        # 3: merge; every place moves up by the number of suffixes put before it
        new_place = at + np.arange(len(keys))
        moved_tail = tail + np.searchsorted(at, tail, side="right")
        new_keys = symbol.astype(np.int64) * _HALF + moved_tail
        who = ids << np.int64(8) | (self.lengths[ids] - turn)
        by_tail = np.argsort(tail, kind="stable")
        done = 0
        for k, size in enumerate(sizes):
            lo = starts[k]
            stop = len(at) if k == len(sizes) - 1 else int(np.searchsorted(at, lo + size))
            new = slice(done, stop)
            count = stop - done
            mask = np.ones(size + count, bool)
            where = at[new] - lo + np.arange(count)
            mask[where] = False
            old = np.flatnonzero(mask)
            out = {c: np.empty(size + count, t) for c, t in COLUMNS.items()}
            held = store.read(k, "key").copy()
            real = int(np.searchsorted(held, (LOWEST + 1) * _HALF))
            if real < size:
                tails = held[real:] & np.int64(0xFFFFFFFF)
                # a suffix moves up by the number of places, which are sorted, not behind its own
                held[real:] += np.searchsorted(at, tails, side="right")
            bwt = store.read(k, "bwt").copy()
            a, b = np.searchsorted(tail[by_tail], [lo, lo + size])
            of = by_tail[a:b]
            bwt[tail[of] - lo] = symbol[of]
            lcp = store.read(k, "lcp").copy()
            follows = lone[new] & (at[new] - lo < size)
            lcp[(at[new] - lo)[follows]] = down[new][follows]
            # a lone suffix at this chunk's end is followed by the next chunk's first entry
            if done and k and lone[done - 1] and at[done - 1] == lo:
                lcp[0] = down[done - 1]
            for column, values, fresh in (("key", held, new_keys[new]), ("lcp", lcp, up[new]), ("who", store.read(k, "who"), who[new]), ("bwt", bwt, np.full(count, LOWEST, np.int32))):
                out[column][old] = values
                out[column][where] = fresh
            store.write(out, self.chunk)
            done = stop
        store.turn()
        self.place[ids] = new_place

    def _common(self, first: np.ndarray, second: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Common prefix lengths of neighbours, given by their keys in the numbering before this round."""
        out = np.zeros(len(first), np.uint8)
        a, b = first >> np.int64(32), second >> np.int64(32)
        same = np.flatnonzero((a == b) & (a != LOWEST) & (second != np.iinfo(np.int64).max))
        if not len(same):
            return out
        lo, hi = (first[same] & np.int64(0xFFFFFFFF)) + 1, second[same] & np.int64(0xFFFFFFFF)
        chunk_lo, chunk_hi = (np.searchsorted(starts, v, side="right") - 1 for v in (lo, hi))
        least = np.full(len(same), 255, np.uint8)
        minima = np.full(len(starts) - 1, 255, np.uint8)
        for k in range(len(starts) - 1):
            values = self.store.read(k, "lcp")
            minima[k] = values.min()
            inside = np.flatnonzero((chunk_lo == k) | (chunk_hi == k))
            if len(inside):
                x = np.where(chunk_lo[inside] == k, lo[inside] - starts[k], 0)
                y = np.where(chunk_hi[inside] == k, hi[inside] - starts[k], len(values) - 1)
                single = x == y
                got = np.empty(len(inside), np.uint8)
                got[single] = values[x[single]]
                if not single.all():
                    got[~single] = range_min(values, _block_minima(values), x[~single], y[~single])
                least[inside] = np.minimum(least[inside], got)
        np.minimum(least, _between(_doubling(minima), chunk_lo + 1, chunk_hi), out=least)
        out[same] = least + np.uint8(1)
        return out

    def entries(self) -> Iterator[dict[str, np.ndarray]]:
        """The suffixes in order: ``who`` is string << 8 | offset, ``lcp`` the common prefix with the one before."""
        for k in range(len(self.store.sizes)):
            yield {c: self.store.read(k, c) for c in COLUMNS}

    def close(self) -> None:
        self.store.close()

    def repeats(self, length: int) -> np.ndarray:
        """``who`` of every suffix that shares ``length`` symbols with one of a lesser ``who``."""
        found: list[np.ndarray] = []
        group: list[np.ndarray] = []  # of the group that the last chunk ends in

        def close() -> None:
            if group:
                all_ = np.concatenate(group)
                if len(all_) > 1:
                    found.append(np.delete(all_, int(all_.argmin())))
                group.clear()

        for e in self.entries():
            who, goes_on = e["who"], e["lcp"] >= length
            heads = np.flatnonzero(~goes_on)
            if not len(heads):
                group.append(who)
                continue
            if heads[0]:
                group.append(who[: heads[0]])
            close()
            body = slice(heads[0], heads[-1])
            cuts = heads[:-1] - heads[0]
            if len(cuts):
                inner = who[body]
                sizes = np.diff(np.append(cuts, len(inner)))
                least = np.repeat(np.minimum.reduceat(inner, cuts), sizes)
                found.append(inner[inner != least])
            group.append(who[heads[-1] :])
        close()
        return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)

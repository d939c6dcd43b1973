"""Order MinHash against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parchmill.llm import omh

from .conftest import prose, row, SCHEMA


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


words = st.lists(st.integers(0, 3), max_size=14)


@given(st.lists(st.tuples(words, words), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_alignment_is_exact(pairs):
    arrays = [(np.array(a, np.int32), np.array(b, np.int32)) for a, b in pairs]
    wide = omh.distances(arrays, 15)
    assert wide.tolist() == [distance(a, b) for a, b in pairs]
    for band in (1, 3):
        narrow = omh.distances(arrays, band)
        for d, (a, b) in zip(narrow.tolist(), pairs, strict=True):
            true = distance(a, b)
            assert d >= true and (true > band or d == true)
    for s, (a, b) in zip(omh.similarities(arrays, 0.5).tolist(), pairs, strict=True):
        longer = max(len(a), len(b))
        if longer:
            true = 1 - distance(a, b) / longer
            assert s == pytest.approx(true) if true >= 0.5 else s == -1 or (s >= 0.5 and s <= true + 1e-9)


def test_sketch_keeps_order():
    """Reversing the order of the words changes the sketch, though the set of words stays."""
    a = omh.sketch(*omh.kmers(np.arange(1, 400, dtype=np.uint64), np.array([0, 399]), 1))
    b = omh.sketch(*omh.kmers(np.arange(1, 400, dtype=np.uint64)[::-1].copy(), np.array([0, 399]), 1))
    assert (a != b).all()
    same = omh.kmers(np.array([5, 5, 5, 5], np.uint64), np.array([0, 4]), 1)[0]
    assert len(set(same.tolist())) == 4  # occurrences are told apart


def groups(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_against_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rng = np.random.default_rng(0)
    for n, (i, t) in enumerate(rows[:40]):  # near copies of known distance
        w = t.split(" ")
        for k in rng.integers(0, len(w), max(1, len(w) // 12)):
            w[k] = f"new{k}"
        rows.append((10_000 + n, " ".join(w)))
    values, offsets = omh.folded_words([t.encode() for _, t in rows])
    short = [(values[a:b] >> np.uint64(32)).astype(np.uint32).view(np.int32) for a, b in zip(offsets, offsets[1:], strict=False)]
    every = [(i, j) for i in range(len(rows)) for j in range(i) if len(short[i]) and len(short[j]) and min(len(short[i]), len(short[j])) >= 0.8 * max(len(short[i]), len(short[j]))]
    sims = omh.similarities([(short[i], short[j]) for i, j in every])
    pairs = [(rows[i][0], rows[j][0]) for (i, j), s in zip(every, sims, strict=True) if s >= 0]
    assert len(pairs) > 40
    got = {r["doc_id"]: r["kept_id"] for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    kept = lambda i: got.get(i, i)
    assert np.mean([kept(a) == kept(b) for a, b in pairs]) >= 0.97
    true = groups(pairs, [i for i, _ in rows])
    assert all(true[i] == true[k] for i, k in got.items())  # nothing else is taken for a copy


def test_odd_rows(spark, odd, none):
    got = {r["doc_id"]: (r["kept_id"], r["partner_id"], r["similarity"]) for r in omh.near_duplicates(odd).collect()}
    assert got[6] == (1, 1, 1.0) and got[12][0] == 1 and 0.8 <= got[12][2] < 1 and set(got) == {6, 12}
    assert omh.near_duplicates(none).count() == 0 and omh.without_copies(none).columns == none.columns
    left = omh.without_copies(odd)
    assert left.columns == odd.columns
    ids = sorted((r["doc_id"] for r in left.collect()), key=lambda x: (x is not None, x))
    assert ids == [None, None, None, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11]


def test_big_group_and_chain(spark):
    """Hundreds of copies, each different, and a chain whose ends are unlike."""
    base = prose(9, 200).split(" ")
    rows = []
    for i in range(300):
        w = list(base)
        w[i % 200] = f"mark{i}"
        rows.append(row(i, " ".join(w)))
    chain = prose(10, 200).split(" ")
    for i in range(5):
        for k in range(i * 25, (i + 1) * 25):
            chain[k] = f"link{i}x{k}"
        rows.append(row(1000 + i, " ".join(chain)))
    got = {r["doc_id"]: r["kept_id"] for r in omh.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(range(1, 300)) == {i for i, k in got.items() if k == 0}
    assert {i for i, k in got.items() if k == 1000} == {1001, 1002, 1003, 1004}


def test_copies_near_the_last_only(spark):
    """Copies near their original, which has the last id, but not near each other."""
    rng = np.random.default_rng(11)
    base = prose(11, 200).split(" ")
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(200, 28, replace=False):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    rows.append((60, " ".join(base)))
    got = {r["doc_id"]: r["kept_id"] for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got.get(i, i) == got[60] for i in range(61)) >= 58


@pytest.mark.parametrize("share", [0.8, 0.85])
@pytest.mark.parametrize("size", [20, 50, 200])
def test_pairs_near_the_threshold_are_proposed(share, size):
    """Single pairs just above the threshold share the sketches that a pair needs."""
    rng = np.random.default_rng(size)
    found = []
    for _ in range(200):
        a = rng.integers(1, 1 << 62, size).astype(np.uint64)
        b = a.copy()
        b[rng.choice(size, round((1 - share) * size), replace=False)] += np.uint64(1)
        s = omh.sketch(*omh.kmers(np.concatenate([a, b]), np.array([0, size, 2 * size])))
        bag = omh.bags(np.concatenate([a, b]), np.array([0, size, 2 * size]))
        found.append((s[0] == s[1]).any() and omh.overlaps(bag[0], bag[1:])[0] >= omh.OVERLAP)
    assert np.mean(found) >= 0.88


def test_overlap_estimate():
    """Bags against the overlap counted over occurrence-labelled words, with repeated words and texts of any length."""
    rng = np.random.default_rng(5)
    texts = []
    for size in (1, 3, 30, 400, 5000):
        a = rng.integers(1, max(2, size // 2), size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        b = a.copy()
        gone = rng.choice(size, size // 4, replace=False)
        b[gone] = rng.integers(1 << 40, 1 << 50, len(gone)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        texts += [a, b]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    bags = omh.bags(np.concatenate(texts), offsets)

    def labelled(t):
        seen = {}
        return {(w, seen.setdefault(w, []).append(1) or len(seen[w])) for w in t.tolist()}

    for k in range(0, len(texts), 2):
        one, two = labelled(texts[k]), labelled(texts[k + 1])
        assert omh.overlaps(bags[k], bags[k + 1 :])[0] == pytest.approx(len(one & two) / len(one | two), abs=0.13)
        assert omh.overlaps(bags[k], bags[k : k + 1])[0] == 1.0
        assert (omh.bags(texts[k], np.array([0, len(texts[k])])) == bags[k]).all()  # whatever else is in the batch
    assert omh.bags(np.empty(0, np.uint64), np.zeros(1, int)).shape == (0, omh.BINS)


def test_long_texts_keep_their_places(monkeypatch):
    """Texts of more k-mers than the short position counts get the sketches of wide positions."""
    values = np.random.default_rng(2).integers(1, 1 << 62, 3000).astype(np.uint64)
    parts = np.array([0, 2000, 2600, 3000])
    wide = omh.sketch(*omh.kmers(values, parts))
    monkeypatch.setattr(omh, "PLACE_BITS", 10)
    assert (omh.sketch(*omh.kmers(values, parts)) == wide).all()


def test_blocks_of_a_bucket(spark, monkeypatch):
    """A bucket larger than a block: groups whose members fall into different blocks, and texts that only share a passage."""
    monkeypatch.setattr(omh, "BLOCK", 16)
    shared = prose(20, 60)
    rows, truth = [], {}
    for group in range(12):
        base = prose(100 + group, 140).split(" ")
        for i in range(8):
            w = list(base)
            w[(7 * i) % 140] = f"own{i}"
            rows.append((group * 8 + i, shared + " " + " ".join(w)))
            truth[group * 8 + i] = group * 8
    got = {r["doc_id"]: r["kept_id"] for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: got.get(i, i) for i in truth} == truth

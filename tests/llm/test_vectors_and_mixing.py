"""Nearest neighbours and near-dedup of vectors, the cube method, and the pipeline."""

import base64
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parchmill.llm import bpe, langid, mih, mixing, omh, pii, polytope
from parchmill.sources.scratch import scratch_folder

from .conftest import SF, SCHEMA, prose, row

SHAPE = "vec_id bigint, embedding array<float>, label int, id int, v string, h string, code string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "v", "h", "c") for i, v in vectors], SHAPE).repartition(3)


def clustered(seed=0, n=700, d=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    copies = base[:60] + rng.normal(scale=0.1, size=(60, d))
    many = base[0] + rng.normal(scale=0.05, size=(150, d))
    return np.concatenate([base, copies, many, base[5:8]]).astype(np.float32)


ODD = [
    (5001, None), (5002, []), (5003, [0.0] * 64), (5004, [float("nan")] * 64), (5005, [None] + [1.0] * 63), (None, [1.0] * 64),
    (5006, [1.0, 2.0]), (5007, [1.0, 2.1]), (5008, [float("inf")] * 64), (5009, [3.0]), (5006, [1.0, 2.0]),
]


def cosines(x):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s


def test_nearest(spark):
    x = clustered()
    got = {}
    for r in mih.neighbours(table(spark, list(enumerate(x.tolist())) + ODD)).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbor_id"], r["similarity"]))
    s = cosines(x)
    recall = []
    for i in range(len(x)):
        mine = sorted(got[i])
        assert [m[0] for m in mine] == list(range(1, 11)) and len({m[1] for m in mine}) == 10 and i not in {m[1] for m in mine}
        assert [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        assert all(m[2] == pytest.approx(s[i, m[1]], abs=2e-6) for m in mine)
        least = np.sort(s[i])[-10] - 1e-6
        recall.append(sum(s[i, m[1]] >= least for m in mine) / 10)
    assert np.mean(recall) >= 0.97 and min(recall) >= 0.5
    assert {i for i in got if i >= 5000} == {5006, 5007} and got[5006] == [(1, 5007, got[5006][0][2])]


def test_nearest_with_a_large_common_mean(spark):
    """Clusters whose mean pairwise cosine is about 0.8."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(60, 64)), 25, axis=0) + rng.normal(scale=0.5, size=(1500, 64))
    x = (x + 2.2 * 8 * np.linalg.qr(rng.normal(size=(64, 1)))[0].T).astype(np.float32)
    s = cosines(x)
    assert s[s > -2].mean() > 0.75
    got = {}
    for r in mih.neighbours(table(spark, list(enumerate(x.tolist())))).collect():
        got.setdefault(r["vec_id"], []).append(r["neighbor_id"])
    least = np.sort(s, axis=1)[:, -10] - 1e-6
    assert np.mean([sum(s[i, j] >= least[i] for j in got[i]) / 10 for i in range(len(x))]) >= 0.97


def test_nearest_of_equal_vectors_against_sql(spark, tmp_path):
    """Groups of two to hundreds of equal vectors, beside distinct ones."""
    import duckdb

    rng = np.random.default_rng(8)
    base = rng.normal(size=(120, 16)).astype(np.float32)
    x = np.concatenate([base, np.repeat(base[:1], 400, axis=0), np.repeat(base[1:4], 12, axis=0), base[10:20]])
    rng.shuffle(x)
    df = table(spark, list(enumerate(x.tolist())))
    df.write.parquet(f"{tmp_path}/embeddings")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings/*.parquet'")
    got = sorted((r["vec_id"], r["rank"], r["neighbor_id"], r["similarity"]) for r in mih.neighbours(df).collect())
    assert got == sorted((v, rank, n, s) for v, n, rank, s in con.execute(mih.oracle(1)).fetchall())
    got = sorted((r["vec_id"], r["rank"], r["neighbor_id"], r["similarity"]) for r in mih.neighbours(df, step=mih.STEP).collect())
    assert got == sorted((v, rank, n, s) for v, n, rank, s in con.execute(mih.ORACLE).fetchall())


def test_nearest_needs_disk_in_proportion(spark, tmp_path):
    """Shuffled and written: a few times the vectors, however many blocks there are; each query's list is the exact one."""
    x = np.random.default_rng(12).normal(size=(20_000, 32)).astype(np.float32)
    x[5000:5040] = x[0] + np.random.default_rng(13).normal(scale=0.05, size=(40, 32))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}), f"{tmp_path}/embeddings.parquet")
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [Path(str(f)) for f in local] + [Path(scratch_folder(spark, "test").removeprefix("file://")).parent]
    used = lambda: sum(f.stat().st_size for at in folders for f in at.rglob("*") if f.is_file())
    before = used()
    got = {}
    for r in mih.query(spark, str(tmp_path)).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = r["neighbor_id"]
    assert used() - before < 4 * x.nbytes
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    assert sorted(got) == list(range(0, len(x), mih.STEP))
    for i, mine in got.items():
        s = np.round(u @ u[i], 6)
        s[i] = -2
        assert [mine[n] for n in range(1, 11)] == np.lexsort((np.arange(len(x)), -s))[:10].tolist()


def test_more_equal_vectors_than_are_indexed(spark):
    """Every query of a group of equal vectors lists those of the least ids, whether it is indexed itself or not; other vectors list them too."""
    x = np.random.default_rng(14).normal(size=(300, 16)).astype(np.float32)
    x[100:200] = x[100]
    x[200:211] = x[200]
    got = {}
    for r in mih.neighbours(table(spark, list(enumerate(x.tolist()))), step=5).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = (r["neighbor_id"], r["similarity"])
    s = np.round(cosines(x), 6)
    assert sorted(got) == list(range(0, 300, 5))
    for i, mine in got.items():
        best = np.lexsort((np.arange(300), -s[i]))[:10]
        assert [mine[n][0] for n in range(1, 11)] == best.tolist() and [mine[n][1] for n in range(1, 11)] == pytest.approx(s[i, best], abs=2e-6)


def test_steps_and_blocks_leave_the_result_alone():
    """Tiny steps, ties across them, fewer answers than places: as sorting everything."""
    rng = np.random.default_rng(15)
    v = rng.integers(-1, 2, size=(400, 4)).astype(np.float32)
    v = v[np.abs(v).sum(1) > 0]
    ids = rng.permutation(len(v)).astype(np.int64)
    for k, n in ((10, len(v)), (10, 8), (3, 5)):
        best = mih._Best(ids[:60], v[:60], k)
        mih._scan(best, ((ids[a : min(a + 37, n)], v[a : min(a + 37, n)]) for a in range(0, n, 37)))
        s = np.round(cosines(v), 6)
        rows = best.rows()
        got = list(zip(*(rows.column(c).to_pylist() for c in range(3)), strict=True))
        want = [(ids[i], ids[j], s[i, j]) for i in range(60) for j in np.lexsort((ids[:n], -s[i, :n])) if j != i]
        seen = Counter()
        want = [w for w in want if seen.update([w[0]]) or seen[w[0]] <= k]
        assert got == want


def test_buckets_hold_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    codes = np.concatenate([codes, codes ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64))])
    for count in (500, 50_000, 10**9):
        cut = mih.pieces(64, count)
        assert sum(n for _, n in cut) == 64
        keys = np.stack([(codes >> np.uint64(a)) & np.uint64((1 << n) - 1) for a, n in cut], 1)
        near = np.bitwise_count(codes[:, None] ^ codes) <= len(cut) - 1
        assert (near <= (keys[:, None] == keys).any(2)).all()


def test_rotation_lowers_the_loss(spark):
    """The learned rotation quantises better than none, and comes from all rows."""
    x = clustered(3)
    df = table(spark, list(enumerate(x.tolist()))).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    coder = mih.learn(df, 64, len(x))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(coder.mean, u.mean(0), atol=1e-5)
    y = coder.project(u)
    axes = np.linalg.eigh(np.cov((u - u.mean(0)).T))[1]
    flat = (u - u.mean(0)) @ axes
    loss = lambda v: float(((v - np.sign(v) * np.abs(v).mean()) ** 2).sum())
    assert loss(y) < loss(flat)
    assert np.allclose(coder.turn.T @ coder.turn, np.eye(64), atol=1e-4)


def test_near_vectors(spark):
    x = clustered(4)
    got = {r["vec_id"]: r for r in polytope.near_duplicates(table(spark, list(enumerate(x.tolist())) + ODD)).collect()}
    s = cosines(x)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(s >= polytope.THRESHOLD)), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    true = {i: find(i) for i in range(len(x)) if find(i) != i}
    mine = {i: r["kept_id"] for i, r in got.items() if i < 5000}
    assert len(true) > 200 and np.mean([mine.get(i) == k for i, k in true.items()]) >= 0.97
    assert set(mine) <= set(true)
    assert all(s[i, r["kept_id"]] == pytest.approx(r["similarity"], abs=2e-6) for i, r in got.items() if i < 5000)
    assert {i: r["kept_id"] for i, r in got.items() if i >= 5000} == {5007: 5006}


@pytest.mark.parametrize("block", [polytope.BLOCK, 64])
def test_near_vectors_against_sql(spark, tmp_path, monkeypatch, block):
    """Planted groups, thousands of equal vectors among them, against the exact SQL; also with buckets larger than a block."""
    import duckdb

    monkeypatch.setattr(polytope, "BLOCK", block)
    rng = np.random.default_rng(21)
    base = rng.normal(size=(400, 32))
    near = np.repeat(base[:40], 4, axis=0) + rng.normal(scale=0.12, size=(160, 32))  # cosines around 0.99
    large = base[50] + rng.normal(scale=0.1, size=(300, 32))
    far = base[60:120] + rng.normal(scale=0.5, size=(60, 32))  # around 0.89: no copies
    x = np.concatenate([base, near, large, far, np.repeat(base[200:201], 3000, axis=0), base[201:204] * 2]).astype(np.float32)
    rng.shuffle(x)
    df = table(spark, list(enumerate(x.tolist())) + ODD[:9] + ODD[10:])
    df.write.parquet(f"{tmp_path}/embeddings")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(polytope.ORACLE).fetchall()}
    got = {r["vec_id"]: (r["kept_id"], r["similarity"]) for r in polytope.near_duplicates(df).collect()}
    assert len(want) > 3300 and set(got) <= set(want)
    assert np.mean([got.get(i) == v for i, v in want.items()]) >= 0.99


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 48)).astype(np.float32)
    assert np.allclose(np.linalg.norm(polytope.turned(x, 1), axis=1), np.linalg.norm(x, axis=1), rtol=1e-4)


def test_bucket_edges_connect_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x = rng.normal(size=(40, 3))
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        u, v = polytope.bucket_edges(np.arange(40), x)
        assert ((x[u] * x[v]).sum(1) >= polytope.THRESHOLD - 1e-6).all()
        root = list(range(40))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in zip(u, v, strict=True):
            root[find(a)] = find(b)
        s = x.astype(np.float64) @ x.T.astype(np.float64)
        assert all(find(a) == find(b) for a, b in zip(*np.nonzero(s >= polytope.THRESHOLD + 1e-6), strict=True))


def test_empty_vectors(spark):
    for df in (table(spark, [(1, [1.0])]).limit(0), table(spark, ODD[:6])):
        assert mih.neighbours(df).count() == 0 and polytope.near_duplicates(df).count() == 0


# mixing ----------------------------------------------------------------------


def test_flight_balances():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 400):
        x, t = rng.random(n), rng.integers(0, 5, n).astype(float) * rng.integers(0, 300, n)
        y = mixing.flight(x, t, rng)
        open_ = (y > 1e-9) & (y < 1 - 1e-9)
        assert open_.sum() <= 2 and y.min() >= -1e-9 and y.max() <= 1 + 1e-9
        assert y.sum() == pytest.approx(x.sum(), abs=1e-6) and y @ t == pytest.approx(x @ t, abs=1e-4 * max(1, t.max()))
        z = mixing.land(y, rng)
        assert set(np.unique(z)) <= {0.0, 1.0} and abs(z.sum() - x.sum()) < 1


def test_landing_keeps_probabilities():
    """Flight and landing together: one, two and several documents, equal and unequal, alone or with large ones."""
    rng = np.random.default_rng(3)
    for x, t in (([0.2], [5]), ([0.45], [900]), ([0.6], [1]), ([0.3, 0.3], [10, 900]), ([0.7, 0.8], [3, 3]), ([0.1, 0.5, 0.5, 0.9], [1, 50, 900, 2])):
        x, t = np.array(x, float), np.array(t, float)
        mean = np.mean([mixing.land(mixing.flight(x, t, rng), rng) for _ in range(8000)], axis=0)
        assert np.abs(mean - x).max() < 0.03


def test_flight_keeps_probabilities():
    """Over many draws every unit comes out as often as its probability says."""
    x = np.array([0.1, 0.3, 0.5, 0.7, 0.9, 0.25, 0.45, 0.8])
    t = np.array([5.0, 1, 9, 4, 4, 2, 7, 3])
    rng = np.random.default_rng(1)
    mean = np.mean([mixing.flight(x, t, rng) for _ in range(6000)], axis=0)
    assert np.abs(mean - x).max() < 0.03


def brute_rates(stats, temper=mixing.TEMPER):
    """Water-filling by bisection over rows (source, documents, tokens)."""
    held = [t for _, _, t in stats if t > 0]
    if not held:
        return {s: 1.0 for s, _, _ in stats}
    kept = lambda x: sum(min(t, x * t**temper) for t in held)
    lo = min(t ** (1 - temper) for t in held)
    if kept(lo) < mixing.KEEP * sum(held):
        hi = max(t ** (1 - temper) for t in held)
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if kept(mid) < mixing.KEEP * sum(held) else (lo, mid)
    return {s: min(1.0, lo * t ** (temper - 1)) if t > 0 else 1.0 for s, _, t in stats}


@pytest.mark.parametrize(
    "stats",
    [
        [],
        [("a", 2, 0)],
        [("a", 10, 1000), ("b", 10, 100), (None, 3, 0)],
        [("a", 9, 5 * 10**9), ("b", 9, 10**8), ("c", 1, 12)],
        [(f"s{k}", 1, 1 + k % 7) for k in range(300)] + [("a", 9, 10**7)],
    ],
)
def test_rates(spark, stats):
    """The scale against bisection; a tiny source does not set the volume."""
    by = mixing.scale(spark.createDataFrame(stats, "source string, n long, t long"))
    got = {s: min(1.0, by * t ** (mixing.TEMPER - 1)) if t > 0 else 1.0 for s, _, t in stats}
    assert got == pytest.approx(brute_rates(stats), rel=1e-6)


@pytest.mark.parametrize("group", [mixing.GROUP, 40])
def test_mixture_hits_its_targets(spark, group):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)))
    got = mixing.sample(docs, group=group)
    drawn = {r["source"]: r for r in got.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.max("rate").alias("rate")).collect()}
    size = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    whole = {r["source"]: r for r in docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(size).alias("t"), F.max(size).alias("most")).collect()}
    true = brute_rates([(s, w["n"], w["t"]) for s, w in whole.items()])
    for s, w in whole.items():
        assert drawn[s]["rate"] == pytest.approx(true[s], abs=1e-6)
        assert abs(drawn[s]["n"] - drawn[s]["rate"] * w["n"]) <= 2
        # what the flights leave of a source is two documents; a long one must be left out as often as its rate says
        assert abs(drawn[s]["t"] - drawn[s]["rate"] * w["t"]) <= 2 * w["most"]
    assert abs(drawn["hot"]["t"] - drawn["hot"]["rate"] * whole["hot"]["t"]) <= 0.03 * whole["hot"]["t"]
    assert abs(sum(r["n"] for r in drawn.values()) - sum(true[s] * w["n"] for s, w in whole.items())) < 2
    assert max(r["rate"] for r in drawn.values()) == 1.0 and drawn["hot"]["rate"] < 0.9
    again = mixing.sample(docs.repartition(7), group=group)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in again.collect())


def test_many_small_sources_end(spark, monkeypatch):
    """Many more sources than a group holds, of one document each: the rounds end, and the totals are kept across sources."""
    turns = []
    real = mixing.materialize

    def counted(df, tag):
        turns.append(tag)
        assert len(turns) < 12, "never ends"
        return real(df, tag)

    monkeypatch.setattr(mixing, "materialize", counted)
    monkeypatch.setattr(mixing, "KEEP", 0.0)
    rows = [row(i, "a b c " * (2 + i % 3), source=f"s{i}") for i in range(600)] + [row(1000 + i, "d e " * (1 + i % 9), source="hot") for i in range(400)] + [row(5000, "x", source="tiny")]
    got = mixing.sample(spark.createDataFrame(rows, SCHEMA), group=15).collect()
    hot = [r for r in got if r["source"] == "hot"]
    assert abs(len(hot) - 400 * hot[0]["rate"]) <= 2 and len({r["doc_id"] for r in got}) == len(got)
    small = [r for r in got if r["doc_id"] < 1000]
    rate = {6 + 3 * k: 1 / (6.0 + 3 * k) ** 0.3 for k in range(3)}  # the source of one token sets the scale
    assert all(r["rate"] == pytest.approx(rate[r["n_tokens"]], abs=1e-6) for r in small)
    assert abs(len(small) - sum(200 * v for v in rate.values())) <= 3


def test_sample_keeps_probabilities(spark):
    """Over many seeds each document is drawn as often as its rate says, of sources of one and two documents too."""
    rows = [row(1, "a " * 9, source="one"), row(2, "b " * 30, source="two"), row(3, "c " * 2, source="two")] + [row(10 + i, "d " * (1 + i), source="ten") for i in range(10)] + [row(50, "x", source="tiny")]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    rates = {r["doc_id"]: r["rate"] for r in mixing.sample(docs).collect()}
    t = np.array([9.0, 30, 2, *range(1, 11), 1])
    source = np.array([0, 1, 1, *[2] * 10, 3])
    totals = np.bincount(source, t)
    by = brute_rates([(s, 0, v) for s, v in enumerate(totals)])
    x = np.array([by[s] for s in source])
    assert all(v == pytest.approx(x[[1, 2, 3, *range(10, 20), 50].index(i)], abs=1e-6) for i, v in rates.items())
    # the worker itself, as `sample` runs it: flights within sources, then all together and the landing
    import pyarrow as pa

    names = ["g", "x", "t", "k"]
    count, seeds = np.zeros(len(x)), 2000
    for seed in range(seeds):
        y = x
        for last, g in ((False, source), (True, np.zeros(len(x)))):
            open_ = np.flatnonzero((y > 0) & (y < 1))
            batch = pa.RecordBatch.from_arrays([pa.array(g[open_].astype(np.int64)), pa.array(y[open_]), pa.array(t[open_].astype(np.int64)), pa.array(open_ + 77)], names=names)
            done = np.concatenate([b.column("x").to_numpy() for b in mixing._fly(seed + 5000 * last, last)(iter([batch]))])
            y = y.copy()
            y[open_] = done
        count += y
    assert np.abs(count / seeds - x).max() < 0.03


def test_mixing_odd_rows(spark, odd, none, odd_rows):
    got = mixing.sample(odd).collect()
    assert len(got) <= len(odd_rows) and {r["source"] for r in got} == {"s0", None}
    kept = mixing.drawn(odd)
    assert kept.columns == odd.columns and kept.count() == len(got)
    assert mixing.sample(none).count() == 0 and mixing.drawn(none).count() == 0
    twice = spark.createDataFrame([row(1, "a b c")] * 40 + [row(2, "d e f", source="rare")] * 3, SCHEMA)
    assert mixing.drawn(twice).count() == mixing.sample(twice).count() < 43


# the pipeline ------------------------------------------------------------------


def edit_similarity(a, b):
    """1 - edit distance / longer, of word lists: one row after another, each in array operations."""
    ids = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([ids[w] for w in b])
    row = np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (y != ids[w]))
        new = np.concatenate(([i], step))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return 1 - row[-1] / max(len(a), len(b))


def brute_copies(rows):
    """Ids that are not the least of their group of texts of edit similarity 0.8, by comparing all pairs."""
    words = {i: [w for w in (x.strip(omh._EDGES).casefold() for x in t.split()) if w] for i, t in rows}
    ids = sorted(i for i, w in words.items() if w)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = {i: Counter(words[i]) for i in ids}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            longer = max(len(words[i]), len(words[j]))
            if min(len(words[i]), len(words[j])) >= 0.8 * longer and (bags[i] & bags[j]).total() >= 0.8 * longer and edit_similarity(words[i], words[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) != i}


def test_pipeline_by_hand(spark, documents):
    """Each stage against plain Python: the network row by row, all pairs for copies, redaction, the mixture's targets, the public encoder."""
    import tiktoken

    docs = documents
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_copies", "personal_data", "mixture", "tokens"]
    before = {r["doc_id"]: r for r in docs.collect()}
    one = stages["language"](spark, docs, SF)
    assert one.columns == docs.columns
    model = langid.fit(docs)
    accepted = {i for i, r in before.items() if langid._verdicts(model, [r["text"].encode()])[2][0]}
    first = {r["doc_id"]: r for r in one.collect()}
    assert set(first) == accepted and all(first[i] == before[i] for i in first)
    two = stages["near_copies"](spark, one, SF)
    second = {r["doc_id"]: r for r in two.collect()}
    copies = brute_copies([(i, before[i]["text"]) for i in accepted])
    gone = accepted - set(second)
    assert two.columns == docs.columns and all(second[i] == before[i] for i in second)
    assert copies and gone <= copies and len(gone) >= 0.9 * len(copies)
    three = stages["personal_data"](spark, two, SF)
    third = {r["doc_id"]: r for r in three.collect()}
    assert three.columns == docs.columns and set(third) == set(second)
    for i, r in third.items():
        assert r["text"] == pii.redact(before[i]["text"]) and r["n_chars"] == (before[i]["n_chars"] if r["text"] == before[i]["text"] else len(r["text"]))
    four = stages["mixture"](spark, three, SF)
    fourth = {r["doc_id"]: r for r in four.collect()}
    assert four.columns == docs.columns and set(fourth) <= set(third) and all(fourth[i] == third[i] for i in fourth)
    tokens = {i: len(r["text"].split()) for i, r in third.items()}
    of = {}
    for i, r in third.items():
        of.setdefault(r["source"], []).append(i)
    rates = brute_rates([(s, len(ids), sum(tokens[i] for i in ids)) for s, ids in of.items()])
    for s, ids in of.items():
        drawn = [i for i in ids if i in fourth]
        assert abs(len(drawn) - rates[s] * len(ids)) <= 2
        assert abs(sum(tokens[i] for i in drawn) - rates[s] * sum(tokens[i] for i in ids)) <= 2 * max(tokens[i] for i in ids)
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    public = tiktoken.Encoding("public", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(fourth)
    assert all(r["token_ids"] == public.encode_ordinary(third[r["doc_id"]]["text"]) and r["round_trip"] for r in rows)


def test_pipeline_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF)
            if name != "tokens":
                assert after.columns == docs.columns
            after.collect()
    chained = spark.createDataFrame([row(i, prose(i, 60)) for i in range(30)] + [row(None, None, None, None)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        chained = stage(spark, chained, SF)
    assert chained.count() > 0

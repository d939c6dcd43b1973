"""Vector collections and stores."""

import math

import pytest
from pyspark.sql import functions as F

from parchmill.operators import vector
from parchmill.operators.stores import ConnectionFailed, GraphConfig, GraphStore, TransactionFailed, VectorConfig, VectorStore

POINTS = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0])]


@pytest.fixture
def points(spark):
    return spark.createDataFrame(POINTS, "id bigint, vector array<float>")


def reference(metric, a, b):
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    if metric == "dot":
        return dot
    if metric == "cosine":
        n = math.hypot(*a) * math.hypot(*b)
        return dot / n if n else None
    diff = [abs(x - y) for x, y in zip(a, b, strict=True)]
    return math.hypot(*diff) if metric == "euclid" else sum(diff)


@pytest.mark.parametrize("metric", vector.METRICS)
def test_top_k(points, metric):
    q = [1.0, 0.25]
    scored = [(s, i) for i, v in POINTS if (s := reference(metric, v, q)) is not None]
    scored.sort(key=lambda x: (-x[0] if metric in ("cosine", "dot") else x[0], x[1]))
    got = vector.top_k(points, q, 3, metric)
    assert [r["id"] for r in got.collect()] == [i for _, i in scored[:3]]
    assert [r["score"] for r in got.collect()] == pytest.approx([s for s, _ in scored[:3]])
    assert vector.top_k(points, q, 0, metric).count() == 0


def test_top_k_plan(points, capsys):
    vector.top_k(points, [1.0, 0.0], 2).explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "Join" not in plan


def test_dimension(points):
    with pytest.raises(vector.DimensionMismatch, match="expected vector dimension 2, got 3"):
        vector.top_k(points, [1.0, 2.0, 3.0], 1, dimension=2)
    with pytest.raises(ValueError, match="unknown metric"):
        vector.top_k(points, [1.0, 2.0], 1, "hamming")
    errors = points.select(vector.dimension_error(F.when(F.col("id") > 4, F.lit(None)).otherwise(F.col("vector")), 2).alias("e")).where("e is not null").collect()
    assert [r["e"] for r in errors] == ["expected vector dimension 2, got 0"]


def test_upsert_last_wins(spark, points):
    new = spark.createDataFrame([(1, [9.0], 1), (1, [8.0], 2), (7, [7.0], 1)], "id bigint, vector array<float>, v int")
    got = {r["id"]: r["vector"] for r in vector.upsert(points, new, F.col("v")).collect()}
    assert got[1] == [8.0] and got[7] == [7.0] and got[2] == [0.0, 1.0] and len(got) == 6


def test_vector_store(spark, tmp_path):
    config = VectorConfig(f"file://{tmp_path}", "c", 2, api_key="hidden")
    assert "hidden" not in repr(config)
    closed = VectorStore(spark, config)
    assert not hasattr(closed, "query")
    store = closed.connect()
    assert store.points().count() == 0
    store.upsert_point(1, [1.0, 0.0], {"a": "x"})
    store.upsert_points(spark.createDataFrame([(1, [0.0, 1.0], {"a": "y"}), (2, [1.0, 0.0, 5.0], {})], "id bigint, vector array<float>, payload map<string,string>"))
    assert {r["id"]: r["payload"] for r in store.points().collect()} == {1: {"a": "y"}, 2: {}}
    with pytest.raises(vector.DimensionMismatch):
        store.upsert_point(3, [1.0])
    with pytest.raises(vector.DimensionMismatch):
        store.query([1.0], 1)
    store.upsert_point(2, [1.0, 0.0])
    assert [r["id"] for r in store.query([1.0, 0.1], 5).collect()] == [2, 1]
    written = len(list((tmp_path / "c").glob("*-part")))
    store.upsert_point(2, [1.0, 0.0])
    assert len(list((tmp_path / "c").glob("*-part"))) == written + 1 and len(list((tmp_path / "c").glob("*-full"))) == 1  # a point is written alone
    store.COMPACT_AFTER = 3
    for k in range(3):
        store.upsert_point(2, [1.0, 0.0], {"k": str(k)})
    assert len(store._versions()) <= 3 and {r["id"]: r["payload"] for r in store.points().collect()} == {1: {"a": "y"}, 2: {"k": "2"}}
    store.vacuum()
    again = store.disconnect().connect()
    assert again.points().count() == 2
    with pytest.raises(ValueError):
        VectorConfig("x", "c", 0)
    with pytest.raises(ValueError):
        VectorConfig("x", "c", 2, "hamming")


def test_graph_store(spark):
    config = GraphConfig("parchmill_test", ["CREATE OR REPLACE TEMP VIEW people AS SELECT 1 AS id"], password="hidden")
    assert "hidden" not in repr(config)
    store = GraphStore(spark, config).connect()
    with store.read_transaction() as run:
        assert run("SELECT * FROM people").count() == 1
        with pytest.raises(TransactionFailed):
            run("DROP VIEW people")
        with pytest.raises(TransactionFailed):
            run("SELECT * FROM nowhere")
        for hidden in ("WITH t AS (SELECT 1 AS id) INSERT INTO people SELECT * FROM t", "FROM people INSERT INTO more SELECT *", "CREATE TABLE x (id int)", "SET a.b=1", "DROP DATABASE parchmill_test"):
            with pytest.raises(TransactionFailed, match="cannot change"):
                run(hidden)
        assert run("SHOW TABLES").count() >= 1 and run("WITH t AS (SELECT * FROM people) SELECT * FROM t UNION ALL VALUES (2)").count() == 2
    with store.write_transaction() as run:
        run("CREATE OR REPLACE TEMP VIEW more AS SELECT 2 AS id")
    assert spark.catalog.currentDatabase() == "default"
    assert not hasattr(store.disconnect(), "read_transaction")
    spark.sql("DROP DATABASE parchmill_test CASCADE")
    with pytest.raises(ConnectionFailed):
        GraphConfig("x", address="nowhere")

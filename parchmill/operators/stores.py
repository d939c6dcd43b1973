"""Stores with a connected and an unconnected type: a vector collection and a database.

Queries exist on the connected type only, so using a store before ``connect``
is an attribute error, not a surprise at run time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vector

POINTS = "id bigint, vector array<float>, payload map<string,string>"


class StoreError(Exception):
    """What a store could not do; ``kind`` says which step it was."""

    kind = "store"

    def __init__(self, message: str, **of: str) -> None:
        super().__init__(message)
        self.of = of


class ConnectionFailed(StoreError):
    kind = "connection"


class InvalidAddress(ConnectionFailed):
    kind = "invalid_address"


class DatabaseCheckFailed(ConnectionFailed):
    kind = "check_database"


class DatabaseCreationFailed(ConnectionFailed):
    kind = "create_database"


class DatabaseOpeningFailed(ConnectionFailed):
    kind = "open_database"


class ClosingFailed(ConnectionFailed):
    kind = "close"


class CollectionCheckFailed(ConnectionFailed):
    kind = "check_collection"


class CollectionCreationFailed(ConnectionFailed):
    kind = "create_collection"


class UpsertFailed(StoreError):
    kind = "upsert_points"


class QueryFailed(StoreError):
    kind = "query"


class TransactionFailed(StoreError):
    kind = "transaction"


class TransactionOpeningFailed(TransactionFailed):
    kind = "open_transaction"


class SchemaFailed(TransactionFailed):
    kind = "apply_schema"


@contextmanager
def _as(error: type[StoreError], message: str, **of: str) -> Iterator[None]:
    """Whatever the engine raises inside becomes ``error``; what callers did wrong stays as it is."""
    try:
        yield
    except (StoreError, ValueError):
        raise
    except Exception as e:
        raise error(f"{message}: {str(e).splitlines()[0] if str(e) else type(e).__name__}", **of) from e


@dataclass(frozen=True)
class VectorConfig:
    """Where a collection lies, and its shape."""

    url: str
    collection: str
    dimension: int
    metric: str = "cosine"
    api_key: str | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if self.dimension < 1:
            raise ValueError("a vector has at least one dimension")
        if self.metric not in vector.METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")

    @property
    def path(self) -> str:
        return f"{self.url.rstrip('/')}/{self.collection}"


class VectorStore:
    def __init__(self, spark: SparkSession, config: VectorConfig) -> None:
        self.spark, self.config = spark, config

    def connect(self) -> ConnectedVectorStore:
        """Creates the collection if there is none; the shape of an existing one is not compared."""
        store = ConnectedVectorStore(self.spark, self.config)
        name = self.config.collection
        with _as(CollectionCheckFailed, f"cannot tell whether collection {name!r} exists", collection=name):
            there = bool(store._versions())
        if not there:
            with _as(CollectionCreationFailed, f"cannot create collection {name!r}", collection=name):
                store._put(self.spark.createDataFrame([], POINTS), "full")
        return store


class ConnectedVectorStore:
    """A full Parquet table and the upserts since, each a small table of its own; empty files whose names are in order say which count.

    An upsert writes its own points only; a read takes the newest of each id.
    After ``COMPACT_AFTER`` upserts they become one full table again.
    """

    COMPACT_AFTER = 32

    def __init__(self, spark: SparkSession, config: VectorConfig) -> None:
        self.spark, self.config = spark, config

    def _fs(self):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.config.path)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), sc._jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[str]:
        """The last full table and the upserts after it, in order."""
        fs, path = self._fs()
        at = path(f"{self.config.path}/current")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        full = max((k for k, n in enumerate(names) if n.endswith("-full")), default=0)
        return names[full:]

    def _put(self, points: DataFrame, kind: str) -> None:
        fs, path = self._fs()
        before = self._versions()
        turn = int(before[-1].partition("-")[0]) + 1 if before else 0
        name = f"{turn:012d}-{uuid.uuid4().hex}-{kind}"
        points.write.parquet(f"{self.config.path}/{name}")
        # creating an empty file is atomic: from here on readers count the table
        fs.create(path(f"{self.config.path}/current/{name}")).close()

    def points(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            raise LookupError(f"there is no collection {self.config.collection!r}")
        full, *newer = versions
        read = lambda name: self.spark.read.schema(POINTS).parquet(f"{self.config.path}/{name}")
        if not newer:
            return read(full)
        later = vector.union_all([read(n).withColumn("__pm_turn", F.lit(k)) for k, n in enumerate(newer)])
        return vector.upsert(read(full), later, F.col("__pm_turn")).select("id", "vector", "payload")

    def _upsert(self, new: Callable[[], DataFrame]) -> None:
        name = self.config.collection
        with _as(UpsertFailed, f"cannot put points into collection {name!r}", collection=name):
            self._put(new(), "part")
            if len(self._versions()) > self.COMPACT_AFTER:
                self.compact()

    def upsert_point(self, id_: int, values: Sequence[float], payload: dict[str, str] | None = None) -> None:
        """Writes that point alone."""
        vector.check_dimension(values, self.config.dimension)
        self._upsert(lambda: self.spark.createDataFrame([(id_, [float(x) for x in values], payload or {})], POINTS))

    def upsert_points(self, new: DataFrame, version: Column | None = None) -> None:
        """All rows of ``new``, whatever their dimension; returns when they are written. Of rows of one id the last counts."""
        self._upsert(lambda: vector.upsert(self.spark.createDataFrame([], POINTS), new, version).select("id", "vector", "payload"))

    def query(self, values: Sequence[float], limit: int) -> DataFrame:
        name = self.config.collection
        with _as(QueryFailed, f"cannot query collection {name!r}", collection=name):
            return vector.top_k(self.points(), values, limit, self.config.metric, self.config.dimension)

    def compact(self) -> None:
        """One full table in place of a full table and upserts."""
        self._put(self.points(), "full")

    def vacuum(self) -> None:
        """Drop every table that no longer counts."""
        fs, path = self._fs()
        now = self._versions()
        for s in fs.listStatus(path(self.config.path)):
            if s.getPath().getName() not in ("current", *now):
                fs.delete(s.getPath(), True)
        for s in fs.listStatus(path(f"{self.config.path}/current")):
            if s.getPath().getName() not in now:
                fs.delete(s.getPath(), True)

    def disconnect(self) -> VectorStore:
        return VectorStore(self.spark, self.config)


@dataclass(frozen=True)
class GraphConfig:
    """A database, and the statements that define its tables; credentials never show."""

    database: str
    schema: Sequence[str] = ()
    address: str = "localhost:1729"
    tls: bool = False
    username: str | None = field(default=None, repr=False)
    password: str | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        host, colon, port = self.address.rpartition(":")
        if not (host and colon and port.isdigit()):
            raise InvalidAddress(f"not an address: {self.address!r}", address=self.address)


class GraphStore:
    def __init__(self, spark: SparkSession, config: GraphConfig) -> None:
        self.spark, self.config = spark, config

    def connect(self) -> ConnectedGraphStore:
        """Creates the database if there is none and applies its schema, on every connect."""
        name = self.config.database
        with _as(DatabaseCheckFailed, f"cannot tell whether database {name!r} exists", database=name):
            there = self.spark.catalog.databaseExists(name)
        if not there:
            with _as(DatabaseCreationFailed, f"cannot create database {name!r}", database=name):
                self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
        with _as(DatabaseOpeningFailed, f"cannot open database {name!r}", database=name):
            self.spark.catalog.getDatabase(name)
        store = ConnectedGraphStore(self.spark, self.config)
        with store.transaction("schema") as run:
            for statement in self.config.schema:
                run(statement)
        return store


class ConnectedGraphStore:
    def __init__(self, spark: SparkSession, config: GraphConfig) -> None:
        self.spark, self.config = spark, config

    @contextmanager
    def transaction(self, kind: str = "write") -> Iterator:
        """``run(sql)`` inside the database; a ``read`` transaction refuses statements that change something."""
        if kind not in ("read", "write", "schema"):
            raise ValueError(f"unknown transaction {kind!r}")
        before, name = self.spark.catalog.currentDatabase(), self.config.database
        with _as(TransactionOpeningFailed, f"cannot open a {kind} transaction on database {name!r}", database=name, transaction=kind):
            self.spark.catalog.setCurrentDatabase(name)
        error = SchemaFailed if kind == "schema" else TransactionFailed

        def run(statement: str) -> DataFrame:
            with _as(error, "statement failed", database=name):
                if kind == "read" and self._changes(statement):
                    raise TransactionFailed("a read transaction cannot change data", database=name)
                return self.spark.sql(statement)

        try:
            yield run
        finally:
            self.spark.catalog.setCurrentDatabase(before)

    def _changes(self, statement: str) -> bool:
        """Whether the statement's plan, as parsed, holds anything but a query, ``SHOW``, ``DESCRIBE`` or ``EXPLAIN``."""
        session, java = self.spark._jsparkSession, self.spark.sparkContext._jvm.java.lang
        logical = "org.apache.spark.sql.catalyst.plans.logical."
        loader = java.Thread.currentThread().getContextClassLoader()
        writes = [loader.loadClass(logical + n) for n in ("Command", "ParsedStatement")]

        def any_of(plan) -> bool:
            name = plan.getClass().getSimpleName()
            if name.startswith(("Show", "Describe", "Explain")):
                return False
            children = plan.children()
            return any(c.isInstance(plan) for c in writes) or any(any_of(children.apply(k)) for k in range(children.size()))

        return any_of(session.sessionState().sqlParser().parsePlan(statement))

    def read_transaction(self):
        return self.transaction("read")

    def write_transaction(self):
        return self.transaction("write")

    def disconnect(self) -> GraphStore:
        return GraphStore(self.spark, self.config)

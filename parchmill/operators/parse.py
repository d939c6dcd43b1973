"""Parsing TEI text into a flat struct, once per row, in Arrow batches."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..plans.schema import ALL, Members, flat_ddl, members
from .tei_extract import flat_document


#: Rows that one task parses, about: a row of a few hundred bytes takes some tenths of a millisecond.
ROWS_PER_TASK = 100_000


def flat_or_error(xml: str | None, mode: str = "compat", wanted: Members = ALL) -> dict:
    """The flat record, or a record with ``error`` alone: a bad document never stops the others."""
    if xml is None:
        return {"error": "no TEI text"}
    try:
        return flat_document(xml, mode, wanted)
    except RecursionError:
        return {"error": "elements are nested too deeply"}
    except ValueError as e:
        return {"error": str(e)}


def parse_tei(xml: Column, mode: str = "compat", reads: tuple[str, ...] = ()) -> Column:
    """``FLAT`` struct of a TEI text, read strictly or leniently. ``error`` says why a document failed and is null otherwise.

    With ``reads`` it has these members only (``bibl.monogrs.dates``); what is checked, and so ``error``, is the same.
    """
    wanted = members(reads)
    spark_type = _parse_datatype_string(flat_ddl(wanted))
    arrow_type = to_arrow_type(spark_type)

    @F.arrow_udf(spark_type)
    def run(texts: pa.Array) -> pa.Array:
        # the trees hold no cycles, and looking for some takes a fifth of the time
        gc.disable()
        try:
            return pa.array([flat_or_error(t, mode, wanted) for t in texts.to_pylist()], arrow_type)
        finally:
            gc.enable()

    # declared so, a filter on a member is not pushed below, where it would parse again
    return run.asNondeterministic()(xml)


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks for parsing so many rows: one a core at least, and no more rows in one as the table grows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def spread(df: DataFrame) -> DataFrame:
    """A stored table over enough tasks for parsing its rows.

    Parsing costs far more than moving a row. Files are cut into tasks by bytes,
    of which a row of numbers has few, and a task without the start of a row
    group has no rows at all. So the rows of each task are counted (from the
    files' footers, no column is read), and where a core would have none or a
    task too many, the rows are dealt out anew.
    """
    counts = [r["count"] for r in df.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()]
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(counts) < cores or max(counts) > 2 * ROWS_PER_TASK:
        return df.repartition(tasks_for(df, sum(counts)))
    return df


def grouped(df: DataFrame, key: str) -> GroupedData:
    """A stored table by a key, over enough tasks for parsing what its groups become: one shuffle, which none joins into fewer."""
    return df.repartition(tasks_for(df, df.count()), key).groupBy(key)


def with_parsed(df: DataFrame, xml: str = "tei_xml", into: str = "flat", mode: str = "compat", reads: tuple[str, ...] = ()) -> DataFrame:
    """Adds the parsed struct. It is computed once however many of its members are used: see the plan's single ArrowEvalPython."""
    return df.withColumn(into, parse_tei(F.col(xml), mode, reads))

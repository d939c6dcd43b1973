"""The same transform over a folder that keeps growing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import file_stem
from ..plans.ingest import parse_documents


def tei_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New TEI files of a folder, each once, read whole."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.[xX][mM][lL]").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    path = F.col("_metadata.file_path")
    return raw.select(path.alias("path"), file_stem(path).alias("stem"), F.col("value").alias("tei_xml"))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Papers of new files appended to a Parquet table; the checkpoint makes each file count once."""
    stream = parse_documents(tei_stream(spark, folder)).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream.trigger(processingTime="10 seconds")).start(out)

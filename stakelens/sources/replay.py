"""A table of events as a stream in bounded steps, for backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import EVENT
from .events import TICK

ROWS = 100_000


def write_slices(events: DataFrame, path: str, rows: int = ROWS, delay: str = "10 minutes") -> None:
    """The events in order of time, in files of at most ``rows`` events, and a tick ``delay`` after the last of them.

    One job writes all files at once. A stream of files goes by their times of change, so these are set in order of
    the events; a store that does not keep them is refused. The tick lets a stream with a watermark of ``delay`` finish
    the last events. Events without a time come first, and no rule sees them.
    """
    events.repartitionByRange("ts").sortWithinPartitions("ts").write.option("maxRecordsPerFile", rows).parquet(f"{path}/1")
    last = events.agg(F.max("ts").alias("ts")).filter("ts is not null")
    ticks = last.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name not in ("ts", "event_type")],
                        F.lit(TICK).alias("event_type"), (F.col("ts") + F.expr(f"interval {delay} 2 milliseconds")).alias("ts"))
    ticks.select(*events.columns).coalesce(1).write.parquet(f"{path}/2")
    _in_order(events.sparkSession, path)


def _in_order(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # Names tell the order: the part's number in the range of times, then the file's within the part.
    files = sorted(str(x.getPath()) for x in fs.globStatus(hadoop(f"{path}/*/part-*")) or [])
    for k, name in enumerate(files):
        fs.setTimes(hadoop(name), (k + 1) * 1000, -1)
    if files and fs.getFileStatus(hadoop(files[0])).getModificationTime() != 1000:
        raise RuntimeError(f"{path} is in a store that does not keep times of change")


def replay_stream(spark: SparkSession, path: str, schema: StructType = EVENT, files: int = 1) -> DataFrame:
    """The written events as a stream, ``files`` slices per micro-batch, oldest first."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("maxFileAge", "10000d").parquet(f"{path}/*")
    )

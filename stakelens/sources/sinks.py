"""Where results go."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW
from .versions import TableSet


def replace_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Full load: the table is replaced, columns included. ``path`` keeps its files outside the warehouse folder."""
    writer = df.write.mode("overwrite").option("overwriteSchema", True)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def sync_flags(source: DataFrame, target: str) -> bool:
    """Replace the warehouse copy of the flags with a typed read of the flag store; leave it alone if that is empty."""
    flags = source.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW["streaming_fraud_flags"].fields]
    )
    if flags.isEmpty():
        return False
    write_parquet(flags, target)
    return True


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A results document: one JSON file from a frame of a few rows, with every key, also of values that are null."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


MANIFEST = "manifest"


def export_reports(spark: SparkSession, reports: Mapping[str, DataFrame], path: str) -> int:
    """Publish the reports and a manifest of them, all at once; the edition's number.

    The files of every report, and the manifest with its rows and a checksum over them, are written first. One commit
    (see ``versions``) then puts them in the place of the last edition's, so whoever reads with :func:`published` sees
    one edition or the next, also if the export dies half-way.
    """
    tables = TableSet(spark, path)
    tables.clean()
    base = tables.version()[0]
    replaced = {name: tables.files(name) for name in (*reports, MANIFEST)}
    added = {name: tables.add(name, df) for name, df in reports.items()}
    counted = []
    for name in reports:
        written = tables.read(name, added[name])
        digest = F.xxhash64(*[F.col(f"`{c}`") for c in written.columns]).cast("decimal(38,0)")
        counted.append(written.agg(F.lit(name).alias("report"), F.count("*").alias("rows"),
                                   F.coalesce(F.sum(digest), F.lit(0)).cast("decimal(38,0)").alias("checksum")))
    added[MANIFEST] = tables.add(MANIFEST, reduce(DataFrame.unionByName, counted).coalesce(1))
    edition = tables.commit(base, added, replaced)
    tables.clean()
    return edition


def published(spark: SparkSession, path: str, report: str = MANIFEST) -> DataFrame:
    """A report of the current edition, or its manifest: report, rows, checksum (the sum of the rows' xxHash64)."""
    return TableSet(spark, path).read(report)

"""Reading raw tables and the currency seed."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FX_RATES, RAW
from .versions import live_files

log = logging.getLogger(__name__)

# GBP per unit of currency.
FX_TO_GBP = {"GBP": "1.00", "EUR": "0.85", "SEK": "0.075", "DKK": "0.115", "CAD": "0.59"}


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_raw(spark: SparkSession, dirs: list[str], name: str) -> DataFrame | None:
    """A raw table, typed as declared, from the first directory that has it. Absent tables are noted and skipped.

    Files come with whatever types their writer inferred (float money, zone-less timestamps), so columns are cast
    to the declared types after the scan; columns the file lacks are null. Of tables in a versioned set (see
    ``versions``) the files of the latest version are read.
    """
    for folder in dirs:
        path = f"{folder.rstrip('/')}/{name}.parquet"
        if exists(spark, path):
            live = live_files(spark, folder.rstrip("/"), name)
            found = spark.read.parquet(*(live or [path]))
            return found.select(
                *[
                    (F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                    for f in RAW[name].fields
                ]
            )
    log.warning("%s.parquet not found in %s, skipping", name, dirs)
    return None


def fx_rates(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Rates to GBP: the packaged five-row seed, or a CSV with header at ``path`` on shared storage."""
    if path is None:
        rows = ", ".join(f"('{currency}', cast({rate} as decimal(10,6)))" for currency, rate in FX_TO_GBP.items())
        return spark.sql(f"select * from values {rows} as fx(currency, rate_to_gbp)")
    return spark.read.schema(FX_RATES).option("header", True).csv(path)

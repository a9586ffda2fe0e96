"""Archives and maps that land in a folder, as batches and as streams.

Years and names are put into the listing's file pattern, so files outside are never opened. Files are
read by Spark's binary source, from any store that Spark reads. A stream takes new files only; `land`
writes each micro-batch's rows and, apart from them, a row for each bad file.
"""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def archive_glob(years: tuple[int, int]) -> str:
    """File names of the monthly density archives of a range of years."""
    return "*_DNS_*_{" + ",".join(str(y) for y in range(years[0], years[1] + 1)) + "}_[0-9][0-9]_v02.zip"


def map_glob(years: tuple[int, int]) -> str:
    """File names of the daily maps of a range of years (names have two digits of the year)."""
    return "[a-zA-Z][a-zA-Z][a-zA-Z][a-zA-Z][0-9][0-9][0-9]0.{" + ",".join(f"{y % 100:02d}" for y in range(years[0], years[1] + 1)) + "}[iI]{,.gz,.Z}"


def _landed(spark: SparkSession, folder: str, glob: str, stream: bool, per_batch: int | None) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    if stream and per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)


def _text(content: Column) -> Column:
    """Text of a plain or gzip file; null for other compressions and broken ones."""

    @F.pandas_udf("string")
    def read(column: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str | None:
            try:
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            except (OSError, EOFError):
                return None
            return None if raw[:2] == b"\x1f\x9d" else raw.decode("utf-8", "replace")

        return column.map(one)

    return read(content)


def track_lines(spark: SparkSession, folder: str, years: tuple[int, int], stream: bool = False, per_batch: int | None = None) -> DataFrame:
    """path, value, error, mission, year, month: the lines of the archives of these years."""
    return files.archive_lines(_landed(spark, folder, archive_glob(years), stream, per_batch), years)


def map_cells(spark: SparkSession, folder: str, years: tuple[int, int], center: str | None = None, stream: bool = False, per_batch: int | None = None) -> DataFrame:
    """epoch, center, latitude, longitude, tec_value, path, error: the cells of the maps of these years."""
    found = _landed(spark, folder, map_glob(years), stream, per_batch).select("path", _text(F.col("content")).alias("value"))
    return files.map_cells(found, years, center)


def land(stream: DataFrame, out: str, bad: str, checkpoint: str):
    """Starts a query over all files that are there: rows go to out/batch=N, bad files (path, error) to bad/batch=N.

    A batch that runs again after a failure replaces its own rows.
    """

    def one(batch: DataFrame, n: int) -> None:
        batch.filter("error is null").drop("error").write.mode("overwrite").parquet(f"{out}/batch={n}")
        batch.filter("error is not null").select("path", "error").write.mode("overwrite").parquet(f"{bad}/batch={n}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.names import free  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (local sessions only), a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder of this application within the shared one."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy", file_rows: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder, read again.

    Cuts the lineage in a way that survives lost executors, and gives the planner the
    table's true size, so that a later join broadcasts it only below the session's limit.
    Writers and readers hold a whole row group, whose size Parquet does not look at before it
    has 100 rows, and statistics until the file ends: tables of wide rows name file_rows, the
    most rows of a file (0: as the session has it).
    """
    path = new_path(df.sparkSession, name)
    limit = {"maxRecordsPerFile": file_rows} if file_rows else {}
    df.write.options(compression=codec, **limit).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; call it once their results are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether some id stands in several rows."""
    return docs.groupBy(F.col(id_col).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0


def row_hash(text: Column) -> Column:
    """With its id, what a row is known by where ids are null or repeat."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def share(keys: list[Column], most: float, of: int) -> Column:
    """Whether a row is in a sample of about `most` of `of` rows, by a 64-bit hash of its keys: fine enough for any size."""
    return F.xxhash64(*keys) <= F.lit(int(-(2**63) + min(1.0, most / max(1, of)) * 2**64 * (1 - 2**-53)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

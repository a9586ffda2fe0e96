"""Tables replayed as streams, to hold streaming operators against their batch forms."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import shared_dir


def replayed(table: DataFrame, closing: DataFrame, operator: Callable[[DataFrame], DataFrame], files: int = 4) -> DataFrame:
    """All rows that `operator` emits for a table which arrives as files of shuffled rows, one a batch.

    The query runs until it has read all files, then starts again from its checkpoint with
    `closing` (rows of a far later time), which moves the watermark past every row of the table.
    """
    return replayed_together([table], [closing], operator, files)


def replayed_together(tables: list[DataFrame], closings: list[DataFrame], operator: Callable[..., DataFrame], files: int = 4) -> DataFrame:
    """The same for an operator over several streams, each with closing rows of its own."""
    spark = tables[0].sparkSession
    base = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/replay-{uuid.uuid4().hex}"
    for k, table in enumerate(tables):
        table.repartition(files).write.parquet(f"{base}/in{k}")

    def streams(**options: int) -> list[DataFrame]:
        return [spark.readStream.schema(t.schema).options(**options).parquet(f"{base}/in{k}") for k, t in enumerate(tables)]

    def run() -> None:
        query = operator(*streams(maxFilesPerTrigger=1)).writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    for k, (table, closing) in enumerate(zip(tables, closings, strict=True)):
        closing.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema]).coalesce(1).write.mode("append").parquet(f"{base}/in{k}")
    run()
    return spark.read.schema(operator(*streams()).schema).parquet(f"{base}/out")

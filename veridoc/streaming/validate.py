"""Validation of streams: the same Columns, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veridoc.plans.schema import Validator


def mark(stream: DataFrame, column: str | None, validator: Validator, into: str = "valid") -> DataFrame:
    """A batch or streaming DataFrame with the verdict on each row."""
    return validator.mark(stream, column, into)


def quarantine(stream: DataFrame, column: str | None, validator: Validator, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Write valid rows to one Parquet folder, the others with their error records to another; each batch is read once."""

    def write(batch: DataFrame, number: int) -> None:
        judged = validator.with_errors(batch, column).persist()
        try:
            judged.where("size(errors) = 0").drop("errors").write.mode("append").parquet(good)
            judged.where("size(errors) > 0").write.mode("append").parquet(bad)
        finally:
            judged.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Running a streaming query over what is there."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusloom.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class LateRowsError(RuntimeError):
    """Rows came later than the watermark allows and would have been left out."""


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for the queries started inside; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that the watermark left out, as the query's progress reports them."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def run_available(df: DataFrame, name: str, at_end: Callable[[], None] | None = None, late: str = "fail") -> DataFrame:
    """Process all available input into a table in the shared scratch folder; gives that table.

    ``at_end`` adds rows to an input of the stream that say that nothing more will come; the query then
    runs once more from where it stopped, and what waited in state is decided. Rows later than the
    watermark fail the run, or are accepted as lost with ``late="drop"``.
    """
    spark = df.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def once() -> None:
        query = (
            df.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", state)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        lost = dropped_rows(query)
        if lost and late == "fail":
            raise LateRowsError(f"{lost} rows of {name} came later than the watermark allows")

    with rocksdb_state(spark):
        once()
        if at_end is not None:
            at_end()
            once()
    return spark.read.schema(df.schema).parquet(out)


def with_end(df: DataFrame, name: str, **last: object) -> tuple[DataFrame, Callable[[], None]]:
    """A stream that can be ended: ``df`` and, once the second value was called, one row ``last``.

    Give a time in the far future for the event time; other columns are null unless named. The row moves the
    watermark past everything before it, and is never due itself.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, f"{name}-end")
    spark.createDataFrame([], df.schema).write.parquet(folder)
    ends = spark.readStream.schema(df.schema).parquet(folder)

    def end() -> None:
        row = {f.name: last.get(f.name) for f in df.schema.fields}
        spark.createDataFrame([tuple(row.values())], df.schema).write.mode("append").parquet(folder)

    return df.unionByName(ends), end

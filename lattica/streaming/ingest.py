"""Appending relationships from a stream: each micro-batch extends a table, and readers see whole batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.model import DST, ID, SRC, EdgeTable, PropertyGraph


def append_edges(stream: DataFrame, path: str, checkpoint: str, src: str, dst: str, props: tuple[str, ...] = (), once: bool = True) -> StreamingQuery:
    """Write a stream's rows as relationships to Parquet, exactly once per batch: a batch that runs again overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        # equal rows are relationships of their own: the batch and the row's place in it count too
        one = F.shiftrightunsigned(F.xxhash64(src, dst, *props, F.lit(number), F.monotonically_increasing_id()), 2).alias(ID)
        batch.select(one, F.col(src).cast("long").alias(SRC), F.col(dst).cast("long").alias(DST), *props).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def extended(graph: PropertyGraph, type_: str, path: str) -> PropertyGraph:
    """The graph with the relationships that a stream has written so far."""
    df = graph.spark.read.parquet(path).drop("batch")
    return graph.with_edges([*graph.edges, EdgeTable(type_, df)])


def windowed_degree(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window, key, n): arrivals per key and window, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))

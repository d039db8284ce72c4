"""Snapshots as a stream: weekly counts with late data, and the current state kept by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitesignal.operators.state import Store

#: How late a change of a case may come in.
LATE = "180 days"


def weekly(events: DataFrame, *keys: str, ts: str = "ts", late: str = LATE) -> DataFrame:
    """week, keys, n over tumbling weeks from Monday; a week is final once it is older than `late`.

    Windows are counted from a Thursday (the epoch's day), hence the offset of four days.
    """
    week = F.window(ts, "7 days", "7 days", "4 days")
    counted = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(week.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").cast("date").alias("week"), *keys, "n")


def changes(counts: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the rows that each micro-batch has changed to a folder of its own; one that is repeated replaces its folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The last state of each key in a folder that `changes` writes."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct(*rest), "batch").alias("r")
    return rows.groupBy(*keys).agg(last).select(*keys, *[f"r.{c}" for c in rest])


def upserts(snapshots: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Folds a stream of snapshots (cases with asof and batch_seq) into the store's cases and case_history.

    A micro-batch that is repeated after a failure changes nothing, since folding is idempotent and does not depend on
    the order of snapshots.
    """

    def fold(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            store.fold(batch)

    writer = snapshots.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold)
    return (writer.trigger(availableNow=True) if once else writer).start()


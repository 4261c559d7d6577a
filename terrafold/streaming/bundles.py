"""Extension: bundles as a stream. Each run takes what is new, splits it, and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.importers import first_bodies
from ..sources.versions import Transaction, Versions


def ingest(spark: SparkSession, source: str, schema: T.StructType, reason: Column, accepted: str, quarantine: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Append the new JSON files' rows to accepted or quarantine (with their reason), exactly once per batch id."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        judged = prepare(batch).withColumn("reason", reason).withColumn("batch", F.lit(batch_id)).persist()
        # A repeated batch overwrites its own folder, so a restart adds nothing twice.
        judged.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        judged.where("reason is not null").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        judged.unpersist()

    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_accepted(stream: DataFrame, order: str, log: Versions, checkpoint: str, name: str = "rows", parts: int = 16, buckets: int = 8) -> None:
    """Accept each id and each body once over all bundles: what comes later is rejected, with its reason, for good.

    stream: rows with id, body_sha256 and a column order, that tells the rows of a bundle apart. The log holds <name>_ids,
    <name>_bodies, <name> (accepted) and <name>_rejected. A batch's rows, what they claim and the batch's number are one
    version: a batch that runs again after a crash finds its number in the log and changes nothing. The rules are those of
    first_bodies over all bundles in their order; the claims of earlier bundles are joined in buckets, not dealt anew."""
    columns = stream.columns

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def change(tx: Transaction) -> None:
            if tx.facts.get(f"{name}_batch", -1) >= batch_id:
                return
            if name not in tx.tables:
                none = spark.createDataFrame([], batch.schema)
                tx.put(name, none, ["id"], parts, buckets)
                tx.put(f"{name}_rejected", none.withColumn("reason", F.lit("")), ["id"], parts, buckets)
                tx.put(f"{name}_ids", none.select("id"), ["id"], parts, buckets)
                tx.put(f"{name}_bodies", none.select("body_sha256"), ["body_sha256"], parts, buckets)
            judged = first_bodies(batch.select(*columns), F.col(order), tx.table(f"{name}_ids"), tx.table(f"{name}_bodies"))
            judged = tx.kept(judged)
            good = judged.where("reason is null").drop("reason")
            tx.insert_first(f"{name}_ids", judged.select("id").where("id is not null"))
            tx.insert_first(f"{name}_bodies", good.select("body_sha256").where("body_sha256 is not null"))
            tx.append(name, good)
            tx.append(f"{name}_rejected", judged.where("reason is not null"))
            for t in (name, f"{name}_rejected", f"{name}_ids", f"{name}_bodies"):
                tx.compact(t)
            tx.note(**{f"{name}_batch": batch_id})

        log.apply(change)

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window; rows later than the watermark are dropped by the engine."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")

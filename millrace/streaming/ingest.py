"""The event stream: messages to stored events and additive deltas of the daily rollups.

Every micro-batch writes its events and its rollup deltas under its own batch id, replacing what an earlier
attempt left, so a batch that runs again counts once. A rollup is the sum of its deltas; :func:`compact` folds
them together from time to time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import ingest, rollups
from millrace.schemas import METRICS

VDS_KEYS = ["project_id", "visitor_id", "event_date", "platform"]
LDS_KEYS = ["project_id", "link_id", "event_date", "platform"]


def messages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines as they come into a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def numbered(parsed: DataFrame) -> DataFrame:
    """Parsed events with a date and an id that depends on their content alone."""
    return parsed.withColumn("event_date", F.to_date("created_at")).withColumn("event_id", F.xxhash64("event", "project_id", "device_id", "link_id", "created_at", "data"))


def batch_writer(out: str, devices: DataFrame, visitors: DataFrame, links: DataFrame) -> Callable[[DataFrame, int], None]:
    """What to do with each micro-batch of de-duplicated events: store them with those that follow from referrals, the deltas
    of both rollups, and what the batch says of inviters, last visits and touched visitors. The operators are the batch's."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        put(batch, "received")  # what follows starts from here, and a batch that runs again replaces it
        kept = spark.read.schema(batch.schema).parquet(f"{out}/received/batch={batch_id}")
        found = ingest.referrals(kept, links, visitors)
        everything = kept.unionByName(ingest.referral_events(found), allowMissingColumns=True)
        put(ingest.enrich(everything, devices, links), "events")
        enriched = spark.read.parquet(f"{out}/events/batch={batch_id}")
        put(rollups.by_visitor(enriched, visitors), "vds")
        put(rollups.by_link(enriched, visitors), "lds")
        put(found.groupBy("visitor_id").agg(F.max_by("referrer_id", F.struct(*ingest.ARRIVAL)).alias("referrer_id"), F.max(F.struct(*ingest.ARRIVAL)).alias("at")), "inviters")
        put(ingest.last_visits(kept, visitors), "visits")
        put(ingest.touched_visitors(everything, visitors), "touched")

    return write


def start(stream: DataFrame, out: str, checkpoint: str, devices: DataFrame, visitors: DataFrame, links: DataFrame, now: str, gap_seconds: int = 5, delay: str = "10 minutes") -> StreamingQuery:
    """Process what there is, then stop; run it again for what comes later. Views are de-duplicated over micro-batches too:
    the state of :func:`dedup_views` is in the checkpoint."""
    parsed = numbered(ingest.parse(stream, F.lit(now).cast("timestamp")))
    writer = batch_writer(out, devices, visitors, links)
    return dedup_views(parsed, gap_seconds, delay).writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inviters(spark: SparkSession, out: str) -> DataFrame:
    """Each visitor's last referrer over all batches."""
    return spark.read.parquet(f"{out}/inviters").groupBy("visitor_id").agg(F.max_by("referrer_id", "at").alias("referrer_id"))


def visits(spark: SparkSession, out: str) -> DataFrame:
    """The last link of every (project, visitor) over all batches."""
    return spark.read.parquet(f"{out}/visits").groupBy("project_id", "visitor_id").agg(F.max_by("link_id", F.struct("updated_at", "batch")).alias("link_id"), F.max("updated_at").alias("updated_at"))


def touched(spark: SparkSession, out: str) -> DataFrame:
    """When each visitor last had an event that counts, over all batches."""
    return spark.read.parquet(f"{out}/touched").groupBy("visitor_id").agg(F.max("updated_at").alias("updated_at"))


def visitor_days(spark: SparkSession, out: str) -> DataFrame:
    """The visitor rollup: the sum of its deltas."""
    deltas = spark.read.parquet(f"{out}/vds")
    return deltas.groupBy(*VDS_KEYS).agg(*[F.sum(m).cast("long").alias(m) for m in METRICS], F.min_by("invited_by_id", F.when(F.col("invited_by_id").isNotNull(), F.col("batch"))).alias("invited_by_id"))


def link_days(spark: SparkSession, out: str) -> DataFrame:
    deltas = spark.read.parquet(f"{out}/lds")
    return deltas.groupBy(*LDS_KEYS).agg(*[F.sum(m).cast("long").alias(m) for m in METRICS])


def compact(spark: SparkSession, out: str, to: str) -> None:
    """Write the visitor rollup by date, replacing the dates that it has."""
    rollups.write_days(visitor_days(spark, out), to)


def flush(events: DataFrame, now, minutes: int = 5) -> DataFrame:
    """What a flush processes: all but late events."""
    return ingest.drop_late(events, now, minutes)


def daily_counts(stream: DataFrame, delay: str = "3 days") -> DataFrame:
    """Counts of a stream of events (created_at timestamp, project_id, event) by day, final ``delay`` after it."""
    return stream.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day"), "project_id", "event").agg(F.count("*").alias("n"))


def dedup_views(stream: DataFrame, seconds: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Drop a device's views within ``seconds`` of its last kept one, over micro-batches too; dropped views do not prolong
    the window, other events pass. Each device's state is one time, and goes when the watermark is past its window."""
    window = seconds * 1000

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("created_at", kind="stable")
        kept = []
        for event, at in zip(rows["event"], rows["created_at"], strict=True):
            now = at.value // 1_000_000
            new = event != "view" or start is None or now - start > window
            if event == "view" and new:
                start = now
            kept.append(new)
        if start is not None:
            state.update((start,))
            state.setTimeoutTimestamp(max(start + window, state.getCurrentWatermarkMs()) + 1)
        yield rows[kept]

    state = T.StructType([T.StructField("start", T.LongType())])
    return stream.withWatermark("created_at", delay).groupBy("device_id").applyInPandasWithState(keep, stream.schema, state, "append", GroupStateTimeout.EventTimeTimeout)

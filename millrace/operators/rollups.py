"""Daily rollups: by visitor, by link, by project, and active users. All dates are built at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.expr import purchase_platform
from millrace.operators.ingest import ARRIVAL, projected, with_visitors
from millrace.schemas import EVENT_METRICS, METRICS

PROJECT_KEYS = ["project_id", "event_date", "platform"]
DPM = ["views", "link_views", "opens", "installs", "reinstalls", "app_opens", "returning_users", "referred_users", "organic_users", "new_users", "first_time_visitors", "revenue", "units_sold", "cancellations", "first_time_purchases"]


def _sums(columns: list[str]) -> list:
    return [F.coalesce(F.sum(F.when(F.col("metric") == c, F.col("metric_value"))), F.lit(0)).alias(c) for c in columns]


def by_visitor(enriched: DataFrame, visitors: DataFrame) -> DataFrame:
    """One row for each project, visitor, date and platform: the metrics, and the first inviter that is known."""
    events = projected(with_visitors(enriched, visitors))
    made = events.groupBy("project_id", "visitor_id", "event_date", "platform").agg(
        *_sums(list(EVENT_METRICS.values())), F.min_by("inviter_id", F.when(F.col("inviter_id").isNotNull(), F.struct(*ARRIVAL))).alias("invited_by_id")
    )
    return made.withColumn("revenue", F.lit(0).cast("long")).select("project_id", "visitor_id", "event_date", "platform", *METRICS, "invited_by_id")


def by_link(enriched: DataFrame, visitors: DataFrame) -> DataFrame:
    """One row for each project, link, date and platform, over events with a link and a visitor."""
    events = projected(with_visitors(enriched.filter("link_id is not null"), visitors))
    made = events.groupBy("project_id", "link_id", "event_date", "platform").agg(*_sums(list(EVENT_METRICS.values())))
    return made.withColumn("revenue", F.lit(0).cast("long")).select("project_id", "link_id", "event_date", "platform", *METRICS)


def upsert(stored: DataFrame, delta: DataFrame, keys: list[str], metrics: list[str], first: tuple[str, ...] = ()) -> DataFrame:
    """Add a delta's metrics to the stored rows by key (null counts as 0); of ``first`` columns the stored value wins."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    sums = [F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in metrics]
    return both.groupBy(*keys).agg(*sums, *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_new"))).alias(c) for c in first])


def first_days(vds: DataFrame) -> DataFrame:
    """The first date of every project, visitor and platform."""
    return vds.groupBy("project_id", "visitor_id", "platform").agg(F.min("event_date").alias("first_date"))


def visitor_stats(vds: DataFrame) -> DataFrame:
    return vds.groupBy(*PROJECT_KEYS).agg(*[F.sum(c).alias(c) for c in ("views", "opens", "installs", "reinstalls", "app_opens")])


def link_stats(lds: DataFrame) -> DataFrame:
    return lds.groupBy(*PROJECT_KEYS).agg(F.sum("views").alias("link_views"), F.sum("installs").alias("link_installs"))


def visit_kinds(vds: DataFrame) -> DataFrame:
    """Returning, first-time and new users of each day: whether a visitor came before on the same project and platform
    is one comparison with the first date, not a look-up for each day."""
    marked = vds.join(first_days(vds), ["project_id", "visitor_id", "platform"])
    first = F.col("event_date") == F.col("first_date")
    return marked.groupBy(*PROJECT_KEYS).agg(
        F.count_distinct(F.when(~first, F.col("visitor_id"))).alias("returning_users"),
        F.count_distinct(F.when(first, F.col("visitor_id"))).alias("first_time_visitors"),
        F.count_distinct(F.when(first & (F.col("installs") > 0), F.col("visitor_id"))).alias("new_users"),
    )


def referred_users(vds: DataFrame) -> DataFrame:
    """Rows, not visitors, that have an inviter."""
    return vds.filter("invited_by_id is not null").groupBy(*PROJECT_KEYS).agg(F.count("*").alias("referred_users"))


def revenue_stats(iapds: DataFrame) -> DataFrame:
    made = iapds.groupBy(*PROJECT_KEYS).agg(F.sum("revenue").alias("revenue"), F.sum("purchase_events").alias("units_sold"), F.sum("canceled_events").alias("cancellations"), F.sum("first_time_purchases").alias("first_time_purchases"))
    return made.filter("revenue <> 0 or units_sold <> 0 or cancellations <> 0 or first_time_purchases <> 0")


def daily_project_metrics(vds: DataFrame, lds: DataFrame, iapds: DataFrame) -> DataFrame:
    """All of a project's day in one row for each platform; a key that any part has is there, what is missing is 0."""
    parts = [visitor_stats(vds), link_stats(lds), visit_kinds(vds), referred_users(vds), revenue_stats(iapds)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    names = [c for c in both.columns if c not in PROJECT_KEYS]
    summed = both.groupBy(*PROJECT_KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
    derived = summed.withColumn("installs", F.col("installs") + F.col("reinstalls"))
    derived = derived.withColumn("organic_users", F.greatest(F.col("installs") - F.col("link_installs"), F.lit(0).cast("long")))
    return derived.select(*PROJECT_KEYS, *DPM)


def daily_active_users(vds: DataFrame) -> DataFrame:
    return vds.groupBy(*PROJECT_KEYS).agg(F.count_distinct("visitor_id").alias("active_users"))


def first_visits(vds: DataFrame) -> DataFrame:
    """How many visitors came first on each platform and date."""
    firsts = vds.groupBy("project_id", "visitor_id", "platform").agg(F.min("event_date").alias("event_date"))
    return firsts.groupBy(*PROJECT_KEYS).agg(F.count("*").alias("first_time_visitors"))


def backfill_first_visits(dpm: DataFrame, vds: DataFrame) -> DataFrame:
    """DPM with first_time_visitors counted anew, 0 where a day has none."""
    return dpm.drop("first_time_visitors").join(first_visits(vds), PROJECT_KEYS, "left").withColumn("first_time_visitors", F.coalesce("first_time_visitors", F.lit(0)))


def totals(rollup: DataFrame, key: str, start: str, end: str, sort_by: str = "views") -> DataFrame:
    """Metric sums by visitor or link over dates, largest first; another sort than a metric is an error."""
    if sort_by not in METRICS:
        raise ValueError(f"cannot sort by {sort_by}")
    made = rollup.filter(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy(key).agg(*[F.sum(m).alias(m) for m in METRICS])
    return made.orderBy(F.desc(sort_by), key)


def write_days(df: DataFrame, path: str) -> None:
    """Replace the partitions of the dates that ``df`` has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


def purchases_platform(purchases: DataFrame, devices: DataFrame) -> DataFrame:
    """Purchases with the platform that they count for."""
    own = devices.select("device_id", F.col("platform").alias("_platform"))
    joined = purchases.join(own, "device_id", "left")
    return joined.withColumn("platform", purchase_platform(F.col("store_source"), F.col("_platform"))).drop("_platform")


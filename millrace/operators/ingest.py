"""Events from raw messages to enriched, de-duplicated, attributed rows. A batch and a micro-batch run the same code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expr import metric_name, metric_platform, metric_value
from millrace.functions.folds import apart
from millrace.schemas import EVENTS, RAW_EVENT

#: What events take from their device.
DEVICE = ["platform", "app_version", "build", "vendor_id", "ip", "remote_ip"]
#: Order of arrival, wherever first or last counts.
ARRIVAL = ("created_at", "event_id")


def parse(raw: DataFrame, now: Column, value: str = "value") -> DataFrame:
    """JSON messages to events. Bad JSON, missing type, project or device, and unknown types go; a time that is
    missing or unreadable is ``now``."""
    read = raw.select(F.from_json(value, RAW_EVENT).alias("e")).select("e.*")
    known = read.filter(F.col("project_id").isNotNull() & F.col("device_id").isNotNull() & F.col("type").isin(EVENTS))
    when = F.coalesce(F.try_to_timestamp("created_at"), now)
    return known.select(F.col("type").alias("event"), "project_id", "device_id", "link_id", "engagement_time", "data", when.alias("created_at"))


def enrich(events: DataFrame, devices: DataFrame, links: DataFrame) -> DataFrame:
    """Device attributes (all that ``devices`` has) and link path on every event; events of unknown devices go, unknown links
    become null. Attributes that an event brings itself stay."""
    known = devices.select("device_id", *[c for c in DEVICE if c in devices.columns and c not in events.columns])
    paths = links.select(F.col("link_id").alias("_link"), F.col("path"))
    joined = events.join(known, "device_id").join(paths, F.col("link_id") == F.col("_link"), "left")
    return joined.withColumn("link_id", F.col("_link")).withColumn("processed", F.lit(True)).drop("_link")


def with_visitors(events: DataFrame, visitors: DataFrame) -> DataFrame:
    """The (project, device) -> visitor lookup; events without a visitor go."""
    return events.join(visitors.select("project_id", "device_id", "visitor_id", "inviter_id"), ["project_id", "device_id"])


def projected(events: DataFrame) -> DataFrame:
    """metric, value and metric platform of every event that has a metric."""
    return events.withColumns({
        "metric": metric_name(F.col("event")),
        "metric_value": metric_value(F.col("event"), F.col("engagement_time")),
        "platform": metric_platform(F.col("platform")),
    }).filter("metric is not null")


def dedup_views_by_gap(events: DataFrame, seconds: int = 5) -> DataFrame:
    """Drop a device's view that follows another within ``seconds``, whatever project or link; the window rolls
    on with every view."""
    views = events.filter("event = 'view'")
    last = F.lag("created_at").over(Window.partitionBy("device_id").orderBy(*ARRIVAL))
    gap = F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    kept = views.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") > seconds * 1_000_000)).drop("_gap")
    return kept.unionByName(events.filter("event <> 'view' or event is null"))


def dedup_views_fixed(events: DataFrame, seconds: int = 5) -> DataFrame:
    """Drop a device's views within ``seconds`` of the last kept one; dropped views do not prolong the window."""
    kept = apart(events.filter("event = 'view'"), ["device_id"], list(ARRIVAL), seconds * 1_000_000)
    return kept.unionByName(events.filter("event <> 'view' or event is null"))


def view_sessions(events: DataFrame, seconds: int = 5) -> DataFrame:
    """Each device's runs of views with gaps of ``seconds`` at most: first and rolled-forward time, and how many."""
    views = events.filter("event = 'view'")
    order = Window.partitionBy("device_id").orderBy(*ARRIVAL)
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    starts = F.when(at - F.lag(at).over(order) <= seconds * 1_000_000, 0).otherwise(1)
    run = views.withColumn("_new", starts).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("device_id", "session").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("created_at"), F.count("*").alias("views"))


def referrals(events: DataFrame, links: DataFrame, visitors: DataFrame) -> DataFrame:
    """Installs through a link that a visitor made: event_id, installer and referrer."""
    people = visitors.select("visitor_id", F.col("device_id").alias("referrer_device"))
    made = links.select("link_id", F.col("visitor_id").alias("referrer_id")).join(people, F.col("referrer_id") == F.col("visitor_id")).drop("visitor_id")
    installs = events.filter(F.col("event").isin("install", "reinstall"))
    return with_visitors(installs, visitors).join(made, "link_id")


def referral_events(found: DataFrame) -> DataFrame:
    """A user_referred event for every referral, credited to the referrer; it has no link."""
    return found.select(
        "event_id", "created_at", "event_date", F.col("referrer_device").alias("device_id"), "project_id",
        F.lit("user_referred").alias("event"), F.lit(None).cast("long").alias("link_id"), F.lit(None).cast("long").alias("engagement_time"),
    )


def assign_inviters(visitors: DataFrame, found: DataFrame) -> DataFrame:
    """Visitors without an inviter get their last referrer."""
    last = found.groupBy("visitor_id").agg(F.max_by("referrer_id", F.struct(*ARRIVAL)).alias("_last"))
    return visitors.join(last, "visitor_id", "left").withColumn("inviter_id", F.coalesce("inviter_id", "_last")).drop("_last")


def last_visits(events: DataFrame, visitors: DataFrame) -> DataFrame:
    """The last link of every (project, visitor)."""
    return with_visitors(events.filter("link_id is not null"), visitors).groupBy("project_id", "visitor_id").agg(
        F.max_by("link_id", F.struct(*ARRIVAL)).alias("link_id"), F.max("created_at").alias("updated_at")
    )


def touched_visitors(events: DataFrame, visitors: DataFrame) -> DataFrame:
    """When each visitor last had an event that counts."""
    return with_visitors(events.filter(metric_name(F.col("event")).isNotNull()), visitors).groupBy("visitor_id").agg(F.max("created_at").alias("updated_at"))


def merge_visitors(rollup: DataFrame, mapping: DataFrame, metrics: list[str], strict: bool = False) -> DataFrame:
    """Daily rows of merged visitors: ``mapping`` has (from_id, to_id). Rows of a day add up per platform; ``strict``
    adds them over all platforms and projects into the target's row, a new one being web."""
    named = rollup.join(mapping, rollup.visitor_id == mapping.from_id, "left")
    moved = named.withColumn("visitor_id", F.coalesce("to_id", "visitor_id"))
    sums = [F.sum(m).alias(m) for m in metrics]
    if not strict:
        return moved.groupBy("project_id", "visitor_id", "event_date", "platform").agg(*sums)
    merged = moved.groupBy("visitor_id", "event_date").agg(F.min(F.when(F.col("to_id").isNull(), F.struct("project_id", "platform"))).alias("_own"), F.min("project_id").alias("_any"), F.max(F.col("to_id").isNotNull()).alias("_hit"), *sums)
    target = merged.filter("_hit").select(F.coalesce("_own.project_id", "_any").alias("project_id"), "visitor_id", "event_date", F.coalesce("_own.platform", F.lit("web")).alias("platform"), *metrics)
    others = moved.join(merged.filter("_hit").select("visitor_id", "event_date"), ["visitor_id", "event_date"], "left_anti")
    return target.unionByName(others.select(*target.columns))


def installed_apps(existing: DataFrame, seen: DataFrame) -> DataFrame:
    """(device, project) memberships with the new ones."""
    new = seen.select("device_id", "project_id").distinct()
    return existing.select("device_id", "project_id").union(new.join(existing, ["device_id", "project_id"], "left_anti"))


def update_devices(devices: DataFrame, updates: DataFrame, attributes: list[str]) -> DataFrame:
    """Non-blank attributes of each device's latest update replace the stored ones."""
    last = updates.groupBy("device_id").agg(*[F.max_by(c, F.when(F.trim(c) != "", F.struct(*ARRIVAL))).alias(f"_{c}") for c in attributes])
    return devices.join(last, "device_id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in attributes}).drop(*[f"_{c}" for c in attributes])


def device_platform(given: Column, stored: Column, user_agent: Column) -> Column:
    """Given, else stored, else what the user agent says."""
    ua = F.lower(user_agent)
    read = F.when(ua.rlike("iphone|ipad|ipod"), "ios").when(ua.contains("android"), "android").when(ua.contains("macintosh"), "mac").when(ua.contains("windows"), "windows").when(ua.isNotNull(), "web")
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(blank(given), blank(stored), read)


def drop_late(events: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Events older than ``minutes`` go; those without a time stay."""
    return events.filter(F.col("created_at").isNull() | (F.col("created_at") >= now - F.make_dt_interval(mins=F.lit(minutes))))


def replay_backlog(jobs: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From a raw backlog (job, device_id, platform, at): unprocessed events without de-duplication, and the latest device
    update of each device that is newer than the stored row (device_id, updated_at)."""
    events = jobs.filter("job = 'event'").withColumn("processed", F.lit(False))
    latest = jobs.filter("job = 'device'").groupBy("device_id").agg(F.max_by("platform", "at").alias("platform"), F.max("at").alias("at"))
    newer = latest.join(devices.select("device_id", "updated_at"), "device_id", "left").filter("updated_at is null or at > updated_at")
    return events, newer.drop("updated_at")

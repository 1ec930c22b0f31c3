"""Notifications: lists, per-device choice, unread counts, audiences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listed(notifications: DataFrame, messages: DataFrame, archived: bool = False, new_users: bool | None = None, term: str | None = None) -> DataFrame:
    """Notifications with how many messages were read, newest first."""
    own = notifications.filter(F.col("archived") == archived)
    if new_users is not None:
        own = own.filter(F.col("new_users") == new_users)
    if term:
        own = own.filter(F.lower("title").contains(term.lower()) | F.coalesce(F.lower("subtitle").contains(term.lower()), F.lit(False)))
    read = messages.filter("read").groupBy("notification_id").agg(F.count("*").alias("read_count"))
    return own.join(read, "notification_id", "left").withColumn("read_count", F.coalesce("read_count", F.lit(0))).orderBy(F.desc("notification_id"))


def for_device(notifications: DataFrame, messages: DataFrame, visitor: int, platform: str) -> DataFrame:
    """A visitor's notifications on a platform; no platforms means all."""
    mine = messages.filter(F.col("visitor_id") == visitor).select("notification_id", "read")
    fits = F.col("platforms").isNull() | (F.size("platforms") == 0) | F.array_contains("platforms", platform)
    return notifications.filter(fits).join(mine, "notification_id").orderBy(F.desc("notification_id"))


def unread(messages: DataFrame) -> DataFrame:
    return messages.filter(~F.col("read")).groupBy("visitor_id").agg(F.count("*").alias("unread"))


def auto_display(notifications: DataFrame, messages: DataFrame, visitor: int) -> DataFrame:
    """Unread notifications that show themselves."""
    mine = messages.filter((F.col("visitor_id") == visitor) & ~F.col("read")).select("notification_id")
    return notifications.filter("auto_display").join(mine, "notification_id", "left_semi").orderBy("notification_id")


def audience(notifications: DataFrame, visitors: DataFrame, devices: DataFrame, existing: DataFrame) -> DataFrame:
    """One message for every visitor on a wanted platform, for notifications that have none yet. desktop and web are
    web; no platforms are ios, android and web."""
    wanted = F.when(F.col("platforms").isNull() | (F.size("platforms") == 0), F.array(F.lit("ios"), F.lit("android"), F.lit("web"))).otherwise(F.transform("platforms", lambda p: F.when(p == "desktop", "web").otherwise(p)))
    fresh = notifications.join(existing.select("notification_id"), "notification_id", "left_anti")
    spread = fresh.select("notification_id", "project_id", F.explode(F.array_distinct(wanted)).alias("platform"))
    people = visitors.select("visitor_id", "project_id", "device_id").join(devices.select("device_id", "platform"), "device_id")
    return spread.join(people, ["project_id", "platform"]).select("notification_id", "visitor_id").distinct().withColumn("read", F.lit(False))

"""Queries of ingestion and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.expr import metric_platform
from millrace.operators import ingest, rollups
from millrace.plans.base import END, START, Base, query, sums
from millrace.schemas import METRICS

GAP = 6 * 3600


@query("I1_parse_events", "SELECT event, project_id, device_id, link_id, engagement_time, CAST(NULL AS VARCHAR) AS data, created_at FROM a_events")
def parse(b: Base):
    raw = b.t.events.select(F.to_json(F.struct(F.col("event").alias("type"), "project_id", "device_id", "link_id", "engagement_time", F.col("created_at").cast("string").alias("created_at"))).alias("value"))
    broken = b.spark.createDataFrame([("{no json",), ('{"type":"view"}',), ('{"type":"other","project_id":1,"device_id":1}',)], "value string")
    return ingest.parse(raw.union(broken), F.lit("2024-02-01").cast("timestamp")).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("I2_enrich_events", "SELECT event_id, project_id, device_id, link_id, path, raw_platform AS platform, app_version, true AS processed FROM en WHERE event <> 'user_referred'")
def enrich(b: Base):
    return ingest.enrich(b.t.events, b.t.devices, b.t.links).select("event_id", "project_id", "device_id", "link_id", "path", "platform", "app_version", "processed")


@query("I3_visitor_lookup", "SELECT event_id, visitor_id, inviter_id FROM en WHERE event <> 'user_referred'")
def lookup(b: Base):
    return ingest.with_visitors(b.t.events, b.t.visitors).select("event_id", "visitor_id", "inviter_id")


@query(
    "I4_view_dedup_batch",
    "SELECT e.event_id, e.device_id, e.event, e.created_at FROM a_events e WHERE e.event <> 'view' UNION ALL SELECT event_id, device_id, 'view', created_at FROM kept",
    f"""kept(device_id, event_id, created_at) AS (
  SELECT device_id, arg_min(event_id, (created_at, event_id)), min(created_at) FROM a_events WHERE event = 'view' GROUP BY device_id UNION ALL
  SELECT k.device_id, arg_min(v.event_id, (v.created_at, v.event_id)), min(v.created_at) FROM kept k JOIN a_events v ON v.event = 'view' AND v.device_id = k.device_id
  AND v.created_at > k.created_at + INTERVAL {GAP} SECOND GROUP BY k.device_id
)""",
)
def dedup_fixed(b: Base):
    return ingest.dedup_views_fixed(b.t.events, GAP).select("event_id", "device_id", "event", "created_at")


LAGGED = "lagged AS (SELECT event_id, device_id, event, created_at, lag(created_at) OVER (PARTITION BY device_id, event ORDER BY created_at, event_id) AS before FROM a_events)"


@query("I5_view_dedup_sync", f"SELECT event_id, device_id, event, created_at FROM lagged WHERE event <> 'view' OR before IS NULL OR created_at - before > INTERVAL {GAP} SECOND", LAGGED)
def dedup_gap(b: Base):
    return ingest.dedup_views_by_gap(b.t.events, GAP).select("event_id", "device_id", "event", "created_at")


@query(
    "I6_touch_deduped_views",
    "SELECT device_id, min(created_at) AS first_at, max(created_at) AS created_at, count(*) AS views FROM runs GROUP BY device_id, run",
    LAGGED + f", runs AS (SELECT *, sum(CASE WHEN before IS NULL OR created_at - before > INTERVAL {GAP} SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY created_at, event_id) AS run FROM lagged WHERE event = 'view')",
)
def sessions(b: Base):
    return ingest.view_sessions(b.t.events, GAP).select("device_id", "first_at", "created_at", "views")


@query(
    "I7_metric_projection",
    """SELECT event_id, CASE event WHEN 'view' THEN 'views' WHEN 'open' THEN 'opens' WHEN 'install' THEN 'installs' WHEN 'reinstall' THEN 'reinstalls'
       WHEN 'time_spent' THEN 'time_spent' WHEN 'reactivation' THEN 'reactivations' WHEN 'app_open' THEN 'app_opens' ELSE 'user_referred' END AS metric,
       CAST(CASE WHEN event = 'time_spent' THEN coalesce(engagement_time, 0) ELSE 1 END AS BIGINT) AS metric_value FROM en""",
)
def projection(b: Base):
    return ingest.projected(b.enriched).select("event_id", "metric", "metric_value")


@query("I8_platform_for_metrics", "SELECT device_id, platform AS raw, CASE WHEN platform = 'ios' THEN 'ios' WHEN platform = 'android' THEN 'android' ELSE 'web' END AS platform FROM a_devices")
def platforms(b: Base):
    return b.t.devices.select("device_id", F.col("platform").alias("raw"), metric_platform(F.col("platform")).alias("platform"))


@query("I9_clamp_engagement_time", "SELECT event_id, CAST(engagement_time AS BIGINT) AS engagement_time FROM a_events")
def engagement(b: Base):
    return b.t.events.select("event_id", F.col("engagement_time").cast("long"))


@query("I10_referral_events", "SELECT event_id, device_id, project_id, event, link_id FROM all_events WHERE event = 'user_referred'")
def referral_events(b: Base):
    return ingest.referral_events(b.referrals).select("event_id", "device_id", "project_id", "event", "link_id")


@query(
    "I10_referral_attribution",
    "SELECT v.visitor_id, coalesce(v.inviter_id, l.referrer) AS inviter_id FROM a_visitors v LEFT JOIN last l ON l.visitor_id = v.visitor_id",
    """last AS (SELECT i.visitor_id, arg_max(r.visitor_id, (e.created_at, e.event_id)) AS referrer FROM a_events e
       JOIN a_visitors i ON i.project_id = e.project_id AND i.device_id = e.device_id JOIN a_links k ON k.link_id = e.link_id
       JOIN a_visitors r ON r.visitor_id = k.visitor_id WHERE e.event IN ('install', 'reinstall') GROUP BY i.visitor_id)""",
)
def inviters(b: Base):
    return ingest.assign_inviters(b.t.visitors, b.referrals).select("visitor_id", "inviter_id")


@query(
    "I11_visitor_last_visit",
    """SELECT project_id, visitor_id, link_id, created_at AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY project_id, visitor_id ORDER BY created_at DESC, event_id DESC) AS k
       FROM en WHERE link_id IS NOT NULL AND event <> 'user_referred') x WHERE k = 1""",
)
def last_visit(b: Base):
    return ingest.last_visits(b.t.events, b.t.visitors)


@query("I12_touch_visitor", "SELECT visitor_id, max(created_at) AS updated_at FROM en WHERE event <> 'user_referred' GROUP BY visitor_id")
def touched(b: Base):
    return ingest.touched_visitors(b.t.events, b.t.visitors)


@query("I14_flush_late", "SELECT event_id FROM a_events WHERE created_at IS NULL OR created_at >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 5 MINUTE")
def late(b: Base):
    return ingest.drop_late(b.t.events, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("I16_bulk_backfill", f"SELECT project_id, platform, {sums()} FROM vds GROUP BY project_id, platform")
def backfill(b: Base):
    return b.vds.groupBy("project_id", "platform").agg(*[F.sum(m).alias(m) for m in METRICS])


MERGED = "moved AS (SELECT v.*, CASE WHEN visitor_id % 10 = 3 AND EXISTS (SELECT 1 FROM a_visitors t WHERE t.visitor_id = v.visitor_id - 3) THEN visitor_id - 3 ELSE visitor_id END AS target FROM vds v)"


@query("I18_merge_visitors", f"SELECT project_id, target AS visitor_id, event_date, platform, {sums()} FROM moved GROUP BY project_id, target, event_date, platform", MERGED)
def merge(b: Base):
    people = b.t.visitors.select("visitor_id")
    pairs = people.filter("visitor_id % 10 = 3").select(F.col("visitor_id").alias("from_id"), (F.col("visitor_id") - 3).alias("to_id"))
    pairs = pairs.join(people, F.col("to_id") == F.col("visitor_id"), "left_semi")
    return ingest.merge_visitors(b.vds, pairs, METRICS)


@query("I19_installed_apps", "SELECT DISTINCT device_id, project_id FROM a_events")
def installed(b: Base):
    old = b.t.events.filter("event_id % 2 = 0").select("device_id", "project_id").distinct()
    return ingest.installed_apps(old, b.t.events)


@query(
    "I20_device_update",
    "SELECT d.device_id, d.platform, coalesce(u.version, d.app_version) AS app_version FROM a_devices d LEFT JOIN ups u ON u.device_id = d.device_id",
    "ups AS (SELECT device_id, arg_max('2.' || CAST(event_id AS VARCHAR), (created_at, event_id)) AS version FROM a_events WHERE event = 'app_open' AND event_id % 3 <> 0 GROUP BY device_id)",
)
def device_update(b: Base):
    version = F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.concat(F.lit("2."), F.col("event_id").cast("string")))
    updates = b.t.events.filter("event = 'app_open'").select("device_id", "created_at", "event_id", version.alias("app_version"))
    return ingest.update_devices(b.t.devices, updates, ["app_version"]).select("device_id", "platform", "app_version")


@query("C0a_rollup_vds", f"SELECT project_id, visitor_id, event_date, platform, {', '.join(METRICS)}, invited_by_id FROM vds")
def vds(b: Base):
    return b.vds


@query("C0b_rollup_lds", f"SELECT project_id, link_id, event_date, platform, {', '.join(METRICS)} FROM lds")
def lds(b: Base):
    return b.lds


@query("C0c_bulk_upsert", f"SELECT project_id, visitor_id, event_date, platform, {', '.join(METRICS)} FROM vds")
def upsert(b: Base):
    halves = [rollups.by_visitor(b.enriched.filter(f"event_id % 2 = {k}"), b.t.visitors).drop("invited_by_id") for k in (0, 1)]
    return rollups.upsert(halves[0], halves[1], ["project_id", "visitor_id", "event_date", "platform"], METRICS)


@query("C1_daily_project_metrics", "SELECT * FROM dpm")
def dpm(b: Base):
    return b.dpm


@query("C1_1_visitor_stats", "SELECT * FROM vs")
def visitor_stats(b: Base):
    return rollups.visitor_stats(b.vds)


@query("C1_2_link_stats", "SELECT * FROM ls")
def link_stats(b: Base):
    return rollups.link_stats(b.lds)


@query("C1_3_returning_users", "SELECT project_id, event_date, platform, n AS returning_users FROM ret")
def returning(b: Base):
    return rollups.visit_kinds(b.vds).filter("returning_users > 0").select(*rollups.PROJECT_KEYS, "returning_users")


@query("C1_4_first_time_visitors", "SELECT project_id, event_date, platform, n AS first_time_visitors FROM firsts")
def first_time(b: Base):
    return rollups.visit_kinds(b.vds).filter("first_time_visitors > 0").select(*rollups.PROJECT_KEYS, "first_time_visitors")


@query("C1_5_new_users", "SELECT project_id, event_date, platform, n_new AS new_users FROM firsts WHERE n_new > 0")
def new_users(b: Base):
    return rollups.visit_kinds(b.vds).filter("new_users > 0").select(*rollups.PROJECT_KEYS, "new_users")


@query("C1_6_referred_users", "SELECT project_id, event_date, platform, n AS referred_users FROM rf")
def referred(b: Base):
    return rollups.referred_users(b.vds)


@query("C1_7_revenue_stats", "SELECT * FROM rs WHERE revenue <> 0 OR units_sold <> 0 OR cancellations <> 0 OR first_time_purchases <> 0")
def revenue_stats(b: Base):
    return rollups.revenue_stats(b.iapds)


@query("C1_8_derived", "SELECT project_id, event_date, platform, installs, organic_users, installs - organic_users AS link_driven FROM dpm")
def derived(b: Base):
    return b.dpm.select(*rollups.PROJECT_KEYS, "installs", "organic_users", (F.col("installs") - F.col("organic_users")).alias("link_driven"))


@query("C2_project_dau", "SELECT * FROM dau")
def dau(b: Base):
    return b.dau


@query("C3_backfill", f"SELECT * FROM dpm WHERE event_date BETWEEN DATE '{START}' AND DATE '{END}'")
def backfill_range(b: Base):
    return b.dpm.filter(F.col("event_date").between(F.lit(START).cast("date"), F.lit(END).cast("date")))


@query("C4_first_visit", "SELECT project_id, f AS event_date, platform, count(*) AS first_time_visitors FROM (SELECT project_id, visitor_id, platform, min(event_date) AS f FROM vds GROUP BY ALL) x GROUP BY project_id, f, platform")
def first_visit(b: Base):
    return rollups.first_visits(b.vds)


@query("C5_increment_dpm", "SELECT project_id, platform, event_date, revenue + 100 AS revenue, units_sold + 1 AS units_sold, cancellations FROM dpm")
def increment(b: Base):
    keys, metrics = ["project_id", "platform", "event_date"], ["revenue", "units_sold", "cancellations"]
    old = b.dpm.select(*keys, *metrics)
    delta = old.select(*keys, F.lit(100).cast("long").alias("revenue"), F.lit(1).cast("long").alias("units_sold"), F.lit(None).cast("long").alias("cancellations"))
    return rollups.upsert(old, delta, keys, metrics)


@query("C6_aggregate_by_visitor", f"SELECT visitor_id, {sums()} FROM vds WHERE event_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY visitor_id")
def by_visitor(b: Base):
    return rollups.totals(b.vds, "visitor_id", START, END)


@query("C6_aggregate_by_link", f"SELECT link_id, {sums()} FROM lds WHERE event_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY link_id")
def by_link(b: Base):
    return rollups.totals(b.lds, "link_id", START, END, "installs")

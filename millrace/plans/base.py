"""The domain's derived tables over one folder of the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import ingest, revenue, rollups
from millrace.schemas import EVENT_METRICS, METRICS
from millrace.sources.adapter import VIEWS, tables

PROJECT, START, END = 1, "2024-01-08", "2024-01-21"
RANGE = f"event_date BETWEEN DATE '{START}' AND DATE '{END}'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Base:
    """Tables by name; each is planned when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.t = spark, sf_dir, tables(spark, sf_dir)

    @cached_property
    def referrals(self) -> DataFrame:
        return ingest.referrals(self.t.events, self.t.links, self.t.visitors)

    @cached_property
    def events(self) -> DataFrame:
        """All events, those that follow from referrals too."""
        return self.t.events.unionByName(ingest.referral_events(self.referrals))

    @cached_property
    def enriched(self) -> DataFrame:
        return ingest.enrich(self.events, self.t.devices, self.t.links)

    @cached_property
    def vds(self) -> DataFrame:
        return rollups.by_visitor(self.enriched, self.t.visitors)

    @cached_property
    def lds(self) -> DataFrame:
        return rollups.by_link(self.enriched, self.t.visitors)

    @cached_property
    def priced(self) -> DataFrame:
        return revenue.deltas(revenue.countable(self.t.purchases), self.t.devices)

    @cached_property
    def iapds(self) -> DataFrame:
        return revenue.product_days(self.priced)

    @cached_property
    def products(self) -> DataFrame:
        return revenue.products(self.priced)

    @cached_property
    def dpm(self) -> DataFrame:
        return rollups.daily_project_metrics(self.vds, self.lds, self.iapds)

    @cached_property
    def dau(self) -> DataFrame:
        return rollups.daily_active_users(self.vds)

    @cached_property
    def instances(self) -> DataFrame:
        """Instance 1 has projects 1 and 2, instance 2 has project 3."""
        return self.spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "instance_id long, project_id long")

    @cached_property
    def actions(self) -> DataFrame:
        """Every event with a link as an action."""
        return self.t.events.filter("link_id is not null").select(F.col("event_id").alias("action_id"), "device_id", "link_id", F.col("created_at").alias("at"))


def query(name: str, oracle: str | None = None, ctes: str = ""):
    """Register a function of a Base; its SQL sees the tables of SQL_BASE and ``ctes``."""

    def register(f: Callable[[Base], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Base(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = SQL_BASE + (",\n" + ctes if ctes else "") + "\n" + oracle
        return f

    return register


def sums(prefix: str = "", table: str = "", names: list[str] = METRICS, zero: bool = True) -> str:
    """Sums of metric columns as SQL."""
    one = lambda m: f"sum({table}{m})"
    return ", ".join(f"CAST({f'coalesce({one(m)}, 0)' if zero else one(m)} AS BIGINT) AS {prefix}{m}" for m in names)


def _by_type() -> str:
    out = []
    for event, metric in EVENT_METRICS.items():
        value = "coalesce(engagement_time, 0)" if event == "time_spent" else "1"
        out.append(f"CAST(sum(CASE WHEN event = '{event}' THEN {value} ELSE 0 END) AS BIGINT) AS {metric}")
    return ", ".join(out) + ", CAST(0 AS BIGINT) AS revenue"


SQL_BASE = (
    "WITH RECURSIVE "
    + ",\n".join(f"{name} AS ({text})" for name, text in VIEWS.items())
    + f""",
all_events AS (
  SELECT event_id, created_at, event_date, device_id, project_id, event, link_id, engagement_time FROM a_events
  UNION ALL
  SELECT e.event_id, e.created_at, e.event_date, r.device_id, e.project_id, 'user_referred', NULL, NULL
  FROM a_events e JOIN a_visitors i ON i.project_id = e.project_id AND i.device_id = e.device_id
  JOIN a_links l ON l.link_id = e.link_id JOIN a_visitors r ON r.visitor_id = l.visitor_id
  WHERE e.event IN ('install', 'reinstall')
),
en AS (
  SELECT a.event_id, a.created_at, a.event_date, a.device_id, a.project_id, a.event, l.link_id, a.engagement_time, l.path,
         d.platform AS raw_platform, CASE WHEN d.platform IN ('ios', 'android') THEN d.platform ELSE 'web' END AS platform,
         d.app_version, v.visitor_id, v.inviter_id
  FROM all_events a JOIN a_devices d ON d.device_id = a.device_id
  JOIN a_visitors v ON v.project_id = a.project_id AND v.device_id = a.device_id
  LEFT JOIN a_links l ON l.link_id = a.link_id
),
vds AS (
  SELECT project_id, visitor_id, event_date, platform, {_by_type()}, min(inviter_id) AS invited_by_id
  FROM en GROUP BY project_id, visitor_id, event_date, platform
),
lds AS (
  SELECT project_id, link_id, event_date, platform, {_by_type()}
  FROM en WHERE link_id IS NOT NULL GROUP BY project_id, link_id, event_date, platform
),
pr AS (
  SELECT p.*, CAST(p.date AS DATE) AS event_date,
         CASE WHEN p.store_source = 'apple' THEN 'ios' WHEN p.store_source = 'google' THEN 'android'
              WHEN d.platform IN ('ios', 'android') THEN d.platform ELSE 'web' END AS platform,
         CASE WHEN p.usd_price_cents = 0 THEN NULL
              WHEN p.event_type IN ('buy', 'refund_reversed') THEN p.usd_price_cents * p.quantity
              WHEN p.event_type = 'refund' THEN -p.usd_price_cents * p.quantity
              WHEN p.event_type = 'cancel' AND p.purchase_type IS DISTINCT FROM 'subscription' THEN -p.usd_price_cents * p.quantity END AS delta,
         p.event_type IN ('buy', 'refund_reversed') AS buy,
         p.event_type = 'cancel' OR (p.event_type = 'refund' AND p.purchase_type IS DISTINCT FROM 'subscription') AS cancellation
  FROM a_purchase_events p LEFT JOIN a_devices d ON d.device_id = p.device_id
  WHERE p.webhook_validated = true OR p.store = false
),
pf AS (
  SELECT *, buy AND device_id IS NOT NULL AND row_number() OVER (PARTITION BY project_id, device_id, product_id, buy ORDER BY date, event_id) = 1 AS first_time FROM pr
),
iapds AS (
  SELECT project_id, product_id, event_date, platform, CAST(coalesce(sum(delta), 0) AS BIGINT) AS revenue,
         CAST(sum(CASE WHEN buy THEN quantity ELSE 0 END) AS BIGINT) AS purchase_events,
         CAST(sum(CASE WHEN cancellation THEN quantity ELSE 0 END) AS BIGINT) AS canceled_events,
         CAST(sum(CASE WHEN first_time THEN 1 ELSE 0 END) AS BIGINT) AS first_time_purchases,
         CAST(sum(CASE WHEN buy AND device_id IS NOT NULL AND NOT first_time THEN 1 ELSE 0 END) AS BIGINT) AS repeat_purchases,
         CAST(sum(CASE WHEN device_id IS NOT NULL THEN coalesce(delta, 0) ELSE 0 END) AS BIGINT) AS device_revenue
  FROM pf GROUP BY project_id, product_id, event_date, platform
),
products AS (
  SELECT project_id, product_id, count(DISTINCT device_id) AS unique_purchasing_devices FROM pr WHERE buy AND device_id IS NOT NULL GROUP BY project_id, product_id
),
ret AS (
  SELECT project_id, event_date, platform, count(DISTINCT visitor_id) AS n FROM vds v
  WHERE EXISTS (SELECT 1 FROM vds w WHERE w.project_id = v.project_id AND w.platform = v.platform AND w.visitor_id = v.visitor_id AND w.event_date < v.event_date)
  GROUP BY project_id, event_date, platform
),
firsts AS (
  SELECT project_id, event_date, platform, count(DISTINCT visitor_id) AS n, count(DISTINCT CASE WHEN installs > 0 THEN visitor_id END) AS n_new FROM vds v
  WHERE NOT EXISTS (SELECT 1 FROM vds w WHERE w.project_id = v.project_id AND w.platform = v.platform AND w.visitor_id = v.visitor_id AND w.event_date < v.event_date)
  GROUP BY project_id, event_date, platform
),
keys AS (
  SELECT project_id, event_date, platform FROM vds UNION SELECT project_id, event_date, platform FROM lds
  UNION SELECT project_id, event_date, platform FROM iapds GROUP BY ALL HAVING sum(revenue) <> 0 OR sum(purchase_events) <> 0 OR sum(canceled_events) <> 0 OR sum(first_time_purchases) <> 0
),
vs AS (SELECT project_id, event_date, platform, {sums(names=["views", "opens", "installs", "reinstalls", "app_opens"])} FROM vds GROUP BY ALL),
ls AS (SELECT project_id, event_date, platform, CAST(sum(views) AS BIGINT) AS link_views, CAST(sum(installs) AS BIGINT) AS link_installs FROM lds GROUP BY ALL),
rf AS (SELECT project_id, event_date, platform, count(*) AS n FROM vds WHERE invited_by_id IS NOT NULL GROUP BY ALL),
rs AS (SELECT project_id, event_date, platform, CAST(sum(revenue) AS BIGINT) AS revenue, CAST(sum(purchase_events) AS BIGINT) AS units_sold, CAST(sum(canceled_events) AS BIGINT) AS cancellations, CAST(sum(first_time_purchases) AS BIGINT) AS first_time_purchases FROM iapds GROUP BY ALL),
dpm AS (
  SELECT k.project_id, k.event_date, k.platform, coalesce(vs.views, 0) AS views, coalesce(ls.link_views, 0) AS link_views, coalesce(vs.opens, 0) AS opens,
         coalesce(vs.installs, 0) + coalesce(vs.reinstalls, 0) AS installs, coalesce(vs.reinstalls, 0) AS reinstalls, coalesce(vs.app_opens, 0) AS app_opens,
         coalesce(ret.n, 0) AS returning_users, coalesce(rf.n, 0) AS referred_users,
         greatest(coalesce(vs.installs, 0) + coalesce(vs.reinstalls, 0) - coalesce(ls.link_installs, 0), 0) AS organic_users,
         coalesce(firsts.n_new, 0) AS new_users, coalesce(firsts.n, 0) AS first_time_visitors, coalesce(rs.revenue, 0) AS revenue,
         coalesce(rs.units_sold, 0) AS units_sold, coalesce(rs.cancellations, 0) AS cancellations, coalesce(rs.first_time_purchases, 0) AS first_time_purchases
  FROM keys k LEFT JOIN vs USING (project_id, event_date, platform) LEFT JOIN ls USING (project_id, event_date, platform)
  LEFT JOIN ret USING (project_id, event_date, platform) LEFT JOIN firsts USING (project_id, event_date, platform)
  LEFT JOIN rf USING (project_id, event_date, platform) LEFT JOIN rs USING (project_id, event_date, platform)
),
dau AS (SELECT project_id, event_date, platform, count(DISTINCT visitor_id) AS active_users FROM vds GROUP BY ALL),
cal AS (SELECT CAST(d AS DATE) AS event_date FROM generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 DAY) g(d)),
instances(instance_id, project_id) AS (VALUES (CAST(1 AS BIGINT), CAST(1 AS BIGINT)), (1, 2), (2, 3)),
actions AS (SELECT event_id AS action_id, device_id, link_id, created_at AS at FROM a_events WHERE link_id IS NOT NULL)"""
)

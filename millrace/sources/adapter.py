"""The domain's tables as views over the driver's tables: one SQL text a view, for Spark and DuckDB alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "a_devices": """
SELECT DISTINCT user_id AS device_id,
       CASE user_id % 5 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' WHEN 2 THEN 'web' WHEN 3 THEN 'mac' ELSE NULL END AS platform,
       concat('1.', CAST(user_id % 4 AS STRING)) AS app_version
FROM events""",
    "a_visitors": """
SELECT DISTINCT user_id AS visitor_id, user_id AS device_id, 1 + user_id % 3 AS project_id,
       CASE WHEN user_id % 4 = 0 AND user_id >= 3 THEN user_id - 3 ELSE NULL END AS inviter_id,
       concat('user_', CAST(user_id AS STRING)) AS sdk_identifier
FROM events""",
    "a_links": """
SELECT p_partkey AS link_id, 1 + p_partkey % 3 AS project_id,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 24 END AS campaign_id,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 12 END AS visitor_id,
       p_name AS name, p_type AS title, concat('p', CAST(p_partkey AS STRING)) AS path, split(p_name, ' ') AS tags,
       p_size % 10 <> 0 AS active, p_size % 4 = 0 AS sdk_generated,
       CASE p_size % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'meta' ELSE NULL END AS ads_platform
FROM part""",
    "a_campaigns": """
SELECT CAST(n_nationkey AS BIGINT) AS campaign_id, CAST(1 + n_nationkey % 3 AS BIGINT) AS project_id, n_name AS name,
       n_nationkey % 8 = 7 AS archived
FROM nation""",
    "a_events": """
SELECT event_id, ts AS created_at, CAST(ts AS DATE) AS event_date, user_id AS device_id, 1 + user_id % 3 AS project_id,
       CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN CASE event_id % 2 WHEN 0 THEN 'open' ELSE 'app_open' END WHEN 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'reinstall' WHEN 1 THEN 'reactivation' ELSE 'install' END ELSE 'time_spent' END AS event,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE ((event_id + user_id) % own_links) * 3 + user_id % 3 END AS link_id,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS engagement_time
FROM events
LEFT JOIN (SELECT p_partkey % 3 AS part_rest, count(*) AS own_links FROM part GROUP BY p_partkey % 3) own ON part_rest = user_id % 3
WHERE event_type <> 'purchase'""",
    "a_purchase_events": """
SELECT event_id, ts AS date, 1 + user_id % 3 AS project_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS device_id,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE ((event_id + user_id) % own_links) * 3 + user_id % 3 END AS link_id,
       CASE (event_id + user_id) % 10 WHEN 0 THEN 'refund' WHEN 1 THEN 'cancel' WHEN 2 THEN 'refund_reversed' ELSE 'buy' END AS event_type,
       concat('prod_', CAST(event_id % 7 AS STRING)) AS product_id, CAST(round(value * 100) AS BIGINT) AS usd_price_cents,
       CAST(1 + event_id % 3 AS INT) AS quantity, event_id % 2 = 0 AS store,
       CASE (event_id + 2 * user_id) % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS webhook_validated,
       CASE event_id % 4 WHEN 0 THEN 'apple' WHEN 2 THEN 'google' ELSE NULL END AS store_source,
       CASE event_id % 3 WHEN 0 THEN 'subscription' WHEN 1 THEN 'one_time' ELSE NULL END AS purchase_type,
       concat('o_', CAST(user_id AS STRING), '_', CAST(event_id % 7 AS STRING)) AS original_transaction_id
FROM events
LEFT JOIN (SELECT p_partkey % 3 AS part_rest, count(*) AS own_links FROM part GROUP BY p_partkey % 3) own ON part_rest = user_id % 3
WHERE event_type = 'purchase'""",
}


@dataclass
class Tables:
    devices: DataFrame
    visitors: DataFrame
    links: DataFrame
    campaigns: DataFrame
    events: DataFrame
    purchases: DataFrame


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def view(name: str) -> DataFrame:
        text = VIEWS[name]
        raws = [raw for raw in ("events", "part", "nation") if f"FROM {raw}" in text]
        for raw in raws:
            text = text.replace(f"FROM {raw}", f"FROM {{{raw}}}")
        return spark.sql(text, **{raw: read(raw) for raw in raws})

    return Tables(*(view(x) for x in ("a_devices", "a_visitors", "a_links", "a_campaigns", "a_events", "a_purchase_events")))

"""Queries of purchases and revenue."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import expr
from millrace.operators import analytics, ingest
from millrace.operators import revenue as r
from millrace.plans.base import END, PROJECT, RANGE, START, Base, query

P = PROJECT
#: Units of a currency for one dollar (a fixed table for the queries).
RATES = {"EUR": 0.92, "GBP": 0.79, "JPY": 150.0}
CURRENCY = "CASE event_id % 5 WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR' WHEN 2 THEN 'gbp' WHEN 3 THEN 'JPY' ELSE 'XXX' END"
MOMENTS = f"date >= TIMESTAMP '{START} 00:00:00' AND date < TIMESTAMP '{END} 00:00:00' + INTERVAL 1 DAY"


@query("R1_to_usd_cents", f"SELECT event_id, CASE upper({CURRENCY}) WHEN 'USD' THEN usd_price_cents WHEN 'EUR' THEN CAST(round(usd_price_cents / 0.92::DOUBLE) AS BIGINT) WHEN 'GBP' THEN CAST(round(usd_price_cents / 0.79::DOUBLE) AS BIGINT) WHEN 'JPY' THEN CAST(round(usd_price_cents / 150.0::DOUBLE) AS BIGINT) END AS usd_cents FROM a_purchase_events")
def r1(b: Base):
    rates = b.spark.createDataFrame(list(RATES.items()), "code string, rate double")
    priced = b.t.purchases.withColumn("currency", F.expr(CURRENCY)).join(rates, F.upper("currency") == F.col("code"), "left")
    return priced.select("event_id", expr.to_usd_cents(F.col("usd_price_cents"), F.col("currency"), F.col("rate")).alias("usd_cents"))


@query("R2_purchase_class", "SELECT event_id, event_type = 'buy' OR event_type = 'refund_reversed' AS buy, event_type = 'cancel' OR (event_type = 'refund' AND coalesce(purchase_type, '') <> 'subscription') AS cancellation FROM a_purchase_events")
def r2(b: Base):
    return b.t.purchases.select("event_id", expr.is_buy(F.col("event_type")).alias("buy"), expr.is_cancellation(F.col("event_type"), F.col("purchase_type")).alias("cancellation"))


@query("R3_revenue_delta", "SELECT event_id, delta FROM pr")
def r3(b: Base):
    return b.priced.select("event_id", "delta")


@query("R4_purchase_platform", "SELECT event_id, platform FROM pr")
def r4(b: Base):
    return b.priced.select("event_id", "platform")


@query("R5_process_purchase_visitors", "SELECT p.project_id, v.visitor_id, p.event_date, p.platform, CAST(sum(delta) AS BIGINT) AS revenue FROM pr p JOIN a_visitors v ON v.project_id = p.project_id AND v.device_id = p.device_id WHERE delta <> 0 GROUP BY ALL")
def r5_visitors(b: Base):
    return r.visitor_revenue(b.priced, b.t.visitors)


@query("R5_process_purchase_links", "SELECT project_id, link_id, event_date, platform, CAST(sum(delta) AS BIGINT) AS revenue FROM pr WHERE delta <> 0 AND link_id IS NOT NULL GROUP BY ALL")
def r5_links(b: Base):
    return r.link_revenue(b.priced)


@query("R6_record_purchase", "SELECT * FROM iapds")
def r6(b: Base):
    return b.iapds


@query("R6_products", "SELECT * FROM products")
def r6_products(b: Base):
    return b.products


METRICS = f"""m AS (
  SELECT project_id, product_id, coalesce(array_to_string(list_sort(list(DISTINCT platform) FILTER (WHERE purchase_events > 0 OR revenue <> 0 OR canceled_events > 0)), ','), '') AS platforms,
         CAST(sum(purchase_events) AS BIGINT) AS units_sold, CAST(sum(first_time_purchases) AS BIGINT) AS first_time_purchases, CAST(sum(repeat_purchases) AS BIGINT) AS repeat_purchases,
         CAST(sum(canceled_events) AS BIGINT) AS cancellations, CAST(sum(revenue) AS BIGINT) AS revenue
  FROM iapds WHERE project_id = {P} AND {RANGE} GROUP BY project_id, product_id
), mm AS (
  SELECT m.*, (SELECT count(DISTINCT device_id) FROM a_purchase_events p WHERE p.project_id = {P} AND p.product_id = m.product_id AND p.event_type = 'buy' AND {MOMENTS}) AS unique_purchasers,
         round((SELECT CAST(sum(device_revenue) AS DOUBLE) FROM iapds i WHERE i.project_id = {P} AND i.product_id = m.product_id) / (SELECT unique_purchasing_devices FROM products q WHERE q.project_id = {P} AND q.product_id = m.product_id), 2) AS ltv
  FROM m
), people AS (SELECT count(DISTINCT visitor_id) AS n FROM vds WHERE project_id = {P} AND {RANGE})"""


@query("R7_revenue_metrics", "SELECT * FROM mm", METRICS)
def r7(b: Base):
    return r.revenue_metrics(b.iapds, b.products, b.t.purchases, P, START, END)


@query(
    "R8_with_arpu",
    "SELECT mm.*, CASE WHEN n > 0 THEN round(CAST(revenue AS DOUBLE) / n, 2) ELSE 0.0 END AS arpu, CASE WHEN unique_purchasers > 0 THEN round(CAST(revenue AS DOUBLE) / unique_purchasers, 2) ELSE 0.0 END AS arppu FROM mm, people",
    METRICS,
)
def r8(b: Base):
    return r.with_arpu(r.revenue_metrics(b.iapds, b.products, b.t.purchases, P, START, END), b.vds, P, START, END)


@query("R9_purchase_search", f"SELECT event_id, date, event_type, product_id FROM a_purchase_events WHERE project_id = {P} AND (store = false OR webhook_validated) AND event_type ILIKE '%refund\\_%' ESCAPE '\\' AND {MOMENTS} ORDER BY date DESC, event_id LIMIT 20")
def r9(b: Base):
    return analytics.page_of(r.search(b.t.purchases, P, START, END, "refund_"), 1, 20).select("event_id", "date", "event_type", "product_id")


@query("R10_revenue_correction", "SELECT project_id, product_id, event_date, platform, CAST(sum((usd_price_cents + 50 - usd_price_cents) * quantity) AS BIGINT) AS revenue FROM pr WHERE buy GROUP BY ALL")
def r10(b: Base):
    changes = b.priced.filter("buy").select("project_id", "product_id", "event_date", "platform", "quantity", F.col("usd_price_cents").alias("old_cents"), (F.col("usd_price_cents") + 50).alias("new_cents"))
    return r.price_corrections(changes)


@query(
    "R11_reattribution",
    """SELECT project_id, event_date, platform, CAST(sum(revenue) AS BIGINT) AS revenue, CAST(sum(units) AS BIGINT) AS units_sold, CAST(sum(cancelled) AS BIGINT) AS cancellations FROM (
         SELECT project_id, event_date, new AS platform, coalesce(delta, 0) AS revenue, CASE WHEN buy THEN 1 ELSE 0 END AS units, CASE WHEN cancellation THEN 1 ELSE 0 END AS cancelled FROM late WHERE new <> old
         UNION ALL SELECT project_id, event_date, old, -coalesce(delta, 0), CASE WHEN buy THEN -1 ELSE 0 END, CASE WHEN cancellation THEN -1 ELSE 0 END FROM late WHERE new <> old) x
       GROUP BY project_id, event_date, platform""",
    """late AS (SELECT p.project_id, p.event_date, p.delta, p.buy, p.cancellation, CASE WHEN d.platform IN ('ios', 'android') THEN d.platform ELSE 'web' END AS new,
       CASE p.store_source WHEN 'apple' THEN 'ios' WHEN 'google' THEN 'android' ELSE 'unknown' END AS old FROM pr p JOIN a_devices d ON d.device_id = p.device_id)""",
)
def r11(b: Base):
    return r.reattributions(b.priced, b.t.devices)


STATES = """states AS (
  SELECT project_id, original_transaction_id,
         arg_max(device_id, (date, event_id)) FILTER (WHERE device_id IS NOT NULL) AS device_id, arg_max(link_id, (date, event_id)) FILTER (WHERE link_id IS NOT NULL) AS link_id,
         arg_max(product_id, (date, event_id)) FILTER (WHERE product_id IS NOT NULL) AS product_id, arg_max(purchase_type, (date, event_id)) FILTER (WHERE purchase_type IS NOT NULL) AS purchase_type,
         arg_max(event_id, (date, event_id)) AS latest_event_id
  FROM a_purchase_events GROUP BY project_id, original_transaction_id
)"""


@query("R12_subscription_state", "SELECT * FROM states", STATES)
def r12(b: Base):
    return r.subscription_states(b.t.purchases)


@query(
    "R13_attribution_lookup",
    """SELECT p.project_id, p.original_transaction_id, CASE WHEN s.device_id IS NOT NULL OR s.link_id IS NOT NULL THEN s.device_id ELSE p.device_id END AS device_id,
       CASE WHEN s.device_id IS NOT NULL OR s.link_id IS NOT NULL THEN s.link_id ELSE p.link_id END AS link_id FROM prior p LEFT JOIN some_states s USING (project_id, original_transaction_id)""",
    STATES.replace("FROM a_purchase_events GROUP", "FROM a_purchase_events WHERE purchase_type = 'subscription' GROUP").replace("states AS", "some_states AS")
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id, original_transaction_id ORDER BY (device_id IS NOT NULL OR link_id IS NOT NULL) DESC, date DESC, event_id DESC) AS k FROM a_purchase_events),
prior AS (SELECT project_id, original_transaction_id, device_id, link_id FROM ranked WHERE k = 1)""",
)
def r13(b: Base):
    return r.attribution(b.t.purchases, r.subscription_states(b.t.purchases.filter("purchase_type = 'subscription'")))


@query(
    "R14_sdk_purchase_upsert",
    """SELECT p.event_id, coalesce(p.link_id, l.link_id) AS link_id FROM a_purchase_events p LEFT JOIN (
         SELECT project_id, device_id, link_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, visitor_id ORDER BY created_at DESC, event_id DESC) AS k FROM en WHERE link_id IS NOT NULL AND event <> 'user_referred') x WHERE k = 1
       ) l ON l.project_id = p.project_id AND l.device_id = p.device_id""",
)
def r14(b: Base):
    return r.attribute_from_last_visit(b.t.purchases, b.t.visitors, ingest.last_visits(b.t.events, b.t.visitors)).select("event_id", "link_id")


TXNS = "txns AS (SELECT *, CASE WHEN event_id % 4 = 1 THEN original_transaction_id ELSE original_transaction_id || '_' || (event_id % 3) END AS txn FROM a_purchase_events)"


def _match(done: str, by: str) -> str:
    """The least stored event with this flag, by transaction or by stored original transaction."""
    on = "o.txn = n.txn" if by == "txn" else "n.txn = n.original_transaction_id AND n.txn <> '' AND o.original_transaction_id = n.original_transaction_id"
    return f"(SELECT min(o.event_id) FROM txns o WHERE o.event_id % 2 = 0 AND o.project_id = n.project_id AND o.event_type = n.event_type AND o.webhook_validated = {done} AND {on})"


@query(
    "R15_webhook_match",
    f"""SELECT notice_id, coalesce(own, own_first, theirs, theirs_first) AS event_id,
       CASE WHEN coalesce(own, own_first) IS NOT NULL THEN 'validate' WHEN coalesce(theirs, theirs_first) IS NOT NULL THEN 'none' ELSE 'create' END AS action
       FROM (SELECT n.event_id AS notice_id, {_match("false", "txn")} AS own, {_match("false", "original")} AS own_first, {_match("true", "txn")} AS theirs, {_match("true", "original")} AS theirs_first FROM txns n) m""",
    TXNS,
)
def r15(b: Base):
    own = F.when(F.col("event_id") % 4 == 1, F.col("original_transaction_id")).otherwise(F.concat("original_transaction_id", F.lit("_"), (F.col("event_id") % 3).cast("string")))
    stored = b.t.purchases.withColumn("transaction_id", own)
    incoming = stored.select(F.col("event_id").alias("notice_id"), "project_id", "event_type", "transaction_id", "original_transaction_id")
    return r.match_webhooks(incoming, stored.filter("event_id % 2 = 0")).select("notice_id", "event_id", "action")


@query("R16_notification_event_maps", "SELECT event_id, CASE WHEN event_id % 21 IN (1, 2, 4, 7) THEN 'buy' WHEN event_id % 21 IN (3, 12, 13, 20) THEN 'cancel' END AS event_type FROM a_purchase_events")
def r16(b: Base):
    return b.t.purchases.select("event_id", r.google_event(F.col("event_id") % 21).alias("event_type"))


KINDS = ["SUBSCRIBED", "DID_RENEW", "DID_FAIL_TO_RENEW", "EXPIRED", "GRACE_PERIOD_EXPIRED", "REFUND", "REFUND_REVERSED", "REVOKE", "OFFER_REDEEMED", "ONE_TIME_CHARGE", "DID_CHANGE_RENEWAL_PREF", "DID_CHANGE_RENEWAL_STATUS", "TEST"]
SUBTYPES = [None, "UPGRADE", "DOWNGRADE", "GRACE_PERIOD", "BILLING_RETRY"]


@query(
    "R16_apple_event_map",
    f"""SELECT event_id, CASE WHEN kind IN ('SUBSCRIBED', 'DID_RENEW', 'ONE_TIME_CHARGE') THEN 'buy'
      WHEN kind = 'OFFER_REDEEMED' THEN CASE coalesce(subtype, '') WHEN 'UPGRADE' THEN 'change' WHEN 'DOWNGRADE' THEN NULL ELSE 'buy' END
      WHEN kind = 'DID_CHANGE_RENEWAL_PREF' AND subtype = 'UPGRADE' THEN 'change'
      WHEN kind = 'DID_FAIL_TO_RENEW' AND coalesce(subtype, '') NOT IN ('GRACE_PERIOD', 'BILLING_RETRY') THEN 'cancel'
      WHEN kind IN ('EXPIRED', 'GRACE_PERIOD_EXPIRED', 'REVOKE') THEN 'cancel' WHEN kind = 'REFUND' THEN 'refund' WHEN kind = 'REFUND_REVERSED' THEN 'refund_reversed' END AS event_type
    FROM (SELECT event_id, {KINDS!r}[1 + event_id % {len(KINDS)}] AS kind, {["" if x is None else x for x in SUBTYPES]!r}[1 + event_id % {len(SUBTYPES)}] AS subtype FROM a_purchase_events)""",
)
def r16_apple(b: Base):
    pick = lambda values: F.element_at(F.array(*[F.lit(x).cast("string") for x in values]), (F.col("event_id") % len(values) + 1).cast("int"))
    return b.t.purchases.select("event_id", r.apple_event(pick(KINDS), pick(SUBTYPES)).alias("event_type"))


@query(
    "R17_full_refund_qty",
    """SELECT b.event_id, b.original_transaction_id, b.product_id, CAST(greatest(b.quantity - coalesce((SELECT sum(quantity) FROM a_purchase_events r WHERE r.event_type = 'refund'
       AND r.original_transaction_id = b.original_transaction_id AND r.product_id = b.product_id), 0), 0) AS BIGINT) AS refundable FROM a_purchase_events b WHERE b.event_type = 'buy'""",
)
def r17(b: Base):
    return r.refund_quantities(b.t.purchases)


@query(
    "R18_product_change_cancel",
    """SELECT change_id, project_id, product_id AS canceled_product, event_id AS canceled_event, 't' || event_id || '_product_change_cancel' AS transaction_id FROM (
         SELECT c.event_id AS change_id, o.project_id, o.product_id, o.event_id, o.subscription, row_number() OVER (PARTITION BY c.event_id ORDER BY o.date DESC, o.event_id DESC) AS k
         FROM subs c JOIN subs o ON o.project_id = c.project_id AND o.subscription = c.subscription AND o.product_id <> c.product_id AND o.event_type = 'buy' AND o.event_id % 3 <> 0
         WHERE c.event_id % 3 = 0 AND c.event_type = 'buy') old
       WHERE k = 1 AND (SELECT arg_max(x.event_type, (x.date, x.event_id)) FROM subs x WHERE x.event_id % 3 <> 0 AND x.project_id = old.project_id AND x.subscription = old.subscription AND x.product_id = old.product_id) = 'buy'
       AND event_id % 10 <> 7""",
    "subs AS (SELECT *, 'o_' || device_id AS subscription FROM a_purchase_events)",
)
def r18(b: Base):
    named = b.t.purchases.withColumn("original_transaction_id", F.concat(F.lit("o_"), F.col("device_id").cast("string"))).withColumn("transaction_id", F.concat(F.lit("t"), F.col("event_id").cast("string")))
    changes = named.filter("event_id % 3 = 0 and event_type = 'buy'").select(F.col("event_id").alias("change_id"), "project_id", "original_transaction_id", "product_id")
    stored = named.filter("event_id % 3 <> 0")
    # Some were cancelled by an earlier change; those rows are of no product here.
    old = stored.filter("event_id % 10 = 7").withColumns({"transaction_id": F.concat("transaction_id", F.lit("_product_change_cancel")), "event_type": F.lit("cancel"), "original_transaction_id": F.lit(None).cast("string")})
    return r.product_change_cancels(stored.unionByName(old), changes)


@query("R19_price_units", "SELECT event_id, CAST(floor((usd_price_cents - 3000) / 10.0) AS BIGINT) AS apple, CAST(floor((usd_price_cents - 3000) / 10000.0) AS BIGINT) AS google FROM a_purchase_events")
def r19(b: Base):
    price = F.col("usd_price_cents") - 3000
    return b.t.purchases.select("event_id", expr.milliunits_to_cents(price).alias("apple"), expr.micros_to_cents(price).alias("google"))


@query("R20_original_transaction_id", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'GPA.' || event_id ELSE 'GPA.x' || event_id END AS original_id FROM (SELECT event_id FROM a_purchase_events) p WHERE event_id % 2 = 1 UNION ALL SELECT event_id, 'GPA' FROM a_purchase_events WHERE event_id % 2 = 0")
def r20(b: Base):
    order = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("GPA."), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("GPA.x"), F.col("event_id").cast("string"), F.lit("."), (F.col("event_id") % 9).cast("string")))
    return b.t.purchases.select("event_id", expr.original_transaction(order).alias("original_id"))


@query("R23_enqueue_unprocessed", "SELECT event_id FROM a_purchase_events WHERE event_id % 3 <> 0 AND (webhook_validated = true OR store = false)")
def r23(b: Base):
    return r.unprocessed(b.t.purchases.withColumn("processed", F.col("event_id") % 3 == 0)).select("event_id")


@query("Q35_revenue_debug", "SELECT l.link_id, l.name, p.event_date, p.platform, CAST(sum(p.delta) AS BIGINT) AS revenue FROM pr p JOIN a_links l ON l.link_id = p.link_id WHERE p.delta <> 0 GROUP BY ALL")
def q35(b: Base):
    return r.link_revenue(b.priced).join(b.t.links.select("link_id", "name"), "link_id").select("link_id", "name", "event_date", "platform", "revenue")

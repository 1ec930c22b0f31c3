"""Purchases: signed revenue, product rollups, subscription states, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expr import is_buy, is_cancellation, like_term, metric_platform, purchase_platform, ratio, revenue_delta, validated

ORDER = ("date", "event_id")


def deltas(purchases: DataFrame, devices: DataFrame) -> DataFrame:
    """Every purchase event with its platform, day and signed cents."""
    own = devices.select("device_id", F.col("platform").alias("_device"))
    joined = purchases.join(own, "device_id", "left")
    return joined.withColumns({
        "platform": purchase_platform(F.col("store_source"), F.col("_device")),
        "event_date": F.to_date("date"),
        "delta": revenue_delta(F.col("event_type"), F.col("purchase_type"), F.col("usd_price_cents"), F.col("quantity")),
        "buy": is_buy(F.col("event_type")),
        "cancellation": is_cancellation(F.col("event_type"), F.col("purchase_type")),
    }).drop("_device")


def countable(purchases: DataFrame) -> DataFrame:
    """Purchases that a store confirmed, or that are from no store."""
    return purchases.filter(validated(F.col("store"), F.col("webhook_validated")))


def visitor_revenue(priced: DataFrame, visitors: DataFrame) -> DataFrame:
    own = priced.filter("delta is not null and delta <> 0").join(visitors.select("project_id", "device_id", "visitor_id"), ["project_id", "device_id"])
    return own.groupBy("project_id", "visitor_id", "event_date", "platform").agg(F.sum("delta").alias("revenue"))


def link_revenue(priced: DataFrame) -> DataFrame:
    own = priced.filter("delta is not null and delta <> 0 and link_id is not null")
    return own.groupBy("project_id", "link_id", "event_date", "platform").agg(F.sum("delta").alias("revenue"))


def first_purchases(priced: DataFrame) -> DataFrame:
    """Marks each device's first buy of a product. Only buys of known devices are ordered."""
    known = F.col("buy") & F.col("device_id").isNotNull()
    order = Window.partitionBy("project_id", "device_id", "product_id").orderBy(*ORDER)
    marked = priced.filter(known).withColumn("first_time", F.row_number().over(order) == 1)
    return marked.unionByName(priced.filter(~F.coalesce(known, F.lit(False))).withColumn("first_time", F.lit(False)))


def product_days(priced: DataFrame) -> DataFrame:
    """One row for each project, product, date and platform; purchases without a product have none."""
    marked = first_purchases(priced.filter("trim(product_id) <> ''"))
    known = F.col("device_id").isNotNull()
    zero = F.lit(0).cast("long")
    money = F.coalesce(F.col("delta"), zero)
    count = lambda c, x=F.lit(1): F.coalesce(F.sum(F.when(c, x)), zero).cast("long")  # noqa: E731, B008
    return marked.groupBy("project_id", "product_id", "event_date", "platform").agg(
        F.sum(money).alias("revenue"),
        count(F.col("buy"), F.col("quantity")).alias("purchase_events"),
        count(F.col("cancellation"), F.col("quantity")).alias("canceled_events"),
        count(F.col("first_time")).alias("first_time_purchases"),
        count(F.col("buy") & known & ~F.col("first_time")).alias("repeat_purchases"),
        count(known, money).alias("device_revenue"),
    )


def products(priced: DataFrame) -> DataFrame:
    """How many devices ever bought each product."""
    bought = priced.filter("buy and device_id is not null and trim(product_id) <> ''")
    return bought.groupBy("project_id", "product_id").agg(F.count_distinct("device_id").alias("unique_purchasing_devices"))


def revenue_metrics(days: DataFrame, all_products: DataFrame, purchases: DataFrame, project: int, start: str, end: str, product: str | None = None, platforms: list[str] | None = None) -> DataFrame:
    """Products in a range: activity, purchasers in the range, and life-time value over all time. The two scalars that
    are not of the range are aggregated on their own and joined."""
    own = days.filter(F.col("project_id") == project)
    if platforms:
        own = own.filter(F.col("platform").isin(platforms))
    ranged = own.filter(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if product:
        ranged = ranged.filter(F.col("product_id").ilike(like_term(product)))
    active = (F.col("purchase_events") > 0) | (F.col("revenue") != 0) | (F.col("canceled_events") > 0)
    made = ranged.groupBy("project_id", "product_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(active, F.col("platform")))), ",").alias("platforms"),
        F.sum("purchase_events").alias("units_sold"), F.sum("first_time_purchases").alias("first_time_purchases"), F.sum("repeat_purchases").alias("repeat_purchases"), F.sum("canceled_events").alias("cancellations"), F.sum("revenue").alias("revenue"),
    )
    buys = purchases.filter((F.col("project_id") == project) & (F.col("event_type") == "buy") & F.col("device_id").isNotNull())
    buys = buys.filter((F.col("date") >= F.lit(start).cast("timestamp_ntz")) & (F.col("date") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))
    people = buys.groupBy("product_id").agg(F.count_distinct("device_id").alias("unique_purchasers"))
    life = own.groupBy("product_id").agg(F.sum("device_revenue").alias("_life"))
    owners = all_products.filter(F.col("project_id") == project).select("product_id", "unique_purchasing_devices")
    joined = made.join(people, "product_id", "left").join(life, "product_id", "left").join(owners, "product_id", "left")
    return joined.withColumn("unique_purchasers", F.coalesce("unique_purchasers", F.lit(0))).withColumn("ltv", ratio(F.col("_life"), F.col("unique_purchasing_devices"), 2)).drop("_life", "unique_purchasing_devices")


def with_arpu(metrics: DataFrame, vds: DataFrame, project: int, start: str, end: str) -> DataFrame:
    """Revenue per visitor of the range and per purchaser."""
    people = vds.filter((F.col("project_id") == project) & F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).agg(F.count_distinct("visitor_id").alias("_people"))
    # ``people`` is one row.
    return metrics.crossJoin(people).withColumns({"arpu": ratio(F.col("revenue"), F.col("_people"), 2), "arppu": ratio(F.col("revenue"), F.col("unique_purchasers"), 2)}).drop("_people")


def search(purchases: DataFrame, project: int, start: str, end: str, term: str | None = None) -> DataFrame:
    """A project's countable purchases in a range, newest first."""
    found = countable(purchases).filter((F.col("project_id") == project) & (F.col("date") >= F.lit(start).cast("timestamp_ntz")) & (F.col("date") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))
    if term:
        found = found.filter(F.col("event_type").ilike(like_term(term)))
    return found.orderBy(F.desc("date"), "event_id")


def price_corrections(changes: DataFrame) -> DataFrame:
    """(project, product, date, platform, quantity, old, new cents): what a changed price adds; counts stay."""
    return changes.withColumn("revenue", ((F.col("new_cents") - F.coalesce("old_cents", F.lit(0))) * F.col("quantity")).cast("long")).groupBy("project_id", "product_id", "event_date", "platform").agg(F.sum("revenue").alias("revenue"))


def subscription_states(purchases: DataFrame) -> DataFrame:
    """Each original transaction's last known device, link, product and kind; the latest event always counts."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*ORDER))).alias(c)
    return purchases.groupBy("project_id", "original_transaction_id").agg(*[last(c) for c in ("device_id", "link_id", "product_id", "purchase_type")], F.max_by("event_id", F.struct(*ORDER)).alias("latest_event_id"))


def attribution(purchases: DataFrame, states: DataFrame) -> DataFrame:
    """Device and link of every original transaction: the subscription's, else the latest purchase's that has either."""
    either = F.col("device_id").isNotNull() | F.col("link_id").isNotNull()
    prior = purchases.groupBy("project_id", "original_transaction_id").agg(F.max_by(F.struct("device_id", "link_id"), F.when(either, F.struct(*ORDER))).alias("_prior"))
    known = states.select("project_id", "original_transaction_id", F.struct("device_id", "link_id").alias("_state"))
    joined = prior.join(known, ["project_id", "original_transaction_id"], "left")
    use = F.when(F.col("_state.device_id").isNotNull() | F.col("_state.link_id").isNotNull(), F.col("_state")).otherwise(F.col("_prior"))
    return joined.select("project_id", "original_transaction_id", use["device_id"].alias("device_id"), use["link_id"].alias("link_id"))


def attribute_from_last_visit(purchases: DataFrame, visitors: DataFrame, visits: DataFrame) -> DataFrame:
    """Purchases without a link take the link of their visitor's last visit."""
    people = visitors.select("project_id", "device_id", "visitor_id").join(visits.select("project_id", "visitor_id", F.col("link_id").alias("_last")), ["project_id", "visitor_id"])
    joined = purchases.join(people.drop("visitor_id"), ["project_id", "device_id"], "left")
    return joined.withColumn("link_id", F.coalesce("link_id", "_last")).drop("_last")


def match_webhooks(incoming: DataFrame, stored: DataFrame, validated_by_original: bool = True) -> DataFrame:
    """For each incoming (notice_id, project_id, event_type, transaction_id, original_transaction_id) what to do: validate
    an unvalidated event (the flag is false; null is neither) of the transaction, else of the original one; do nothing if
    there is a validated one of the transaction, else (unless ``validated_by_original`` is off) of the original one; else create.
    The original one counts only for a first purchase, whose two ids are the same. Of several the least event_id counts."""
    keys = ["project_id", "event_type"]
    s = stored.filter("webhook_validated is not null").select(*keys, F.col("transaction_id").alias("_txn"), F.col("original_transaction_id").alias("_original"), "event_id", F.col("webhook_validated").alias("_done"))
    i = incoming.select("notice_id", *keys, "transaction_id", F.coalesce("original_transaction_id", "transaction_id").alias("_first"))
    by_txn = i.join(s.withColumn("transaction_id", F.col("_txn")), [*keys, "transaction_id"]).select("notice_id", "event_id", "_done", F.lit(0).alias("_by"))
    first = i.filter((F.trim("transaction_id") != "") & (F.col("transaction_id") == F.col("_first")))
    by_original = first.join(s.withColumn("_first", F.col("_original")), [*keys, "_first"]).select("notice_id", "event_id", "_done", F.lit(1).alias("_by"))
    if not validated_by_original:
        by_original = by_original.filter("not _done")
    best = by_txn.union(by_original).groupBy("notice_id").agg(F.min(F.struct("_done", "_by", "event_id")).alias("_best"))
    joined = incoming.join(best, "notice_id", "left").withColumns({"event_id": F.col("_best.event_id"), "_done": F.col("_best._done")})
    return joined.withColumn("action", F.when(F.col("event_id").isNull(), "create").when(F.col("_done"), "none").otherwise("validate")).drop("_done", "_best")


#: What a store's notice means for purchases (fixed values).
GOOGLE_EVENTS = {1: "buy", 2: "buy", 3: "cancel", 4: "buy", 7: "buy", 12: "cancel", 13: "cancel", 20: "cancel"}


def google_event(code):
    """The event type of a store's numbered notice; null for the others."""
    out = None
    for number, name in GOOGLE_EVENTS.items():
        out = (F if out is None else out).when(code == number, F.lit(name))
    return out


#: The same of the other store, by type, or by type and subtype; a subtype of its own comes before its type (fixed values).
APPLE_EVENTS = {
    "SUBSCRIBED": "buy",
    "DID_RENEW": "buy",
    "ONE_TIME_CHARGE": "buy",
    "OFFER_REDEEMED": "buy",
    "EXPIRED": "cancel",
    "GRACE_PERIOD_EXPIRED": "cancel",
    "REVOKE": "cancel",
    "DID_FAIL_TO_RENEW": "cancel",
    "REFUND": "refund",
    "REFUND_REVERSED": "refund_reversed",
}
APPLE_SUBTYPES = {
    ("DID_CHANGE_RENEWAL_PREF", "UPGRADE"): "change",
    ("OFFER_REDEEMED", "UPGRADE"): "change",
    ("OFFER_REDEEMED", "DOWNGRADE"): None,
    ("DID_FAIL_TO_RENEW", "GRACE_PERIOD"): None,
    ("DID_FAIL_TO_RENEW", "BILLING_RETRY"): None,
}


def apple_event(kind, subtype):
    """The event type of a store's named notice: null for those that are no purchase's, ``change`` for an upgrade, which
    cancels the product before and buys the new one (``product_change_cancels``)."""
    by_type = F.create_map(*[F.lit(x) for pair in APPLE_EVENTS.items() for x in pair])
    by_subtype = F.create_map(*[x for (a, b), name in APPLE_SUBTYPES.items() for x in (F.lit(f"{a}/{b}"), F.lit(name).cast("string"))])
    both = F.concat_ws("/", kind, subtype)
    return F.when(F.map_contains_key(by_subtype, both), by_subtype[both]).otherwise(by_type[kind])


def reattributions(priced: DataFrame, devices: DataFrame) -> DataFrame:
    """What late devices move: purchases counted under their store's platform (or ``unknown``) before the device was known go
    from there to the device's platform. Deltas by project, date and platform, to be added to a day's metrics."""
    own = priced.select("project_id", "event_date", "device_id", "store_source", "delta", "buy", "cancellation").join(devices.select("device_id", metric_platform(F.col("platform")).alias("_new")), "device_id")
    own = own.withColumn("_old", F.when(F.col("store_source") == "apple", "ios").when(F.col("store_source") == "google", "android").otherwise("unknown")).filter("_old <> _new")
    ways = own.withColumn("_way", F.explode(F.array(F.struct(F.col("_new").alias("platform"), F.lit(1).alias("sign")), F.struct(F.col("_old").alias("platform"), F.lit(-1).alias("sign")))))
    sign = F.col("_way.sign")
    total = lambda c: F.sum(sign * c).cast("long")
    return ways.groupBy("project_id", "event_date", F.col("_way.platform").alias("platform")).agg(
        total(F.coalesce("delta", F.lit(0))).alias("revenue"), total(F.coalesce("buy", F.lit(False)).cast("int")).alias("units_sold"), total(F.coalesce("cancellation", F.lit(False)).cast("int")).alias("cancellations")
    )


def refund_quantities(purchases: DataFrame) -> DataFrame:
    """What is left to refund of each buy: its quantity less what its transaction and product had refunded."""
    key = ["original_transaction_id", "product_id"]
    refunded = purchases.filter("event_type = 'refund'").groupBy(*key).agg(F.sum("quantity").alias("_refunded"))
    bought = purchases.filter("event_type = 'buy'").join(refunded, key, "left")
    return bought.select("event_id", *key, F.greatest(F.col("quantity") - F.coalesce("_refunded", F.lit(0)), F.lit(0)).cast("long").alias("refundable"))


def product_change_cancels(purchases: DataFrame, changes: DataFrame) -> DataFrame:
    """For each change (change_id, project_id, original_transaction_id, product_id: the new one) the buy to cancel: the
    last buy of another product of the subscription, if that product's latest event is a buy, and unless it was cancelled by a
    change already. Times are those of ``date``, then event_id."""
    group = ["project_id", "original_transaction_id"]
    order = F.struct(*ORDER)
    bought = F.when(F.col("event_type") == "buy", order)
    last = purchases.filter("trim(original_transaction_id) <> ''").groupBy(*group, F.col("product_id").alias("canceled_product")).agg(
        F.max(bought).alias("_at"), F.max_by("event_id", bought).alias("canceled_event"), F.max_by("transaction_id", bought).alias("_txn"), F.max_by("event_type", order).alias("_latest")
    )
    found = changes.filter("trim(product_id) <> ''").join(last.filter("_at is not null"), group).filter("canceled_product <> product_id")
    best = found.groupBy("change_id", "project_id").agg(F.max_by(F.struct("canceled_product", "canceled_event", "_txn", "_latest"), "_at").alias("_best")).select("change_id", "project_id", "_best.*")
    made = best.filter("_latest = 'buy'").withColumn("transaction_id", F.concat("_txn", F.lit("_product_change_cancel")))
    return made.join(purchases.select("project_id", "transaction_id"), ["project_id", "transaction_id"], "left_anti").select("change_id", "project_id", "canceled_product", "canceled_event", "transaction_id")


def pick_price(prices):
    """The price of the US, else in EUR, else the first, of an array of (region, currency, micros)."""
    us = F.get(F.filter(prices, lambda p: p["region"] == "US"), 0)
    euro = F.get(F.filter(prices, lambda p: p["currency"] == "EUR"), 0)
    return F.coalesce(us, euro, F.get(prices, 0))


def unprocessed(purchases: DataFrame) -> DataFrame:
    """Countable purchases that are not processed."""
    return countable(purchases.filter(~F.coalesce("processed", F.lit(False))))

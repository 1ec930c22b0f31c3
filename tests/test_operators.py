"""Operators on small frames with known results."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import expr
from millrace.operators import analytics, attribution, ingest, notifications, revenue, rollups
from millrace.plans.base import Base
from millrace.schemas import METRICS

FOLDER = "/root/testdata/sf0.001"


def at(text):
    return dt.datetime.fromisoformat(text)


def day(text):
    return dt.date.fromisoformat(text)


def daily(spark, rows, key="visitor_id"):
    """Rollup rows from (project, key, date, platform, {metric: value}, inviter)."""
    schema = f"project_id long, {key} long, event_date date, platform string, {', '.join(f'{m} long' for m in METRICS)}, invited_by_id long"
    return spark.createDataFrame([(p, k, day(d), pf, *[m.get(x, 0) for x in METRICS], i) for p, k, d, pf, m, i in rows], schema)


def products(spark, rows=()):
    return spark.createDataFrame(list(rows), "project_id long, event_date date, platform string, revenue long, purchase_events long, canceled_events long, first_time_purchases long")


def value(df):
    return df.collect()[0][0]


def test_project_day_from_rollups(spark):
    vds = daily(spark, [(1, 1, "2026-03-01", "ios", {"views": 50, "opens": 20, "installs": 5, "reinstalls": 1}, None)])
    lds = daily(spark, [(1, k, "2026-03-01", "ios", {"views": v}, None) for k, v in ((1, 100), (2, 20), (3, 150))], "link_id").drop("invited_by_id")
    row = rollups.daily_project_metrics(vds, lds, products(spark)).collect()[0]
    assert (row.views, row.opens, row.installs, row.link_views, row.first_time_visitors) == (50, 20, 6, 270, 1)


def test_organic_users_are_not_negative(spark):
    vds = daily(spark, [(1, 1, "2026-03-01", "ios", {"installs": 2}, None)])
    lds = daily(spark, [(1, 1, "2026-03-01", "ios", {"installs": 100}, None)], "link_id").drop("invited_by_id")
    assert rollups.daily_project_metrics(vds, lds, products(spark)).collect()[0].organic_users == 0


def test_returning_and_first_time(spark):
    vds = daily(spark, [(1, 1, "2026-03-01", "ios", {}, None), (1, 1, "2026-03-02", "ios", {}, 9), (1, 1, "2026-03-02", "web", {"installs": 1}, None)])
    got = {(str(r.event_date), r.platform): (r.returning_users, r.first_time_visitors, r.new_users) for r in rollups.visit_kinds(vds).collect()}
    assert got == {("2026-03-01", "ios"): (0, 1, 0), ("2026-03-02", "ios"): (1, 0, 0), ("2026-03-02", "web"): (0, 1, 1)}
    assert rollups.referred_users(vds).collect()[0].referred_users == 1


def test_parts_that_only_products_have(spark):
    none = daily(spark, [])
    iapds = products(spark, [(2, day("2026-03-01"), "android", 500, 1, 0, 1), (2, day("2026-03-02"), "android", 0, 0, 0, 0)])
    rows = rollups.daily_project_metrics(none, none.withColumnRenamed("visitor_id", "link_id").drop("invited_by_id"), iapds).collect()
    assert [(r.project_id, r.revenue, r.units_sold, r.views) for r in rows] == [(2, 500, 1, 0)]


def test_upsert_adds_and_keeps_the_first_inviter(spark):
    old = daily(spark, [(1, 1, "2026-03-01", "ios", {"views": 2}, None), (1, 2, "2026-03-01", "ios", {"views": 1}, 5)])
    new = daily(spark, [(1, 1, "2026-03-01", "ios", {"views": 3}, 7), (1, 2, "2026-03-01", "ios", {"views": 1}, 8)])
    keys = ["project_id", "visitor_id", "event_date", "platform"]
    got = {r.visitor_id: (r.views, r.invited_by_id) for r in rollups.upsert(old, new, keys, METRICS, ("invited_by_id",)).collect()}
    assert got == {1: (5, 7), 2: (2, 5)}


def test_rollups_add_up(spark):
    b = Base(spark, FOLDER)
    halves = [rollups.by_visitor(b.enriched.filter(f"event_id % 2 = {k}"), b.t.visitors) for k in (0, 1)]
    keys = ["project_id", "visitor_id", "event_date", "platform"]
    both = rollups.upsert(*halves, keys, METRICS).select(*keys, *METRICS)
    assert sorted(both.collect()) == sorted(b.vds.select(*keys, *METRICS).collect())
    first = rollups.first_visits(b.vds).agg(F.sum("first_time_visitors")).first()[0]
    assert first == b.vds.select("project_id", "visitor_id", "platform").distinct().count()


def test_dates_are_replaced_not_added(spark, tmp_path):
    path = str(tmp_path / "vds")
    rows = [(1, 1, "2026-03-01", "ios", {"views": 1}, None), (1, 1, "2026-03-02", "ios", {"views": 2}, None)]
    rollups.write_days(daily(spark, rows), path)
    rollups.write_days(daily(spark, [(1, 1, "2026-03-02", "ios", {"views": 9}, None)]), path)
    assert {(str(r.event_date), r.views) for r in spark.read.parquet(path).collect()} == {("2026-03-01", 1), ("2026-03-02", 9)}


def test_totals_reject_unknown_sorts(spark):
    with pytest.raises(ValueError):
        rollups.totals(daily(spark, []), "visitor_id", "2026-01-01", "2026-01-02", "name")


def raw(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_parse(spark):
    lines = ['{"type":"view","project_id":1,"device_id":2,"created_at":"2024-01-01T00:00:01.500Z"}', "{bad", '{"type":"other","project_id":1,"device_id":2}', '{"type":"open","device_id":2}', '{"type":"open","project_id":1,"device_id":2,"created_at":"no time"}', "", '{"type":"install","project_id":1,"device_id":3,"link_id":4}']
    got = ingest.parse(raw(spark, lines), F.lit("2024-02-01").cast("timestamp")).collect()
    assert [(r.event, r.device_id, r.created_at) for r in got] == [("view", 2, at("2024-01-01T00:00:01.500")), ("open", 2, at("2024-02-01")), ("install", 3, at("2024-02-01"))]


def views(spark, rows):
    return spark.createDataFrame([(k, d, e, at(f"2024-01-01T00:00:{s:02d}")) for k, (d, e, s) in enumerate(rows)], "event_id long, device_id long, event string, created_at timestamp_ntz")


def test_view_dedup_by_gap_and_fixed(spark):
    rows = views(spark, [(1, "view", 0), (1, "view", 4), (1, "view", 8), (1, "view", 20), (2, "view", 4), (1, "open", 1), (1, "view", 25)])
    assert sorted(r.event_id for r in ingest.dedup_views_by_gap(rows).collect()) == [0, 3, 4, 5]
    assert sorted(r.event_id for r in ingest.dedup_views_fixed(rows).collect()) == [0, 2, 3, 4, 5]
    runs = sorted((r.device_id, r.views, r.created_at.second) for r in ingest.view_sessions(rows).collect())
    assert runs == [(1, 2, 25), (1, 3, 8), (2, 1, 4)]


def test_merge_visitors(spark):
    rows = daily(spark, [(1, 1, "2026-03-01", "ios", {"views": 1}, None), (1, 2, "2026-03-01", "ios", {"views": 2}, None), (1, 2, "2026-03-01", "web", {"views": 4}, None), (1, 2, "2026-03-02", "ios", {"views": 8}, None), (1, 3, "2026-03-01", "ios", {"views": 16}, None)]).drop("invited_by_id")
    pairs = spark.createDataFrame([(2, 1)], "from_id long, to_id long")
    got = sorted((r.visitor_id, str(r.event_date), r.platform, r.views) for r in ingest.merge_visitors(rows, pairs, METRICS).collect())
    assert got == [(1, "2026-03-01", "ios", 3), (1, "2026-03-01", "web", 4), (1, "2026-03-02", "ios", 8), (3, "2026-03-01", "ios", 16)]
    strict = sorted((r.visitor_id, str(r.event_date), r.platform, r.views) for r in ingest.merge_visitors(rows, pairs, METRICS, strict=True).collect())
    assert strict == [(1, "2026-03-01", "ios", 7), (1, "2026-03-02", "web", 8), (3, "2026-03-01", "ios", 16)]


def test_device_update_keeps_what_blank_values_would_replace(spark):
    devices = spark.createDataFrame([(1, "1.0", None), (2, "1.0", "de")], "device_id long, app_version string, language string")
    updates = spark.createDataFrame([(1, at("2024-01-01"), 1, "2.0", " "), (1, at("2024-01-02"), 2, "", "en")], "device_id long, created_at timestamp_ntz, event_id long, app_version string, language string")
    got = {r.device_id: (r.app_version, r.language) for r in ingest.update_devices(devices, updates, ["app_version", "language"]).collect()}
    assert got == {1: ("2.0", "en"), 2: ("1.0", "de")}
    ua = spark.createDataFrame([(None, " ", "Mozilla (iPhone)"), ("web", None, None), (None, "android", "x"), (None, None, "X11"), (None, None, None)], "g string, s string, u string")
    assert [r[0] for r in ua.select(ingest.device_platform(F.col("g"), F.col("s"), F.col("u"))).collect()] == ["ios", "web", "android", "web", None]


def test_late_events(spark):
    rows = spark.createDataFrame([(1, at("2024-01-01T00:00:00")), (2, at("2024-01-01T00:06:00")), (3, None)], "event_id long, created_at timestamp_ntz")
    got = ingest.drop_late(rows, F.lit("2024-01-01 00:10:00").cast("timestamp_ntz")).collect()
    assert sorted(r.event_id for r in got) == [2, 3]


def test_gap_filled_series_and_previous_range(spark):
    dpm = spark.createDataFrame([(1, day("2026-03-01"), "ios", 5)], "project_id long, event_date date, platform string, link_views long")
    got = [(str(r.event_date), r.link_views) for r in analytics.link_views(dpm, 1, "2026-03-01", "2026-03-03").orderBy("event_date").collect()]
    assert got == [("2026-03-01", 5), ("2026-03-02", 0), ("2026-03-03", 0)]
    assert analytics.previous("2026-03-03", "2026-03-04") == ("2026-03-01", "2026-03-02")


def test_monthly_visitors_are_distinct(spark):
    vds = daily(spark, [(1, 1, "2026-02-27", "ios", {}, None), (1, 1, "2026-03-01", "ios", {}, None), (1, 1, "2026-03-05", "ios", {}, None), (1, 2, "2026-03-05", "web", {}, None)])
    months = {str(r.month): r.active_users for r in analytics.active_users_monthly(vds, [1], "2026-02-01", "2026-03-31").collect()}
    assert months == {"2026-02-01": 1, "2026-03-01": 2}
    assert value(analytics.active_users_total(vds, [1], "2026-02-01", "2026-03-31")) == 3
    with pytest.raises(ValueError):
        analytics.active_users_monthly(vds, [1], "2026-03-02", "2026-03-01")


def test_quota(spark):
    usage = spark.createDataFrame([(1, 10_000, False), (2, 10_001, False), (3, 8_500, False), (4, 8_400, False), (5, 20_000, True)], "instance_id long, mau long, enterprise boolean")
    got = {r.instance_id: (r.exceeded, r.warn, r.paid_maus) for r in analytics.quota_status(usage).collect()}
    assert got == {1: (False, True, 0), 2: (True, False, 1), 3: (False, True, 0), 4: (False, False, 0), 5: (False, False, 10_000)}


def test_folds(spark):
    one = spark.createDataFrame([([4000.0], [5.0, 7.0, 8.0], [])], "a array<double>, b array<double>, c array<double>")
    got = one.select(expr.halving_fold(F.col("a")), expr.running_mean_fold(F.col("b")), expr.running_mean_fold(F.col("c")), expr.halving_fold(F.array(F.lit(0.01)))).first()
    assert tuple(got) == (2000.0, 7.0, 0.0, 0.01)


def test_like_terms(spark):
    names = spark.createDataFrame([("a_b",), ("axb",), ("A_B%",), (None,), ("\\x",)], "name string")
    assert [r.name for r in names.filter(expr.ilike_any(["name"], "a_b")).collect()] == ["a_b", "A_B%"]
    assert names.filter(expr.ilike_any(["name"], "a_b", escape=False)).count() == 3
    assert names.filter(expr.ilike_any(["name"], "\\")).count() == 1


def purchases(spark, rows):
    return spark.createDataFrame(rows, "event_id long, date timestamp_ntz, project_id long, device_id long, link_id long, event_type string, product_id string, usd_price_cents long, quantity int, store boolean, webhook_validated boolean, store_source string, purchase_type string, original_transaction_id string")


def purchase(k, kind="buy", device=1, product="premium", cents=999, quantity=1, type_=None, hour=0):
    return (k, at(f"2026-03-01T{hour:02d}:00:00"), 1, device, None, kind, product, cents, quantity, False, None, "apple", type_, f"o{k}")


def test_revenue_by_product(spark):
    devices = spark.createDataFrame([(1, "ios")], "device_id long, platform string")
    given = purchases(spark, [purchase(1), purchase(2, hour=1), purchase(3, "cancel", type_="subscription", hour=2)])
    priced = revenue.deltas(revenue.countable(given), devices)
    days, owned = revenue.product_days(priced), revenue.products(priced)
    row = revenue.revenue_metrics(days, owned, given, 1, "2026-03-01", "2026-03-01").first()
    assert (row.units_sold, row.first_time_purchases, row.repeat_purchases, row.cancellations, row.revenue, row.ltv, row.platforms, row.unique_purchasers) == (2, 1, 1, 1, 1998, 1998.0, "ios", 1)


@pytest.mark.parametrize(
    "kind,type_,cents,want",
    [("buy", None, 5, 10), ("refund_reversed", None, 5, 10), ("refund", "subscription", 5, -10), ("cancel", None, 5, -10), ("cancel", "subscription", 5, None), ("buy", None, 0, None), ("other", None, 5, None)],
)
def test_revenue_delta(spark, kind, type_, cents, want):
    one = purchases(spark, [purchase(1, kind, cents=cents, quantity=2, type_=type_)])
    assert one.select(expr.revenue_delta(F.col("event_type"), F.col("purchase_type"), F.col("usd_price_cents"), F.col("quantity"))).first()[0] == want


def test_validation_is_three_valued(spark):
    flags = spark.createDataFrame(list(itertools.product([True, False, None], repeat=2)), "store boolean, hook boolean")
    got = {(r.store, r.hook) for r in flags.filter(expr.validated(F.col("store"), F.col("hook"))).collect()}
    assert got == {(True, True), (False, True), (None, True), (False, False), (False, None)}


def test_subscription_states_and_attribution(spark):
    rows = [(1, at("2026-03-01"), 1, 7, None, "buy", "a", 1, 1, False, None, None, "subscription", "t"), (2, at("2026-03-02"), 1, None, 9, "buy", "b", 1, 1, False, None, None, None, "t")]
    state = revenue.subscription_states(purchases(spark, rows)).first()
    assert (state.device_id, state.link_id, state.product_id, state.purchase_type, state.latest_event_id) == (7, 9, "b", "subscription", 2)
    found = revenue.attribution(purchases(spark, rows), revenue.subscription_states(purchases(spark, rows[:1]))).first()
    assert (found.device_id, found.link_id) == (7, None)


def test_webhooks(spark):
    """By transaction, else, for a first purchase, by stored original transaction; a null flag is neither validated nor not."""
    stored = spark.createDataFrame(
        [(1, 1, "buy", "t1", "t1", False), (2, 1, "buy", "t2", "t2", True), (5, 1, "buy", "T9", "O1", False), (6, 1, "buy", "t6", "t6", None), (7, 1, "buy", "t7", "O7", True), (8, 2, "buy", "t1", "t1", True)],
        "event_id long, project_id long, event_type string, transaction_id string, original_transaction_id string, webhook_validated boolean",
    )
    incoming = spark.createDataFrame(
        [(1, 1, "buy", "t1", "o"), (2, 1, "buy", "t2", "t2"), (3, 1, "buy", "t3", "t1"), (4, 1, "cancel", "t1", "t1"), (5, 1, "buy", "O1", "O1"), (6, 1, "buy", "t6", "t6"), (7, 1, "buy", "O7", None), (8, 1, "buy", None, None)],
        "notice_id long, project_id long, event_type string, transaction_id string, original_transaction_id string",
    )
    got = {r.notice_id: (r.action, r.event_id) for r in revenue.match_webhooks(incoming, stored).collect()}
    assert got == {1: ("validate", 1), 2: ("none", 2), 3: ("create", None), 4: ("create", None), 5: ("validate", 5), 6: ("create", None), 7: ("none", 7), 8: ("create", None)}
    strict = {r.notice_id: r.action for r in revenue.match_webhooks(incoming, stored, validated_by_original=False).collect()}
    assert strict[7] == "create" and strict[5] == "validate" and strict[2] == "none"


def test_product_changes(spark):
    """The last buy of another product is cancelled only if that product is still bought; older products are not looked at."""
    rows = [(1, "c", "buy"), (2, "b", "buy"), (3, "b", "cancel"), (4, "a", "buy")]
    stored = spark.createDataFrame([(i, f"2024-01-0{i}", 1, "s", p, e, f"t{i}") for i, p, e in rows], "event_id long, date string, project_id long, original_transaction_id string, product_id string, event_type string, transaction_id string")
    to = lambda p: spark.createDataFrame([(9, 1, "s", p)], "change_id long, project_id long, original_transaction_id string, product_id string")
    assert revenue.product_change_cancels(stored, to("a")).collect() == []
    assert [(r.canceled_product, r.canceled_event, r.transaction_id) for r in revenue.product_change_cancels(stored, to("d")).collect()] == [("a", 4, "t4_product_change_cancel")]
    again = stored.union(spark.createDataFrame([(7, "2024-01-07", 1, None, "a", "cancel", "t4_product_change_cancel")], stored.schema))
    assert revenue.product_change_cancels(again, to("d")).collect() == []


def test_actions_count_from_the_last_one_made(spark):
    at = spark.createDataFrame([(k, 1, 1, f"2024-01-01 00:{m:02d}:00") for k, m in enumerate((0, 4, 8, 9, 13, 14, 40))], "action_id long, device_id long, link_id long, at string").withColumn("at", F.to_timestamp("at"))
    assert sorted(r.action_id for r in attribution.new_actions(at).collect()) == [0, 2, 5, 6]


def test_scalar_units(spark):
    one = spark.range(1)
    got = one.select(expr.milliunits_to_cents(F.lit(-15)), expr.micros_to_cents(F.lit(19_999)), expr.original_transaction(F.lit("GPA.1-2..3")), expr.to_usd_cents(F.lit(100), F.lit("usd"), F.lit(None)), expr.to_usd_cents(F.lit(100), F.lit("xx"), F.lit(None).cast("double")), expr.to_usd_cents(F.lit(5), F.lit("eur"), F.lit(2.0)))
    assert tuple(got.first()) == (-2, 1, "GPA.1-2.", 100, None, 3)
    prices = spark.createDataFrame([([("DE", "EUR", 1), ("US", "USD", 2)],), ([("FR", "EUR", 3), ("X", "X", 4)],), ([("X", "X", 4)],), ([],)], "p array<struct<region:string,currency:string,micros:long>>")
    assert [r[0] and r[0].micros for r in prices.select(revenue.pick_price(F.col("p"))).collect()] == [2, 3, 4, None]


def test_urls(spark):
    urls = ["https://u:p@A.b.example.com:8/x/y?q#f", "myapp://open/now?x", "not a url", None, "http://example.com", "https://é.com/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "url_id long, url string")
    got = {r.url_id: (r.domain, r.subdomain, r.path) for r in attribution.parse_links(df).collect()}
    assert got[0] == ("example.com", "a.b", "x/y") and got[1] == ("myapp", None, "open") and got[4] == ("example.com", "", "")
    assert got[2] == got[3] == (None, None, None)
    assert df.select(expr.strip_query(F.col("url"))).first()[0] == "https://u:p@A.b.example.com:8/x/y"
    links = spark.createDataFrame([(1, "example.com", "a.b", None, False, "x/y"), (2, None, None, "myapp", True, "open"), (3, None, None, "myapp", False, "open")], "link_id long, domain string, subdomain string, uri_scheme string, test boolean, path string")
    assert {r.url_id: r.link_id for r in attribution.links_for_urls(df, links).collect()} == {0: 1, 1: 3, 2: None, 3: None, 4: None, 5: None}


def test_actions(spark):
    actions = spark.createDataFrame([(1, 1, 5, at("2024-01-01T00:00:00")), (2, 1, 6, at("2024-01-01T00:04:00")), (3, 1, 5, at("2024-01-01T00:04:30")), (4, 2, 5, at("2024-01-01T00:00:00"))], "action_id long, device_id long, link_id long, at timestamp_ntz")
    opens = spark.createDataFrame([(10, 1, at("2024-01-01T00:04:10")), (11, 1, at("2024-01-01T00:10:00")), (12, 2, at("2024-01-01T00:05:00")), (13, 2, at("2024-01-01T00:05:01"))], "open_id long, device_id long, at timestamp_ntz")
    got = {r.open_id: (r.action_id, r.action_link_id) for r in attribution.actions_in_window(opens, actions).collect()}
    assert got == {10: (2, 6), 11: (None, None), 12: (4, 5), 13: (None, None)}
    assert sorted(r.action_id for r in attribution.new_actions(actions).collect()) == [1, 2, 4]
    assert {r.action_id: r.handled for r in attribution.handled(actions, opens.filter("open_id = 10")).collect()} == {1: True, 2: True, 3: False, 4: False}
    assert sorted(r.open_id for r in attribution.deferred_opens(opens, actions).collect()) == [10, 12]


def test_fingerprints(spark):
    base = "project_id long, remote_ip string, ua_platform string, ua_version string, at timestamp_ntz, " + ", ".join(f"{c} string" for c in attribution.TIE_BREAK)
    same, other, part = ["a"] * 6, ["b"] * 6, [*["a"] * 5, None]
    seen = spark.createDataFrame([(1, 1, "ip", "ios", "17", at("2024-01-01T00:00:00"), *same), (2, 1, "ip", "ios", "17", at("2024-01-01T00:01:00"), *other), (3, 1, "ip2", "ios", "17", at("2024-01-01T00:00:00"), *part)], f"device_id long, {base}")
    requests = spark.createDataFrame([(1, 1, "ip", "ios", "17", at("2024-01-01T00:02:00"), *same), (2, 1, "ip", "ios", "17", at("2024-01-01T00:02:00"), *part), (3, 1, "ip2", "ios", "17", at("2024-01-01T00:02:00"), *other), (4, 1, "ip2", "ios", "17", at("2024-01-01T00:06:00"), *same)], f"request_id long, {base}")
    assert {r.request_id: r.device_id for r in attribution.fingerprint_matches(requests, seen).collect()} == {1: 1, 2: None, 3: 3, 4: None}


def _shuffled(spark):
    """Records that all stages so far wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_fingerprints_of_a_busy_address(spark):
    """Requests and views behind one address are not paired: 1,500 of each shuffled over a million records."""
    base = "project_id long, remote_ip string, ua_platform string, ua_version string, at timestamp_ntz, " + ", ".join(f"{c} string" for c in attribution.TIE_BREAK)
    rows = [(k, 1, "ip", "ios", "17", at("2024-01-01T00:00:00") + dt.timedelta(milliseconds=20 * k), *["a"] * 6) for k in range(1500)]
    requests, seen = (spark.createDataFrame(rows, f"{name} long, {base}") for name in ("request_id", "device_id"))
    before = _shuffled(spark)
    got = {r.request_id: r.device_id for r in attribution.fingerprint_matches(requests, seen).collect()}
    assert got == {k: 0 if k == 0 else None for k in range(1500)}
    assert 0 < _shuffled(spark) - before < 50_000


def test_fingerprints_against_all_pairs(spark):
    rng = random.Random(8)
    start, marks = at("2024-01-01T00:00:00"), len(attribution.TIE_BREAK)

    def row(k):
        # Moments on a coarse grid meet both ends of the window and both sides of a slot.
        own = [rng.choice("ab")] * marks
        if rng.random() < 0.1:
            own[rng.randrange(marks)] = None
        return (k, rng.choice([1, 1, 2, None]), rng.choice(["x", "x", "y", None]), "ios", rng.choice(["17", "18"]), None if rng.random() < 0.03 else start + dt.timedelta(seconds=30 * rng.randrange(120)), *own)

    base = "project_id long, remote_ip string, ua_platform string, ua_version string, at timestamp_ntz, " + ", ".join(f"{c} string" for c in attribution.TIE_BREAK)
    seen = [row(rng.choice([*range(12), None])) for _ in range(300)]
    requests = [row(k) for k in range(400)]
    window = dt.timedelta(minutes=5)
    want = {}
    for k, *r in requests:
        near = [s for s in seen if None not in (*r[:5], *s[1:6]) and list(s[1:5]) == r[:4] and r[4] - window <= s[5] <= r[4] and s[0] is not None]
        every, same = {s[0] for s in near}, {s[0] for s in near if None not in s[6:] and list(s[6:]) == r[5:]}
        want[k] = min(every) if len(every) == 1 else min(same) if len(same) == 1 else None
    got = attribution.fingerprint_matches(spark.createDataFrame(requests, f"request_id long, {base}"), spark.createDataFrame(seen, f"device_id long, {base}")).collect()
    assert {r.request_id: r.device_id for r in got} == want and len(got) == 400
    assert len({k for k, v in want.items() if v is not None}) > 50


def test_notifications(spark):
    notes = spark.createDataFrame([(1, 1, "Hi", None, False, True, True, None), (2, 1, "Ho", "x", False, False, False, ["desktop"]), (3, 1, "Old", None, True, False, False, [])], "notification_id long, project_id long, title string, subtitle string, archived boolean, new_users boolean, auto_display boolean, platforms array<string>")
    messages = spark.createDataFrame([(1, 5, True), (1, 6, False), (2, 5, False)], "notification_id long, visitor_id long, read boolean")
    assert [(r.notification_id, r.read_count) for r in notifications.listed(notes, messages).collect()] == [(2, 0), (1, 1)]
    assert [r.notification_id for r in notifications.for_device(notes, messages, 5, "ios").collect()] == [1]
    assert [r.notification_id for r in notifications.auto_display(notes, messages, 6).collect()] == [1]
    visitors = spark.createDataFrame([(5, 1, 50), (6, 1, 60)], "visitor_id long, project_id long, device_id long")
    devices = spark.createDataFrame([(50, "web"), (60, "ios")], "device_id long, platform string")
    got = notifications.audience(notes, visitors, devices, spark.createDataFrame([(1,)], "notification_id long")).collect()
    assert sorted((r.notification_id, r.visitor_id) for r in got) == [(2, 5), (3, 5), (3, 6)]


def test_logs(spark):
    want = {
        '{"level":"warning"}': ("WARN", 13, None),
        '{"level":"ERR"}': ("ERROR", 17, None),
        '{"level":"critical"}': ("FATAL", 21, None),
        '{"level":"trace"}': ("TRACE", 1, None),
        '{"level":"notice"}': ("INFO", 9, None),
        "GET /x status=503": ("INFO", 9, None),
        "E, [2024-01-01T00:00:00 #1] ERROR -- : Foo::BarError: boom": ("ERROR", 17, "BarError"),
        'I, [2024-01-01T00:00:00 #1]  INFO -- : {"status":503}': ("ERROR", 17, None),
        "fatal: x": ("INFO", 9, None),
        None: ("INFO", 9, None),
    }
    rows = attribution.classify_logs(spark.createDataFrame([(x,) for x in want], "line string")).collect()
    assert {r.line: (r.severity, r.severity_number, r.error_class) for r in rows} == want


def test_pages(spark):
    page = analytics.paginate(spark.range(45).orderBy("id"), 3, 20)
    assert (page.total, page.pages, [r.id for r in page.rows.collect()]) == (45, 3, [40, 41, 42, 43, 44])
    assert analytics.page_of(spark.range(5).orderBy("id"), -1, 2).count() == 2


def test_paths(spark):
    names = spark.range(200).select(F.lit("d").alias("domain"), F.col("id").alias("seed"))
    made = attribution.new_paths(names, spark.createDataFrame([], "domain string, path string"), test=True).collect()
    assert len({r.path for r in made}) == len(made) and all(r.path.endswith("-test") and len(r.path) == 11 for r in made)


def test_apple_events_by_type_and_subtype(spark):
    rows = [("SUBSCRIBED", "UPGRADE", "buy"), ("DID_FAIL_TO_RENEW", None, "cancel"), ("DID_FAIL_TO_RENEW", "BILLING_RETRY", None), ("OFFER_REDEEMED", "UPGRADE", "change"), ("OFFER_REDEEMED", "DOWNGRADE", None), ("OFFER_REDEEMED", None, "buy"), ("DID_CHANGE_RENEWAL_PREF", "DOWNGRADE", None), ("TEST", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "kind string, subtype string, expected string")
    assert all(r.got == r.expected for r in df.withColumn("got", revenue.apple_event(F.col("kind"), F.col("subtype"))).collect())


def test_import_takes_prefixes_and_columns(spark):
    rows = spark.createDataFrame([(1, "https://s.example/a ", " n ", "c", None, "web", "https://app.example/x"), (2, "https://s.example/", "m", None, None, None, None), (3, "b", None, None, None, None, "other")], "line int, path string, name string, utm_campaign string, utm_medium string, utm_source string, link string")
    good, skipped = attribution.import_links(rows, spark.createDataFrame([("b",)], "path string"), ["https://s.example/"], "https://app.example/")
    assert [tuple(r) for r in good.select("line", "path", "name", "utm_campaign", "utm_medium", "utm_source", "link").collect()] == [(1, "a", "n", "c", "", "web", "app.example://x")]
    assert sorted(map(tuple, skipped.collect())) == [(2, "blank path"), (3, "duplicate")]


def test_open_without_an_action_and_handled_ones(spark):
    moment = lambda m: dt.datetime(2024, 1, 1, 0, m)
    requests = spark.createDataFrame([(1, 1, 5, 7, moment(10)), (2, 1, 5, None, moment(11)), (3, 1, 5, 7, moment(12)), (4, 2, 5, 7, moment(13)), (5, 1, 6, None, moment(14)), (6, 1, 6, 8, moment(15))], "open_id long, project_id long, device_id long, link_id long, at timestamp_ntz")
    matches = spark.createDataFrame([(k, 9) for k in (2, 3, 4, 5)], "open_id long, device_id long")
    actions = spark.createDataFrame([(100, 9, 7, moment(9), False)], "action_id long, device_id long, link_id long, at timestamp_ntz, handled boolean")
    links = spark.createDataFrame([(7, 1, True), (8, 1, False)], "link_id long, project_id long, opens_app boolean")
    got = attribution.resolved_opens(requests, matches, actions, links).collect()
    # 1 and 6 without an action, 2 by the action, which is handled for 3 and 5; 4 is another project's.
    assert sorted((r.open_id, r.device_id, r.link_id) for r in got) == [(1, 5, 7), (2, 5, 7), (6, 6, 8)]

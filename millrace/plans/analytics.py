"""Queries of dashboards, links, campaigns, visitors and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import analytics as a
from millrace.operators import notifications as n
from millrace.plans.base import END, PROJECT, RANGE, START, Base, query, sums
from millrace.schemas import EVENTS

P = PROJECT
INST = f"event_date BETWEEN DATE '{START}' AND DATE '{END}' AND project_id = {P}"
BETWEEN = f"created_at >= TIMESTAMP '{START} 00:00:00' AND created_at < TIMESTAMP '{END} 00:00:00' + INTERVAL 1 DAY"


def _dash(period: str, start: str, end: str) -> str:
    own = f"project_id = {P} AND event_date BETWEEN DATE '{start}' AND DATE '{end}'"
    return f"""SELECT '{period}' AS period, d.*, v.visitors, u.paying_users FROM (SELECT {sums(names=a.SUMMED)} FROM dpm WHERE {own}) d,
      (SELECT count(DISTINCT visitor_id) AS visitors FROM vds WHERE {own}) v, (SELECT count(DISTINCT device_id) AS paying_users FROM a_purchase_events WHERE project_id = {P}
       AND event_type IN ('buy', 'refund_reversed') AND (webhook_validated = true OR store = false) AND device_id IS NOT NULL
       AND date >= TIMESTAMP '{start} 00:00:00' AND date < TIMESTAMP '{end} 00:00:00' + INTERVAL 1 DAY) u"""


BOTH = f"both_periods AS ({_dash('current', START, END)} UNION ALL {_dash('previous', '2023-12-25', '2024-01-07')})"


@query(
    "Q1_dashboard_metrics",
    f"""SELECT period, visitors, paying_users, {', '.join(a.SUMMED)}, greatest(visitors - first_time_visitors, 0) AS returning_users, installs - organic_users AS link_driven_installs,
       CASE WHEN visitors > 0 THEN CAST(greatest(visitors - first_time_visitors, 0) AS DOUBLE) / visitors ELSE 0.0 END AS returning_rate,
       CASE WHEN visitors > 0 THEN round(CAST(revenue AS DOUBLE) / visitors, 2) ELSE 0.0 END AS arpu,
       CASE WHEN paying_users > 0 THEN round(CAST(revenue AS DOUBLE) / paying_users, 2) ELSE 0.0 END AS arppu FROM both_periods""",
    BOTH,
)
def q1(b: Base):
    return a.dashboard(b.dpm, b.vds, b.t.purchases, b.t.devices, P, START, END)


@query(
    "Q1a_paying_users",
    f"""SELECT count(DISTINCT p.device_id) AS paying_users FROM a_purchase_events p JOIN a_devices d ON d.device_id = p.device_id WHERE project_id = {P} AND d.platform = 'ios'
       AND event_type IN ('buy', 'refund_reversed') AND (webhook_validated = true OR store = false) AND date >= TIMESTAMP '{START} 00:00:00' AND date < TIMESTAMP '{END} 00:00:00' + INTERVAL 1 DAY""",
)
def q1a(b: Base):
    return a.paying_users(b.t.purchases, b.t.devices, P, START, END, "ios")


@query("Q1b_first_time_for_range", f"SELECT count(DISTINCT visitor_id) AS first_time FROM vds v WHERE project_id = {P} AND event_date BETWEEN DATE '2024-01-02' AND DATE '{END}' AND NOT EXISTS (SELECT 1 FROM vds w WHERE w.project_id = {P} AND w.visitor_id = v.visitor_id AND w.event_date < DATE '2024-01-02')")
def q1b(b: Base):
    return a.first_time_in_range(b.vds, P, "2024-01-02", END)


@query("Q1c_dau_for_range", f"SELECT CAST(coalesce(sum(active_users), 0) AS BIGINT) AS active_users FROM dau WHERE {INST} AND platform IN ('ios', 'web')")
def q1c(b: Base):
    return a.dau_in_range(b.dau, P, START, END, ["ios", "web"])


@query("Q2_links_views", f"SELECT c.event_date, CAST(coalesce(sum(d.link_views), 0) AS BIGINT) AS link_views FROM cal c LEFT JOIN dpm d ON d.event_date = c.event_date AND d.project_id = {P} AND d.platform = 'web' GROUP BY c.event_date")
def q2(b: Base):
    return a.link_views(b.dpm, P, START, END, "web")


@query(
    "Q3_top_links",
    f"""SELECT s.*, k.name, k.path FROM (SELECT link_id, {sums(names=['views', 'opens', 'installs', 'reinstalls', 'reactivations', 'time_spent'])} FROM lds
       WHERE {INST} AND link_id IN (SELECT link_id FROM a_links WHERE project_id = {P} AND NOT sdk_generated) GROUP BY link_id ORDER BY installs DESC, link_id LIMIT 10) s JOIN a_links k ON k.link_id = s.link_id""",
)
def q3(b: Base):
    return a.top_links(b.lds, b.t.links, P, START, END)


@query(
    "Q4_link_statistics",
    f"""SELECT k.link_id, k.name, k.campaign_id, {sums(table='s.')} FROM a_links k LEFT JOIN lds s ON s.link_id = k.link_id AND s.platform IN ('ios', 'android') AND s.{RANGE}
       WHERE k.project_id = {P} AND k.active AND (k.name ILIKE '%ar%' OR k.title ILIKE '%ar%' OR k.path ILIKE '%ar%') GROUP BY k.link_id, k.name, k.campaign_id""",
)
def q4(b: Base):
    return a.link_statistics(b.t.links, b.lds, P, START, END, ["ios", "android"], term="AR", sort_by="views")


@query(
    "Q4_link_statistics_page",
    f"""SELECT k.link_id, k.name, k.campaign_id, {sums(table='s.')} FROM a_links k LEFT JOIN lds s ON s.link_id = k.link_id AND s.{RANGE}
       WHERE k.project_id = {P} AND k.active GROUP BY k.link_id, k.name, k.campaign_id ORDER BY views DESC, k.link_id LIMIT 5 OFFSET 5""",
)
def q4_page(b: Base):
    return a.page_of(a.link_statistics(b.t.links, b.lds, P, START, END, sort_by="views"), 2, 5)


@query(
    "Q5_campaign_statistics",
    f"""SELECT c.campaign_id, c.name, c.archived, {sums(table='s.')} FROM a_campaigns c LEFT JOIN a_links k ON k.campaign_id = c.campaign_id
       LEFT JOIN lds s ON s.link_id = k.link_id AND s.{RANGE} WHERE c.project_id = {P} AND c.name ILIKE '%a%' GROUP BY c.campaign_id, c.name, c.archived""",
)
def q5(b: Base):
    return a.campaign_statistics(b.t.campaigns, b.t.links, b.lds, P, START, END, term="A", sort_by="installs")


@query(
    "Q6_visitor_statistics",
    f"""SELECT v.visitor_id, v.sdk_identifier, d.platform AS device_platform, {sums('total_', 's.')} FROM a_visitors v JOIN vds s ON s.visitor_id = v.visitor_id JOIN a_devices d ON d.device_id = v.device_id
       WHERE v.project_id = {P} AND s.{RANGE} AND v.sdk_identifier ILIKE '%user_1%' GROUP BY v.visitor_id, v.sdk_identifier, d.platform""",
)
def q6(b: Base):
    return a.visitor_statistics(b.t.visitors, b.vds, b.t.devices, P, START, END, term="user_1", sort_by="total_views")


@query(
    "Q7_visitor_referral_statistics",
    f"""SELECT v.visitor_id, d.platform AS device_platform, {sums('invited_', 's.')} FROM a_visitors v JOIN vds s ON s.invited_by_id = v.visitor_id LEFT JOIN a_devices d ON d.device_id = v.device_id
       WHERE v.project_id = {P} AND s.{RANGE} GROUP BY v.visitor_id, d.platform""",
)
def q7(b: Base):
    return a.referral_statistics(b.t.visitors, b.vds, b.t.devices, P, START, END)


def _types(table: str) -> str:
    return ", ".join(f"count(CASE WHEN {table}.event = '{e}' THEN 1 END) AS {e}_count, CAST(coalesce(sum(CASE WHEN {table}.event = '{e}' THEN {table}.engagement_time END), 0) AS BIGINT) AS {e}_engagement_time" for e in EVENTS)


@query("Q8_own_event_counts", f"SELECT v.visitor_id, d.platform, {_types('e')} FROM a_visitors v LEFT JOIN a_devices d ON d.device_id = v.device_id LEFT JOIN all_events e ON e.device_id = v.device_id AND e.project_id = v.project_id WHERE v.project_id = {P} GROUP BY v.visitor_id, d.platform")
def q8(b: Base):
    return a.own_event_counts(b.t.visitors, b.t.devices, b.events, P)


@query("Q9_referral_event_counts", f"SELECT v.visitor_id, {_types('e')} FROM a_visitors v LEFT JOIN a_links k ON k.visitor_id = v.visitor_id LEFT JOIN all_events e ON e.link_id = k.link_id AND e.project_id = v.project_id WHERE v.project_id = {P} GROUP BY v.visitor_id")
def q9(b: Base):
    return a.referral_event_counts(b.t.visitors, b.t.links, b.events, P)


COUNTS = ", ".join(f"CAST(coalesce(sum(CASE WHEN event = '{e}' THEN n END), 0) AS BIGINT) AS {e}" for e in EVENTS[:7])
PER_LINK = f"""by_type AS (
  SELECT link_id, event, count(*) AS n, round(CAST(coalesce(sum(engagement_time), 0) AS DOUBLE) / count(DISTINCT device_id), 2) AS mean FROM a_events WHERE link_id IS NOT NULL AND {BETWEEN} GROUP BY link_id, event
), per_link AS (
  SELECT link_id, {COUNTS}, list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(round(mean * 100) AS BIGINT) ORDER BY event)), lambda x, y: CASE WHEN x = 0 THEN y WHEN x + y >= 0 THEN (x + y + 1) // 2 ELSE -((1 - x - y) // 2) END) / 100.0 AS avg_engagement_time FROM by_type GROUP BY link_id
)"""


@query("Q10_metrics_for_link_ids", "SELECT * FROM per_link", PER_LINK)
def q10(b: Base):
    return a.event_metrics_by_link(b.t.events, START, END)


TYPES = ", ".join(f"m.{e}" for e in EVENTS[:7])


@query("Q11_sorted_by_links", f"SELECT k.link_id, k.name, coalesce(c.n, 0) AS sort_count, {TYPES}, m.avg_engagement_time FROM a_links k LEFT JOIN by_type c ON c.link_id = k.link_id AND c.event = 'install' LEFT JOIN per_link m ON m.link_id = k.link_id WHERE k.project_id = {P}", PER_LINK)
def q11(b: Base):
    return a.links_by_event(b.t.links, b.t.events, P, "install", START, END)


@query(
    "Q12_sorted_by_campaigns",
    f"""SELECT c.campaign_id, c.name, {', '.join(f'CAST(sum(m.{e}) AS BIGINT) AS {e}' for e in EVENTS[:7])}, round(sum(m.avg_engagement_time ORDER BY m.link_id), 2) AS avg_engagement_time FROM a_campaigns c
       LEFT JOIN (SELECT k.campaign_id, p.* FROM a_links k JOIN per_link p ON p.link_id = k.link_id WHERE NOT k.sdk_generated) m ON m.campaign_id = c.campaign_id WHERE c.project_id = {P} GROUP BY c.campaign_id, c.name""",
    PER_LINK,
)
def q12(b: Base):
    return a.campaigns_by_event(b.t.campaigns, b.t.links, b.t.events, P, "view", START, END)


OVERVIEW = f"""day_type AS (
  SELECT CAST(created_at AS DATE) AS event_date, event, count(*) AS n, coalesce(avg(engagement_time), 0) AS mean FROM a_events WHERE project_id = {P} AND {BETWEEN} GROUP BY ALL
), overview AS (
  SELECT event_date, {COUNTS}, list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(round(mean * 100) AS BIGINT) ORDER BY event)), lambda x, y: CASE WHEN x + y >= 0 THEN (x + y + 1) // 2 ELSE -((1 - x - y) // 2) END) / 100.0 AS avg_engagement_time FROM day_type GROUP BY event_date
)"""


@query("Q13_events_overview", "SELECT * FROM overview", OVERVIEW)
def q13(b: Base):
    return a.events_overview(b.t.events, b.t.links, P, START, END)


@query("Q13_events_overview_of_campaigns", f"SELECT event_date, {COUNTS} FROM (SELECT CAST(date_trunc('month', created_at) AS DATE) AS event_date, event, count(*) AS n FROM a_events WHERE project_id = {P} AND {BETWEEN} AND link_id IN (SELECT link_id FROM a_links WHERE active AND campaign_id IN (1, 2, 3, 4, 5, 6)) GROUP BY ALL) x GROUP BY event_date")
def q13_campaigns(b: Base):
    return a.events_overview(b.t.events, b.t.links, P, START, END, "month", active=True, campaigns=[1, 2, 3, 4, 5, 6]).drop("avg_engagement_time")


@query(
    "Q14_fill_gaps",
    f"""SELECT CAST(d AS DATE) AS event_date, {', '.join(f'coalesce(o.{e}, 0) AS {e}' for e in EVENTS[:7])}, coalesce(o.avg_engagement_time, 0) AS avg_engagement_time, strftime(d, '%Y-%m-%d') || ' 00:00:00 UTC' AS key
       FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-25', INTERVAL 1 DAY) g(d) LEFT JOIN overview o ON o.event_date = CAST(d AS DATE)""",
    OVERVIEW,
)
def q14(b: Base):
    return a.fill_gaps(a.events_overview(b.t.events, b.t.links, P, START, END), "2024-01-01", "2024-02-10", "2024-01-25")


@query("Q15_metric_values", f"SELECT DISTINCT 'platform' AS name, raw_platform AS value FROM en WHERE project_id = {P} AND raw_platform IS NOT NULL UNION ALL SELECT DISTINCT 'app_version', app_version FROM en WHERE project_id = {P} AND app_version IS NOT NULL")
def q15(b: Base):
    return a.metric_values(b.enriched, P)


@query("Q16_billing_dau_series", "SELECT c.event_date, CAST(coalesce(sum(d.active_users), 0) AS BIGINT) AS active_users FROM cal c LEFT JOIN dau d ON d.event_date = c.event_date AND d.project_id IN (1, 2) GROUP BY c.event_date")
def q16(b: Base):
    return a.billing_series(b.dau, [1, 2], START, END)


@query("Q17_active_users_daily", "SELECT c.event_date, count(DISTINCT d.visitor_id) AS active_users FROM cal c LEFT JOIN vds d ON d.event_date = c.event_date AND d.project_id IN (1, 2) GROUP BY c.event_date")
def q17_daily(b: Base):
    return a.active_users_daily(b.vds, [1, 2], START, END)


MONTHS = "months AS (SELECT CAST(m AS DATE) AS month FROM generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '2024-02-01', INTERVAL 1 MONTH) g(m)), monthly AS (SELECT m.month, count(DISTINCT v.visitor_id) AS active_users FROM months m LEFT JOIN vds v ON CAST(date_trunc('month', v.event_date) AS DATE) = m.month AND v.project_id IN (1, 2) AND v.event_date BETWEEN DATE '2023-12-20' AND DATE '2024-02-10' GROUP BY m.month)"


@query("Q17_active_users_monthly", "SELECT * FROM monthly", MONTHS)
def q17_monthly(b: Base):
    return a.active_users_monthly(b.vds, [1, 2], "2023-12-20", "2024-02-10")


@query("Q17_active_users_total", "SELECT CAST(sum(active_users) AS BIGINT) AS active_users FROM monthly", MONTHS)
def q17_total(b: Base):
    return a.active_users_total(b.vds, [1, 2], "2023-12-20", "2024-02-10")


MAU = "SELECT i.instance_id, count(DISTINCT v.visitor_id) AS mau FROM instances i LEFT JOIN vds v ON v.project_id = i.project_id AND v.event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY i.instance_id"


@query("Q18_mau", MAU)
def q18(b: Base):
    return a.mau(b.vds, b.instances, "2024-01-01", "2024-01-31")


TOTAL = "SELECT instance_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS mau_total FROM (SELECT i.instance_id, date_trunc('month', v.event_date) AS m, count(DISTINCT v.visitor_id) AS n FROM instances i LEFT JOIN vds v ON v.project_id = i.project_id AND v.event_date BETWEEN DATE '2023-12-15' AND DATE '2024-02-15' GROUP BY ALL) x GROUP BY instance_id"


@query("Q19_mau_total", TOTAL)
def q19(b: Base):
    return a.mau_total(b.vds, b.instances, "2023-12-15", "2024-02-15")


@query("Q20_quota_status", f"SELECT instance_id, mau, CAST(round(mau * 100 / 60.0) AS BIGINT) AS usage_percent, instance_id <> 2 AND mau > 60 AS exceeded, instance_id <> 2 AND round(mau * 100 / 60.0) >= 85 AND mau <= 60 AS warn, greatest(mau - 60, 0) AS paid_maus FROM ({MAU}) m")
def q20(b: Base):
    usage = a.mau(b.vds, b.instances, "2024-01-01", "2024-01-31").withColumn("enterprise", F.col("instance_id") == 2)
    return a.quota_status(usage, 60).drop("enterprise")


@query("Q21_paid_maus", f"SELECT instance_id, greatest(mau - 40, 0) AS paid_maus FROM ({MAU}) m")
def q21(b: Base):
    usage = a.mau(b.vds, b.instances, "2024-01-01", "2024-01-31").withColumn("enterprise", F.lit(False))
    return a.quota_status(usage, 40).select("instance_id", "paid_maus")


@query("Q22_link_search", f"SELECT link_id, name, title, path, campaign_id FROM a_links WHERE project_id = {P} AND active AND NOT sdk_generated AND (name ILIKE '%a_e%' OR title ILIKE '%a_e%' OR path ILIKE '%a_e%')")
def q22(b: Base):
    return a.link_search(b.t.links, P, active=True, sdk=False, term="a_e", sort_by="name").select("link_id", "name", "title", "path", "campaign_id")


@query("Q23_campaign_search", f"SELECT campaign_id, name, archived FROM a_campaigns WHERE project_id = {P} AND NOT archived AND name ILIKE '%i%'")
def q23(b: Base):
    return a.campaign_search(b.t.campaigns, P, archived=False, term="i").select("campaign_id", "name", "archived")


@query(
    "Q24_link_export",
    f"""SELECT k.link_id, k.name, k.title, CASE WHEN k.link_id % 3 = 0 THEN 'Sub' END AS subtitle, TIMESTAMP '2024-01-02 03:04:05' AS updated_at, CASE WHEN k.link_id % 2 = 0 THEN 'dashboard' ELSE 'sdk' END AS generated_from_platform,
       k.sdk_generated, k.active, CASE WHEN k.link_id % 4 = 0 THEN '' ELSE 'a=' || k.link_id || ', b=' END AS data_list, k.path, c.name AS campaign, k.ads_platform, array_to_string(k.tags, ', ') AS tag_list, {sums(table='s.')}, CAST(0 AS DOUBLE) AS avg_engagement_time
       FROM a_links k LEFT JOIN a_campaigns c ON c.campaign_id = k.campaign_id LEFT JOIN lds s ON s.link_id = k.link_id AND s.{RANGE} WHERE k.project_id = {P} AND k.active AND NOT k.sdk_generated GROUP BY ALL""",
)
def q24(b: Base):
    links = b.t.links.withColumns({
        "subtitle": F.when(F.col("link_id") % 3 == 0, "Sub"),
        "updated_at": F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"),
        "generated_from_platform": F.when(F.col("link_id") % 2 == 0, "dashboard").otherwise("sdk"),
        "data": F.when(F.col("link_id") % 4 != 0, F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("a"), F.col("link_id").cast("string"))),
    })
    return a.link_export(links, b.lds, b.t.campaigns, P, START, END)


@query(
    "Q25_visitor_details",
    f"""SELECT v.visitor_id, CAST(sum(s.views) AS BIGINT) AS total_views, CAST(sum(s.installs) AS BIGINT) AS total_installs, CAST(sum(s.revenue) AS BIGINT) AS total_revenue,
       coalesce((SELECT CAST(sum(w.views) AS BIGINT) FROM vds w WHERE w.invited_by_id = v.visitor_id AND w.{RANGE}), 0) AS invited_views,
       coalesce((SELECT CAST(sum(w.installs) AS BIGINT) FROM vds w WHERE w.invited_by_id = v.visitor_id AND w.{RANGE}), 0) AS invited_installs,
       coalesce((SELECT count(*) FROM a_links k WHERE k.visitor_id = v.visitor_id AND k.project_id = {P}), 0) AS links
       FROM a_visitors v JOIN vds s ON s.visitor_id = v.visitor_id AND s.{RANGE} WHERE v.project_id = {P} GROUP BY v.visitor_id""",
)
def q25(b: Base):
    return a.visitor_details(b.t.visitors, b.vds, b.t.devices, b.t.links, P, START, END)


@query("Q26_server_link_metrics", f"SELECT k.link_id, k.name, k.campaign_id, {sums(table='s.')} FROM a_links k LEFT JOIN lds s ON s.link_id = k.link_id WHERE k.project_id = {P} GROUP BY k.link_id, k.name, k.campaign_id")
def q26(b: Base):
    return a.link_statistics(b.t.links, b.lds, P, "1970-01-01", "2100-01-01", active=None)


@query("Q27_last_seen", "SELECT project_id, device_id, event_id, event, created_at FROM (SELECT *, row_number() OVER (PARTITION BY project_id, device_id ORDER BY created_at DESC, event_id DESC) AS k FROM a_events) x WHERE k = 1")
def q27(b: Base):
    return a.last_seen(b.t.events)


def _notifications(b: Base):
    made = b.t.campaigns.select(
        F.col("campaign_id").alias("notification_id"), "project_id", F.col("name").alias("title"), F.lit(None).cast("string").alias("subtitle"), "archived",
        (F.col("campaign_id") % 2 == 0).alias("new_users"), (F.col("campaign_id") % 3 == 0).alias("auto_display"),
        F.when(F.col("campaign_id") % 4 == 0, F.array(F.lit("ios"), F.lit("desktop"))).when(F.col("campaign_id") % 4 == 1, F.array().cast("array<string>")).alias("platforms"),
    )
    people = b.t.visitors.select("visitor_id", F.col("project_id").alias("_p"))
    messages = made.join(people, F.col("project_id") == F.col("_p")).filter("(visitor_id + notification_id) % 5 < 2")
    return made, messages.select("notification_id", "visitor_id", ((F.col("visitor_id") + F.col("notification_id")) % 5 == 0).alias("read"))


NOTES = """notes AS (SELECT campaign_id AS notification_id, project_id, name AS title, archived, campaign_id % 2 = 0 AS new_users, campaign_id % 3 = 0 AS auto_display, campaign_id % 4 AS kind FROM a_campaigns),
msgs AS (SELECT n.notification_id, v.visitor_id, (v.visitor_id + n.notification_id) % 5 = 0 AS read FROM notes n JOIN a_visitors v ON v.project_id = n.project_id WHERE (v.visitor_id + n.notification_id) % 5 < 2)"""


@query("Q28_notification_list", "SELECT notification_id, title, (SELECT count(*) FROM msgs m WHERE m.notification_id = n.notification_id AND m.read) AS read_count FROM notes n WHERE NOT archived AND new_users AND lower(title) LIKE '%a%'", NOTES)
def q28(b: Base):
    return n.listed(*_notifications(b), new_users=True, term="A").select("notification_id", "title", "read_count")


@query("Q29_notifications_for_device", "SELECT n.notification_id, m.read FROM notes n JOIN msgs m ON m.notification_id = n.notification_id WHERE m.visitor_id = 3 AND kind <> 0", NOTES)
def q29(b: Base):
    return n.for_device(*_notifications(b), 3, "android").select("notification_id", "read")


@query("Q30_unread_count", "SELECT visitor_id, count(*) AS unread FROM msgs WHERE NOT read GROUP BY visitor_id", NOTES)
def q30(b: Base):
    return n.unread(_notifications(b)[1])


@query("Q30_auto_display", "SELECT notification_id, title FROM notes n WHERE auto_display AND EXISTS (SELECT 1 FROM msgs m WHERE m.notification_id = n.notification_id AND m.visitor_id = 3 AND NOT m.read)", NOTES)
def q30_auto(b: Base):
    return n.auto_display(*_notifications(b), 3).select("notification_id", "title")


@query(
    "Q31_audience_fanout",
    """SELECT n.notification_id, v.visitor_id, false AS read FROM notes n JOIN a_visitors v ON v.project_id = n.project_id JOIN a_devices d ON d.device_id = v.device_id
       WHERE n.notification_id % 6 <> 0 AND ((kind = 0 AND d.platform IN ('ios', 'web')) OR (kind <> 0 AND d.platform IN ('ios', 'android', 'web')))""",
    NOTES,
)
def q31(b: Base):
    made, messages = _notifications(b)
    return n.audience(made, b.t.visitors, b.t.devices, made.filter("notification_id % 6 = 0").select("notification_id"))


@query("Q32_enterprise_mau_precompute", f"SELECT * FROM ({TOTAL}) t WHERE instance_id = 2")
def q32(b: Base):
    return a.mau_total(b.vds, b.instances.filter("instance_id = 2"), "2023-12-15", "2024-02-15")


@query("Q33_campaign_has_links", "SELECT campaign_id, EXISTS (SELECT 1 FROM a_links k WHERE k.campaign_id = c.campaign_id AND (k.active OR c.archived)) AS has_links FROM a_campaigns c")
def q33(b: Base):
    return a.campaigns_with_links(b.t.campaigns, b.t.links)


@query("Q34_invited_visitors", "SELECT inviter_id AS visitor_id, count(*) AS invited, array_to_string(list(visitor_id ORDER BY visitor_id), ',') AS invited_ids FROM a_visitors WHERE inviter_id IS NOT NULL GROUP BY inviter_id")
def q34(b: Base):
    return a.invited_visitors(b.t.visitors)


@query("Q36_cache_hit_report", "SELECT coalesce(event, 'TOTAL') AS model, CAST(sum(CASE WHEN link_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN link_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS misses, round(CAST(sum(CASE WHEN link_id IS NOT NULL THEN 1 ELSE 0 END) * 100 AS DOUBLE) / count(*), 2) AS rate FROM a_events GROUP BY ROLLUP (event)")
def q36(b: Base):
    hits = b.t.events.select(F.col("event").alias("model"), F.col("link_id").isNotNull().cast("long").alias("hits"), F.col("link_id").isNull().cast("long").alias("misses"))
    return a.cache_report(hits)


@query("Q37_old_returning", f"SELECT count(DISTINCT visitor_id) AS returning FROM vds v WHERE project_id = {P} AND event_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-05' AND EXISTS (SELECT 1 FROM vds w WHERE w.project_id = {P} AND w.visitor_id = v.visitor_id AND w.platform = v.platform AND w.event_date < DATE '2024-01-03')")
def q37(b: Base):
    return a.returning_in_range(b.vds, P, "2024-01-03", "2024-01-05")

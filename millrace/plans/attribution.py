"""Queries of link resolution, attribution windows, logs and tenants."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import expr
from millrace.operators import attribution as a
from millrace.operators import ingest
from millrace.plans.base import Base, query

MADE = """CASE event_id % 6 WHEN 0 THEN 'https://go.example.com/' || path || '?utm=1' WHEN 1 THEN 'http://me@www.shop.example.org:8080/' || path || '#top' WHEN 2 THEN 'myapp://' || path || '/x' WHEN 3 THEN 'example.net'
 WHEN 4 THEN 'no url' ELSE 'HTTPS://Example.com/' || path || '/a?b=c' END"""
URLS = f"urls AS (SELECT event_id AS url_id, {MADE} AS url FROM (SELECT event_id, 'p' || CAST(link_id AS VARCHAR) AS path FROM a_events WHERE link_id IS NOT NULL) x)"


def _urls(b: Base):
    x = b.t.events.filter("link_id is not null").select("event_id", F.concat(F.lit("p"), F.col("link_id").cast("string")).alias("path"))
    return x.select(F.col("event_id").alias("url_id"), F.expr(MADE).alias("url"))


@query("A1_strip_query_params", "SELECT url_id, CASE WHEN url LIKE '%://%' THEN split_part(split_part(url, '?', 1), '#', 1) ELSE url END AS url FROM urls", URLS)
def a1(b: Base):
    return _urls(b).select("url_id", expr.strip_query(F.col("url")).alias("url"))


@query(
    "A2_parse_universal_link",
    """SELECT url_id, array_to_string(list_slice(parts, -2, -1), '.') AS domain, array_to_string(list_slice(parts, 1, len(parts) - 2), '.') AS subdomain, path FROM (
         SELECT url_id, string_split(lower(regexp_extract(url, '^[A-Za-z]+://(?:[^@/]*@)?([^/:]+)', 1)), '.') AS parts, regexp_extract(url, '^[A-Za-z]+://[^/]*/([^?#]*)', 1) AS path FROM urls WHERE url ILIKE 'http%') x""",
    URLS,
)
def a2(b: Base):
    return a.parse_links(_urls(b)).filter("lower(url) like 'http%'").select("url_id", "domain", "subdomain", "path")


@query("A3_parse_uri", "SELECT url_id, 'myapp' AS domain, CAST(NULL AS VARCHAR) AS subdomain, regexp_extract(url, '//([^/]*)', 1) AS path FROM urls WHERE url LIKE 'myapp%'", URLS)
def a3(b: Base):
    return a.parse_links(_urls(b)).filter("url like 'myapp%'").select("url_id", "domain", "subdomain", "path")


@query(
    "A4_link_for_url",
    """SELECT u.url_id, CASE WHEN u.url LIKE 'https://go.%' THEN l.link_id WHEN u.url LIKE 'myapp%' THEN l.link_id END AS link_id
       FROM urls u JOIN a_events e ON e.event_id = u.url_id LEFT JOIN a_links l ON l.link_id = e.link_id AND (u.url NOT LIKE 'https://go.%' OR l.active)
       AND (u.url NOT LIKE 'myapp%' OR NOT l.active)""",
    URLS,
)
def a4(b: Base):
    web = F.col("active")
    links = b.t.links.select("link_id", F.when(web, "example.com").alias("domain"), F.when(web, "go").alias("subdomain"), F.when(~web, "myapp").alias("uri_scheme"), F.lit(False).alias("test"), "path")
    return a.links_for_urls(_urls(b), links).select("url_id", "link_id")


OPENS = "opens AS (SELECT event_id AS open_id, device_id, created_at AS at FROM a_events WHERE event = 'open')"


def _opens(b: Base):
    return b.t.events.filter("event = 'open'").select(F.col("event_id").alias("open_id"), "device_id", F.col("created_at").alias("at"))


def _window(minutes: int) -> str:
    return f"""best AS (SELECT o.open_id, arg_max(a.action_id, (a.at, a.action_id)) AS action_id, arg_max(a.link_id, (a.at, a.action_id)) AS action_link_id
    FROM opens o JOIN actions a ON a.device_id = o.device_id AND a.action_id <> o.open_id AND a.at <= o.at AND a.at >= o.at - INTERVAL {minutes} MINUTE GROUP BY o.open_id)"""


@query("A5_action_for_device", "SELECT o.open_id, o.device_id, b.action_id, b.action_link_id FROM opens o LEFT JOIN best b ON b.open_id = o.open_id", f"{OPENS}, {_window(360).replace('a.action_id <> o.open_id AND ', '')}")
def a5(b: Base):
    return a.actions_in_window(_opens(b), b.actions, 360).select("open_id", "device_id", "action_id", "action_link_id")


@query(
    "A6_create_action_if_needed",
    "SELECT action_id FROM stored",
    """starts AS (SELECT x.device_id, x.link_id, arg_min(x.action_id, (x.at, x.action_id)) AS action_id, min(x.at) AS moment FROM actions x GROUP BY x.device_id, x.link_id),
stored(device_id, link_id, action_id, moment) AS (
  SELECT f.device_id, f.link_id, f.action_id, f.moment FROM starts f UNION ALL
  SELECT s.device_id, s.link_id, arg_min(x.action_id, (x.at, x.action_id)), min(x.at) FROM stored s JOIN actions x ON x.device_id = s.device_id AND x.link_id = s.link_id
  AND x.at > s.moment + INTERVAL 7200 MINUTE GROUP BY s.device_id, s.link_id
)""",
)
def a6(b: Base):
    return a.new_actions(b.actions, 7200).select("action_id")


@query("A7_mark_handled_before", "SELECT a.action_id, a.at <= coalesce((SELECT max(o.at) FROM opens o WHERE o.device_id = a.device_id AND o.open_id % 5 = 0), TIMESTAMP '1970-01-01') AS handled FROM actions a", OPENS)
def a7(b: Base):
    return a.handled(b.actions, _opens(b).filter("open_id % 5 = 0")).select("action_id", "handled")


@query(
    "A8_fingerprint_match",
    """SELECT r.open_id AS request_id, (SELECT CASE WHEN count(DISTINCT e.device_id) = 1 THEN min(e.device_id) WHEN count(DISTINCT CASE WHEN e.device_id % 2 = r.device_id % 2 THEN e.device_id END) = 1 THEN min(CASE WHEN e.device_id % 2 = r.device_id % 2 THEN e.device_id END) END
       FROM a_events e WHERE e.event = 'view' AND e.project_id = 1 + r.device_id % 3 AND e.device_id % 7 = r.device_id % 7 AND e.created_at <= r.at AND e.created_at >= r.at - INTERVAL 360 MINUTE) AS device_id FROM opens r""",
    OPENS,
)
def a8(b: Base):
    marks = lambda d: [F.col(d).alias("device_id"), (1 + F.col("device_id") % 3).alias("project_id"), (F.col("device_id") % 7).alias("remote_ip"), F.lit("ios").alias("ua_platform"), F.lit("17").alias("ua_version"), *[F.when(F.lit(True), F.col("device_id") % 2).alias(c) for c in a.TIE_BREAK]]
    requests = _opens(b).select(F.col("open_id").alias("request_id"), "at", *marks("device_id")).drop("device_id")
    seen = b.t.events.filter("event = 'view'").select(F.col("created_at").alias("at"), *marks("device_id"))
    return a.fingerprint_matches(requests, seen, 360)


AGENTS = ["Mozilla/5.0 (iPhone)", "Twitterbot/1.0", "Mozilla BingPreview/1.0b", "Mozilla/5.0 (Linux; Android 14)", "WhatsApp/2.2", "Microsoft Office/16"]


@query("A9_bot_filter", "SELECT event_id, event_id % 6 IN (1, 2, 4, 5) AS preview, event_id % 6 IN (0, 3) AND event_id % 7 <> 0 AS counted FROM a_events")
def a9(b: Base):
    agent = F.element_at(F.array(*[F.lit(x) for x in AGENTS]), (F.col("event_id") % 6 + 1).cast("int"))
    return b.t.events.select("event_id", expr.is_preview(agent).alias("preview"), expr.counts_as_view(agent, F.col("event_id") % 7 == 0, F.lit(None).cast("boolean")).alias("counted"))


@query("A10_deferred_open", "SELECT open_id, device_id, action_link_id AS link_id FROM (SELECT o.*, b.action_id, b.action_link_id, row_number() OVER (PARTITION BY b.action_id ORDER BY o.at, o.open_id) AS k FROM opens o JOIN best b ON b.open_id = o.open_id) x WHERE k = 1", f"{OPENS}, {_window(360).replace('a.action_id <> o.open_id AND ', '')}")
def a10(b: Base):
    found = a.actions_in_window(_opens(b), b.actions, 360).filter("action_id is not null")
    return a.first_per_action(found).select("open_id", "device_id", "link_id")


@query(
    "A10_resolved_opens",
    """SELECT open_id, project_id, device_id, asked AS link_id FROM found WHERE asked IS NOT NULL AND action_id IS NULL UNION ALL
SELECT f.open_id, f.project_id, f.device_id, coalesce(f.asked, f.action_link) FROM found f JOIN acts x ON x.action_id = f.action_id LEFT JOIN a_links l ON l.link_id = f.action_link
WHERE (f.asked IS NOT NULL OR l.project_id = f.project_id AND l.active) AND x.action_id % 9 <> 0
  AND NOT EXISTS (SELECT 1 FROM found g JOIN acts y ON y.action_id = g.action_id WHERE g.device_id = f.device_id AND (g.at, g.open_id) < (f.at, f.open_id) AND y.at >= x.at)""",
    f"""{OPENS},
acts AS (SELECT event_id AS action_id, device_id, link_id, created_at AS at FROM a_events WHERE event = 'view' AND link_id IS NOT NULL),
reqs AS (SELECT o.open_id, 1 + o.device_id % 3 AS project_id, o.device_id, CASE WHEN o.open_id % 5 = 0 THEN NULL ELSE o.device_id END AS matched, o.at,
  CASE WHEN o.open_id % 4 = 0 THEN (SELECT max(x.link_id) FROM acts x WHERE x.device_id = o.device_id) WHEN o.open_id % 4 = 2 THEN 1 + o.open_id % 100 END AS asked FROM opens o),
found AS (SELECT r.open_id, r.project_id, r.device_id, r.at, r.asked, arg_max(x.action_id, (x.at, x.action_id)) AS action_id, arg_max(x.link_id, (x.at, x.action_id)) AS action_link
  FROM reqs r LEFT JOIN a_links k ON k.link_id = r.asked LEFT JOIN acts x ON x.device_id = r.matched AND x.at <= r.at AND x.at >= r.at - INTERVAL 14400 MINUTE AND (r.asked IS NULL OR x.link_id = r.asked)
  WHERE r.asked IS NULL OR k.project_id = r.project_id GROUP BY ALL)""",
)
def a10_resolved(b: Base):
    views = b.t.events.filter("event = 'view' and link_id is not null")
    actions = views.select(F.col("event_id").alias("action_id"), "device_id", "link_id", F.col("created_at").alias("at"), (F.col("event_id") % 9 == 0).alias("handled"))
    favourite = views.groupBy("device_id").agg(F.max("link_id").alias("_favourite"))
    asked = F.when(F.col("open_id") % 4 == 0, F.col("_favourite")).when(F.col("open_id") % 4 == 2, 1 + F.col("open_id") % 100)
    requests = _opens(b).join(favourite, "device_id", "left").select("open_id", "device_id", "at", (1 + F.col("device_id") % 3).alias("project_id"), asked.alias("link_id"))
    matches = requests.filter("open_id % 5 <> 0").select("open_id", "device_id")
    links = b.t.links.withColumn("opens_app", F.col("active"))
    return a.resolved_opens(requests, matches, actions, links, 14400).select("open_id", "project_id", "device_id", "link_id")


@query("A11_generate_path")
def a11(b: Base):
    names = b.t.links.select(F.lit("example.com").alias("domain"), F.col("link_id").alias("seed"))
    return a.new_paths(names, b.t.links.select(F.lit("example.com").alias("domain"), "path"))


@query("A12_firebase_import", """SELECT link_id AS line, reason, CASE WHEN reason = 'created' THEN CASE WHEN link_id = 1 THEN 'same' ELSE path || 'x' END END AS path, CASE WHEN reason = 'created' THEN CASE WHEN link_id % 4 = 0 THEN '' ELSE 'c' || link_id END END AS utm_campaign,
       CASE WHEN reason = 'created' THEN 'myapp.example://item/' || link_id END AS link
     FROM (SELECT *, CASE WHEN link_id % 10 = 0 THEN 'blank path' WHEN link_id % 10 = 1 AND link_id > 1 THEN 'duplicate' WHEN link_id % 10 = 2 THEN 'duplicate' ELSE 'created' END AS reason FROM a_links)""")
def a12(b: Base):
    path = F.when(F.col("link_id") % 10 == 0, " ").when(F.col("link_id") % 10 == 1, "/go/same").when(F.col("link_id") % 10 == 2, "/go/old").otherwise(F.concat(F.lit("/go/"), F.col("path"), F.lit("/go/x ")))
    campaign = F.when(F.col("link_id") % 4 != 0, F.concat(F.lit(" c"), F.col("link_id")))
    empty = F.lit(None).cast("string")
    rows = b.t.links.select(F.col("link_id").alias("line"), path.alias("path"), "name", campaign.alias("utm_campaign"), empty.alias("utm_medium"), empty.alias("utm_source"), F.concat(F.lit("https://myapp.example/item/"), F.col("link_id")).alias("link"))
    good, skipped = a.import_links(rows, b.spark.createDataFrame([("old",)], "path string"), ["/go/"], "https://myapp.example/")
    made = good.select("line", F.lit("created").alias("reason"), "path", "utm_campaign", "link")
    return made.unionByName(skipped, allowMissingColumns=True)


@query("A13_link_display_defaults", "SELECT link_id, CASE WHEN link_id % 3 = 0 THEN CASE WHEN link_id % 2 = 0 THEN 'Open the app' ELSE 'Domain' END ELSE title END AS shown_title, CASE WHEN link_id % 5 = 0 THEN 'Sub' ELSE '' END AS shown_subtitle, CASE WHEN link_id % 2 = 0 THEN 'own.png' WHEN link_id % 3 = 0 THEN 'domain.png' ELSE 'preview.png' END AS shown_image FROM a_links")
def a13(b: Base):
    given = b.t.links.select("link_id", F.when(F.col("link_id") % 3 == 0, " ").otherwise(F.col("title")).alias("title"), F.lit(None).cast("string").alias("subtitle"), F.when(F.col("link_id") % 2 == 1, "Domain").alias("domain_title"), F.when(F.col("link_id") % 5 == 0, "Sub").otherwise("").alias("domain_subtitle"), F.when(F.col("link_id") % 2 == 0, "own.png").alias("image"), F.when(F.col("link_id") % 3 == 0, "domain.png").otherwise(" ").alias("domain_image"))
    return a.display(given).select("link_id", "shown_title", "shown_subtitle", "shown_image")


@query("A14_utm_append", "SELECT url_id, url || CASE WHEN instr(url, '?') > 0 THEN '&' ELSE '?' END || 'utm_source=app' || CASE WHEN url_id % 2 = 0 THEN '&utm_campaign=' || url_id ELSE '' END AS url FROM urls", URLS)
def a14(b: Base):
    campaign = F.when(F.col("url_id") % 2 == 0, F.col("url_id").cast("string"))
    return _urls(b).select("url_id", expr.append_utm(F.col("url"), source=F.lit("app"), campaign=campaign).alias("url"))


#: Log lines, and what is to be made of them: type, severity, number, error class, status, trace, error type.
LOGS = [
    ('{"timestamp":"t","level":"error","message":"x"}', "json_structured", "ERROR", 17, None, None, None, None),
    ('{"level": "ERR", "message": "x"}', "json_structured", "ERROR", 17, None, None, None, None),
    ('{"level":"Critical","trace_id":"0af7651916cd43dd"}', "json_structured", "FATAL", 21, None, None, "0af7651916cd43dd", None),
    ('{"level":"trace"}', "json_structured", "TRACE", 1, None, None, None, None),
    ('{"level":"debug"}', "json_structured", "DEBUG", 5, None, None, None, None),
    ('{"level":"warning"}', "json_structured", "WARN", 13, None, None, None, None),
    ('{"level":"notice"}', "json_structured", "INFO", 9, None, None, None, None),
    ('{"level":"INFO","message":"{\\"status\\":503}","service":"s"}', "json_structured", "INFO", 9, None, 503, None, None),
    ('E, [2024-01-01T00:00:00.1 #12] ERROR -- : Db::TimeoutError: pool', "rails", "ERROR", 17, "TimeoutError", None, None, None),
    ('I, [2024-01-01T00:00:00.1 #12]  INFO -- : [id] {"method":"GET","path":"/a","status":404}', "rails_structured", "WARN", 13, None, 404, None, None),
    ('I, [2024-01-01T00:00:00.1 #12]  INFO -- : {"status":500} FATAL', "rails_structured", "FATAL", 21, None, 500, None, "fatal_error"),
    ('F, [2024-01-01T00:00:00.1 #12] FATAL -- : gone', "rails", "FATAL", 21, None, None, None, None),
    ('W, [2024-01-01T00:00:00.1 #12]  WARN -- : slow   ', "rails", "WARN", 13, None, None, None, None),
    ('GET /a status=404 12ms', "application", "INFO", 9, None, None, None, None),
    ('started', "test_message", "INFO", 9, None, None, None, None),
    (None, None, "INFO", 9, None, None, None, None),
]


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


@query(
    "A15_log_classify",
    f"""SELECT event_id, CAST(log_type AS VARCHAR) AS log_type, severity, severity_number, CAST(error_class AS VARCHAR) AS error_class, CAST(http_status AS INTEGER) AS http_status,
       CAST(trace_id AS VARCHAR) AS trace_id, CAST(error_type AS VARCHAR) AS error_type
       FROM a_events JOIN (VALUES {", ".join(f"({k}, {', '.join(map(_literal, x[1:]))})" for k, x in enumerate(LOGS))}) l(k, log_type, severity, severity_number, error_class, http_status, trace_id, error_type) ON k = event_id % {len(LOGS)}""",
)
def a15(b: Base):
    line = F.element_at(F.array(*[F.lit(x[0]) for x in LOGS]), (F.col("event_id") % len(LOGS) + 1).cast("int"))
    made = a.classify_logs(b.t.events.select("event_id", line.alias("line")))
    return made.select("event_id", "log_type", "severity", "severity_number", "error_class", F.col("http_status").cast("int"), "trace_id", "error_type")


@query("A16_tenant_delete", "SELECT event_id, project_id FROM a_events WHERE project_id NOT IN (SELECT project_id FROM instances WHERE instance_id = 1)")
def a16(b: Base):
    return a.without_tenant(b.t.events, b.instances.filter("instance_id = 1")).select("event_id", "project_id")


@query("I17_drain_queue", "SELECT device_id, 'ios' AS platform, max(created_at) AS at FROM a_events WHERE event_id % 4 = 0 GROUP BY device_id HAVING max(created_at) > TIMESTAMP '2024-01-28 00:00:00'")
def i17(b: Base):
    jobs = b.t.events.select(F.when(F.col("event_id") % 4 == 0, "device").otherwise("event").alias("job"), "event_id", "device_id", F.lit("ios").alias("platform"), F.col("created_at").alias("at"))
    stored = b.t.devices.select("device_id", F.lit("2024-01-28").cast("timestamp_ntz").alias("updated_at"))
    return ingest.replay_backlog(jobs, stored)[1]

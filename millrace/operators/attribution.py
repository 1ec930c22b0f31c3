"""Link resolution, attribution windows, fingerprints, log lines, tenants."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expr import or_default, registrable_domain, subdomain, url_host, url_path
from millrace.functions.folds import apart
from millrace.schemas import ACTION_WINDOW_MINUTES


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def parse_links(urls: DataFrame) -> DataFrame:
    """domain, subdomain and path of web links; of other schemes the scheme as domain and host or path as path."""
    host = url_host(F.col("url"))
    scheme = F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    web = scheme.isin("http", "https")
    own = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*:/*([^/?#]+)", 1)
    return urls.withColumns({
        "domain": F.when(web, registrable_domain(host)).when(scheme != "", scheme),
        "subdomain": F.when(web, subdomain(host)),
        "path": F.when(web, url_path(F.col("url"))).when(scheme != "", own),
    })


def links_for_urls(urls: DataFrame, links: DataFrame) -> DataFrame:
    """The link of each URL (url_id, url): by domain, subdomain and path, else by scheme as domain, else by the
    project's own scheme with production before test. ``links`` has link_id, domain, subdomain, uri_scheme, test, path.
    Blank URLs, those with non-ASCII characters and those without a scheme have none."""
    good = urls.filter(F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[\x21-\x7E]+$"))
    parsed = parse_links(good)
    p = parsed.select("url_id", F.col("domain").alias("d"), F.coalesce("subdomain", F.lit("")).alias("s"), F.col("path").alias("p"))
    by_host = links.select("link_id", F.col("domain").alias("d"), F.coalesce("subdomain", F.lit("")).alias("s"), F.col("path").alias("p"))
    by_scheme = links.select("link_id", F.col("uri_scheme").alias("d"), F.col("path").alias("p"), "test")
    first = p.join(by_host, ["d", "s", "p"]).select("url_id", "link_id", F.lit(0).alias("rank"))
    second = p.join(by_scheme, ["d", "p"]).select("url_id", "link_id", F.when(F.col("test"), 2).otherwise(1).alias("rank"))
    best = first.union(second).groupBy("url_id").agg(F.min_by("link_id", F.struct("rank", "link_id")).alias("link_id"))
    return urls.join(best, "url_id", "left")


def actions_in_window(opens: DataFrame, actions: DataFrame, minutes: int = ACTION_WINDOW_MINUTES, by: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """For each open (open_id, device_id, at) the device's latest action (action_id, device_id, link_id, at) within the
    window; ``by`` device and link_id, that of the open's link. Both are dealt into windows of time as well as devices, so a busy device is no one task's."""
    width = minutes * 60 * 1_000_000
    o = opens.withColumn("_at", _micros("at")).withColumn("_slot", F.explode(F.array(F.floor(F.col("_at") / width), F.floor(F.col("_at") / width) - 1)))
    a = actions.select("action_id", "device_id", "link_id", _micros("at").alias("_when")).withColumn("_slot", F.floor(F.col("_when") / width))
    hit = o.join(a, [*by, "_slot"]).filter((F.col("_when") <= F.col("_at")) & (F.col("_when") >= F.col("_at") - width))
    best = hit.groupBy("open_id").agg(F.max_by(F.struct("action_id", "link_id"), F.struct("_when", "action_id")).alias("_best"))
    return opens.join(best, "open_id", "left").withColumns({"action_id": F.col("_best.action_id"), "action_link_id": F.col("_best.link_id")}).drop("_best")


def new_actions(actions: DataFrame, minutes: int = ACTION_WINDOW_MINUTES) -> DataFrame:
    """Attempts that make an action: those without an action of the same device and link in the window before. Attempts
    that made none do not count."""
    return apart(actions, ["device_id", "link_id"], ["at", "action_id"], minutes * 60_000_000)


def handled(actions: DataFrame, matched: DataFrame) -> DataFrame:
    """Actions at or before each device's latest matched action (device_id, at) are handled."""
    last = matched.groupBy("device_id").agg(F.max("at").alias("_last"))
    return actions.join(last, "device_id", "left").withColumn("handled", F.coalesce(F.col("at") <= F.col("_last"), F.lit(False))).drop("_last")


def first_per_action(found: DataFrame) -> DataFrame:
    """The first open of each action, as an open event on its link."""
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy("action_id").orderBy("at", "open_id"))).filter("_k = 1")
    return first.select("open_id", "device_id", F.col("action_link_id").alias("link_id"), F.lit("open").alias("event"), "at")


def deferred_opens(opens: DataFrame, actions: DataFrame) -> DataFrame:
    """The open event of each open with an action in its window that was not handled before."""
    return first_per_action(actions_in_window(opens, actions).filter("action_id is not null"))


def resolved_opens(requests: DataFrame, matches: DataFrame, actions: DataFrame, links: DataFrame, minutes: int = ACTION_WINDOW_MINUTES) -> DataFrame:
    """The open events of link requests (open_id, project_id, device_id, link_id or null, at), where ``matches`` (open_id,
    device_id) has the device that each one's fingerprint met and ``actions`` may have been ``handled`` already.

    A request for a link of its project is an open of it, unless the matched device's latest action on that link was handled.
    A request without a link is one of the matched device's latest action's link, if that is of the project, opens the app
    (``opens_app``) and was not handled. A request handles all actions of the device up to its own for the requests after it."""
    theirs = matches.filter("device_id is not null").select("open_id", F.col("device_id").alias("_matched"))
    owners = links.select("link_id", F.col("project_id").alias("_owner"), "opens_app")
    known = requests.join(theirs, "open_id", "left").withColumnsRenamed({"device_id": "_device", "_matched": "device_id"})
    asked = known.filter("link_id is not null").join(owners.drop("opens_app"), "link_id").filter("_owner = project_id").drop("_owner")
    asked = actions_in_window(asked, actions, minutes, ("device_id", "link_id")).drop("action_link_id")
    asked = asked.withColumns({"_link": F.col("link_id"), "_opens": F.lit(True)})
    free = actions_in_window(known.filter("link_id is null").drop("link_id"), actions, minutes).filter("action_id is not null")
    free = free.join(owners.withColumnRenamed("link_id", "action_link_id"), "action_link_id", "left")
    free = free.withColumns({"_link": F.col("action_link_id"), "_opens": F.coalesce((F.col("_owner") == F.col("project_id")) & F.col("opens_app"), F.lit(False))})
    columns = ["open_id", "project_id", "_device", "device_id", "at", "action_id", "_link", "_opens"]
    found = asked.select(*columns).unionByName(free.select(*columns)).join(actions.select("action_id", F.col("at").alias("_when"), "handled"), "action_id", "left")
    # Requests without an action handle nothing and are not in the window.
    before = Window.partitionBy("device_id").orderBy("at", "open_id").rowsBetween(Window.unboundedPreceding, -1)
    with_action = found.filter("action_id is not null").withColumn("_last", F.max("_when").over(before))
    done = F.col("handled") | F.coalesce(F.col("_last") >= F.col("_when"), F.lit(False))
    made = with_action.filter(F.col("_opens") & ~done).select("open_id", "project_id", "_device", "_link", "at")
    made = made.unionByName(found.filter("action_id is null").select("open_id", "project_id", "_device", "_link", "at"))
    return made.select("open_id", "project_id", F.col("_device").alias("device_id"), F.col("_link").alias("link_id"), F.lit("open").alias("event"), "at")


TIE_BREAK = ["screen_width", "screen_height", "timezone", "webgl_vendor", "webgl_renderer", "language"]


def fingerprint_matches(requests: DataFrame, seen: DataFrame, minutes: int = 5) -> DataFrame:
    """The device of each request (request_id, project_id, remote_ip, ua_platform, ua_version, at, TIE_BREAK), if exactly
    one was seen with the same address, platform and version in the window; of several, only those that agree in
    every further mark, none of them null."""
    keys = ["project_id", "remote_ip", "ua_platform", "ua_version"]
    # Exactly one device was seen where the least and the greatest are equal, so no pairs of requests and views are made. A window
    # ends in one slot of its width and begins in the slot before: running extremes, forward in the one and backward in the other.
    width = minutes * 60_000_000
    theirs = seen.select(*keys, *TIE_BREAK, "device_id", _micros("at").alias("_at"), F.lit(0).alias("_side"))
    asked = requests.select("request_id", *keys, *TIE_BREAK, F.explode(F.array(*[F.struct(_micros("at") - k * width, F.lit(k + 1)) for k in (0, 1)])).alias("_end"))
    asked = asked.select("*", F.col("_end.col1").alias("_at"), F.col("_end.col2").alias("_side")).drop("_end")
    rows = theirs.unionByName(asked, allowMissingColumns=True).dropna(subset=[*keys, "_at"])
    rows = rows.withColumn("_slot", F.col("_at") - F.pmod("_at", F.lit(width)))

    def extreme(of, *by: str):
        window = Window.partitionBy(*keys, "_slot", *by).rowsBetween(Window.unboundedPreceding, 0)
        forward, backward = (of("device_id").over(window.orderBy(order, "_side")) for order in ("_at", F.desc("_at")))  # views of the same moment come first
        return F.when(F.col("_side") == 1, forward).when(F.col("_side") == 2, backward)

    complete = F.lit(True)
    for c in TIE_BREAK:
        complete = complete & F.col(c).isNotNull()
    ran = rows.withColumns({"_least": extreme(F.min), "_most": extreme(F.max), "_least_same": extreme(F.min, *TIE_BREAK), "_most_same": extreme(F.max, *TIE_BREAK)})
    met = ran.filter("_side > 0").groupBy("request_id").agg(
        F.min("_least").alias("least"), F.max("_most").alias("most"), F.min(F.when(complete, F.col("_least_same"))).alias("least_same"), F.max(F.when(complete, F.col("_most_same"))).alias("most_same")
    )
    device = F.when(F.col("least") == F.col("most"), F.col("least")).when(F.col("least_same") == F.col("most_same"), F.col("least_same"))
    return requests.select("request_id").join(met.select("request_id", device.alias("device_id")), "request_id", "left")


#: The image of links that have none, nor their domain; a deployment sets its own.
PREVIEW_IMAGE = "preview.png"


def display(links: DataFrame) -> DataFrame:
    """Title, subtitle and image of a link, else of its domain, else the defaults; blank is missing, but for a link's own image."""
    return links.withColumns({
        "shown_title": F.coalesce(or_default(F.col("title"), F.col("domain_title")), F.lit("Open the app")),
        "shown_subtitle": F.coalesce(or_default(F.col("subtitle"), F.col("domain_subtitle")), F.lit("")),
        "shown_image": F.coalesce(F.col("image"), or_default(F.col("domain_image")), F.lit(PREVIEW_IMAGE)),
    })


def new_paths(names: DataFrame, taken: DataFrame, test: bool = False) -> DataFrame:
    """A six-digit hexadecimal path for every row (domain, seed) that no link of its domain has; seeds that would collide
    are left out, to be given again with another seed."""
    path = F.concat(F.lower(F.substring(F.hex(F.xxhash64("domain", "seed")), 1, 6)), F.lit("-test" if test else ""))
    made = names.withColumn("path", F.lpad(path, 11 if test else 6, "0"))
    first = made.withColumn("_k", F.row_number().over(Window.partitionBy("domain", "path").orderBy("seed"))).filter("_k = 1").drop("_k")
    return first.join(taken.select("domain", "path"), ["domain", "path"], "left_anti")


def import_links(rows: DataFrame, existing: DataFrame, prefixes: list[str], deeplink_prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(line, path, name, utm_campaign, utm_medium, utm_source, link) of a CSV to the links to make and the lines left out
    with a reason. Prefixes are taken off a path wherever they stand; the deep link's prefix gives way to the scheme
    made of it (``https://app.example/`` to ``app.example://``). Null cells are empty."""
    cells = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("path", "name", "utm_campaign", "utm_medium", "utm_source", "link")}
    for prefix in prefixes:
        cells["path"] = F.replace(cells["path"], F.lit(prefix), F.lit(""))
    cells["path"] = F.trim(cells["path"])
    if deeplink_prefix:
        scheme = re.sub(r"/\Z", "", re.sub(r"\Ahttps?://", "", deeplink_prefix)) + "://"
        cells["link"] = F.replace(cells["link"], F.lit(deeplink_prefix), F.lit(scheme))
    cleaned = rows.withColumns(cells)
    blank = cleaned.filter(F.coalesce(F.col("path"), F.lit("")) == "").select("line", F.lit("blank path").alias("reason"))
    named = cleaned.filter(F.coalesce(F.col("path"), F.lit("")) != "")
    ranked = named.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy("line"))).join(existing.select("path", F.lit(True).alias("_old")), "path", "left")
    good = ranked.filter("_k = 1 and _old is null").drop("_k", "_old")
    again = ranked.filter("_k > 1 or _old").select("line", F.lit("duplicate").alias("reason"))
    return good, blank.union(again)


#: Severity numbers, and what levels of JSON lines mean; other levels are INFO (fixed values).
SEVERITIES = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}
LEVELS = {
    "FATAL": "FATAL",
    "CRITICAL": "FATAL",
    "ERROR": "ERROR",
    "ERR": "ERROR",
    "WARN": "WARN",
    "WARNING": "WARN",
    "INFO": "INFO",
    "DEBUG": "DEBUG",
    "TRACE": "TRACE",
}
#: Keys of a request's JSON by the attribute that they become (fixed values).
REQUEST_KEYS = {
    "http_method": ("http_method", "method"),
    "http_path": ("path",),
    "controller": ("controller",),
    "action": ("action",),
    "http_status": ("status",),
    "duration_ms": ("duration",),
    "client_ip": ("request_ip", "ip"),
    "error_class": ("error_class",),
    "error_message": ("error_message",),
}


def _found(text, pattern: str, group: int = 1):
    """What a pattern's group matches; null where it does not."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def classify_logs(lines: DataFrame) -> DataFrame:
    """Log lines to records: body, log_type, severity and its number, trace context, message and request attributes.
    A line is JSON with a level, a framework's line (whose message may hold a request as JSON, whose status then sets the
    severity, unless the message names an error), or plain text, which is INFO. A null line is invalid."""
    line = F.regexp_replace("line", r"\s+$", "")
    level = _found(line, r'"level"\s*:\s*"([^"]+)"')
    json_severity = F.coalesce(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[F.upper(level)], F.lit("INFO"))
    json_message = F.replace(_found(line, r'(?s)"message"\s*:\s*"(.*?)"[,}]'), F.lit('\\"'), F.lit('"'))

    form = r"(?s)^([IWEF]), \[([^\]]+) #(\d+)\]\s+(\w+)\s+--\s+:\s+(.*)$"
    letter, word, text = (_found(line, form, k) for k in (1, 4, 5))
    own = F.when((letter == "F") | (word == "FATAL"), "FATAL").when((letter == "E") | (word == "ERROR"), "ERROR").when((letter == "W") | (word == "WARN"), "WARN").when((letter == "I") | (word == "INFO"), "INFO").otherwise("DEBUG")

    is_json, is_text = level.isNotNull(), level.isNull() & text.isNotNull()
    inner = F.when(is_json, _found(json_message, r"(?s)^(\{.*\})$")).when(is_text, _found(text, r"(?s)(\{.+\})"))
    inner = F.when(F.get_json_object(inner, "$").isNotNull(), inner)
    made = lines.withColumns({"_json": is_json, "_text": is_text, "_inner": inner, "_own": F.when(is_text, own), "_message": F.when(is_json, json_message).when(is_text, text)})
    made = made.withColumns({k: F.coalesce(*[F.get_json_object("_inner", f"$.{x}") for x in names]) for k, names in REQUEST_KEYS.items()})
    # Only JSON lines' requests have error attributes; other lines name them in their text.
    named = F.when(F.col("_text"), _found(F.col("_message"), r"(\w+Error)"))
    status = F.col("http_status").cast("int")
    by_status = F.when(status >= 500, "ERROR").when(status >= 400, "WARN").when(status.isNotNull(), "INFO")
    error, fatal = F.col("_message").rlike("ERROR|\U0001F4A5"), F.col("_message").rlike("FATAL|\U0001F525")
    severity = F.when(F.col("_json"), json_severity).when(F.col("_text") & error, "ERROR").when(F.col("_text") & fatal, "FATAL").when(F.col("_text"), F.coalesce(by_status, "_own")).otherwise("INFO")
    made = made.withColumns({
        "error_class": F.when(F.col("_json"), F.col("error_class")).otherwise(named),
        "error_message": F.when(F.col("_json"), F.col("error_message")).when(F.col("_text"), _found(F.col("_message"), r"RuntimeError \(([^)]+)\)")),
        "error_type": F.when(F.col("_text") & error, "application_error").when(F.col("_text") & fatal, "fatal_error"),
        "severity": severity,
        "log_type": F.when(F.col("line").isNull(), F.lit(None)).when(F.col("_json"), "json_structured").when(F.col("_text") & F.col("_inner").isNotNull(), "rails_structured").when(F.col("_text"), "rails").when(line.rlike(r"^[A-Za-z0-9]+$"), "test_message").otherwise("application"),
        "trace_id": _found(line, r'"trace_id"\s*:\s*"([a-f0-9]+)"'),
        "span_id": _found(line, r'"span_id"\s*:\s*"([a-f0-9]+)"'),
        "trace_flags": _found(line, r'"trace_flags"\s*:\s*(\d+)').cast("int"),
        "body": F.when(F.col("line").isNull(), "invalid log").when(F.col("_text"), F.coalesce("_inner", line)).otherwise(line),
        "message": F.col("_message"),
    })
    number = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])[F.col("severity")]
    return made.withColumn("severity_number", number).drop("_json", "_text", "_inner", "_own", "_message")


def without_tenant(table: DataFrame, projects: DataFrame, key: str = "project_id") -> DataFrame:
    """A table without the rows of a tenant's projects."""
    return table.join(projects.select(F.col("project_id").alias("_p")), F.col(key) == F.col("_p"), "left_anti")

"""Scalar expressions of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schemas import EVENT_METRICS, MOBILE


def metric_platform(platform: Column) -> Column:
    """ios and android as they are, all else (null too) as web."""
    return F.when(platform.isin(*MOBILE), platform).otherwise("web")


def metric_name(event: Column) -> Column:
    """The metric of an event type; null for types without one."""
    out = None
    for name, metric in EVENT_METRICS.items():
        out = (F if out is None else out).when(event == name, F.lit(metric))
    return out


def metric_value(event: Column, engagement: Column) -> Column:
    """What an event adds to its metric."""
    return F.when(event == "time_spent", F.coalesce(engagement.cast("long"), F.lit(0))).otherwise(F.lit(1)).cast("long")


def like_term(term: str) -> str:
    """A LIKE pattern that finds ``term`` anywhere, its wildcards taken literally."""
    for c in ("\\", "%", "_"):
        term = term.replace(c, "\\" + c)
    return f"%{term}%"


def ilike_any(columns: list[str], term: str, escape: bool = True) -> Column:
    """Whether any of the columns holds the term, whatever the case; nulls hold nothing."""
    pattern = like_term(term) if escape else f"%{term}%"
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return out


def ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b as a double, 0.0 where b is 0 or null."""
    out = F.when(F.coalesce(b, F.lit(0)) != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))
    return F.round(out, digits) if digits is not None else out


def validated(store: Column, webhook: Column) -> Column:
    """A purchase that counts: confirmed by the store's webhook, or not from a store. Null flags count for neither."""
    return F.coalesce((webhook == F.lit(True)) | (store == F.lit(False)), F.lit(False))


def is_buy(event_type: Column) -> Column:
    return event_type.isin("buy", "refund_reversed")


def is_cancellation(event_type: Column, purchase_type: Column) -> Column:
    """A cancel, or a refund of anything but a subscription (a null type is none)."""
    return (event_type == "cancel") | ((event_type == "refund") & ~purchase_type.eqNullSafe("subscription"))


def revenue_delta(event_type: Column, purchase_type: Column, cents: Column, quantity: Column) -> Column:
    """Signed cents: bought is added, refunds and cancels of non-subscriptions are taken; null where nothing changes."""
    amount = (cents * quantity).cast("long")
    return (
        F.when(cents == 0, F.lit(None).cast("long"))
        .when(is_buy(event_type), amount)
        .when(event_type == "refund", -amount)
        .when((event_type == "cancel") & ~purchase_type.eqNullSafe("subscription"), -amount)
    )


def purchase_platform(store_source: Column, device_platform: Column) -> Column:
    return F.when(store_source == "apple", "ios").when(store_source == "google", "android").otherwise(metric_platform(device_platform))


def to_usd_cents(cents: Column, currency: Column, rate: Column) -> Column:
    """USD as it is, else cents / rate rounded half up; null for an unknown currency."""
    return F.when(F.upper(currency) == "USD", cents.cast("long")).otherwise(F.round(cents / rate).cast("long"))


def original_transaction(order_id: Column) -> Column:
    """An order id without its renewal suffix."""
    return F.regexp_replace(order_id, r"\.\d+$", "")


def milliunits_to_cents(x: Column) -> Column:
    return F.floor(x / 10).cast("long")


def micros_to_cents(x: Column) -> Column:
    return F.floor(x / 10_000).cast("long")


def strip_query(url: Column) -> Column:
    """scheme://[user@]host[:port]path; what is no such URL stays."""
    found = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+[^?#\s]*)(?:[?#]\S*)?$", 1)
    return F.when(found != "", found).otherwise(url)


def url_host(url: Column) -> Column:
    """Host without user and port, lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", host)


def registrable_domain(host: Column) -> Column:
    """The last two labels."""
    return F.when(F.size(F.split(host, r"\.")) >= 2, F.substring_index(host, ".", -2))


def subdomain(host: Column) -> Column:
    """All labels but the last two; empty if there are none."""
    return F.when(F.size(F.split(host, r"\.")) >= 2, F.regexp_replace(host, r"\.?[^.]+\.[^.]+$", ""))


def url_path(url: Column) -> Column:
    """The path without its leading slash."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)


#: Patterns of user agents that fetch link previews (fixed values).
PREVIEW_AGENTS = [
    "facebookexternalhit",
    "facebot",
    "twitterbot",
    "linkedinbot",
    "whatsapp",
    "slackbot",
    "slack-imgproxy",
    "telegrambot",
    "discordbot",
    "skypeuripreview",
    "viber",
    "pinterest",
    "redditbot",
    "quora link preview",
    "macoutlook",
    "cfnetwork",
    "teams",
    "msteams",
    "microsoft.*(office|preview)",
    "google-structured-data-testing-tool",
    "google-inspectiontool",
    "embedly",
    "nuzzel",
    "iframely",
    "ogpreview",
    "glimpsebot",
    "vkshare",
    "outbrain",
    "thunderbird",
    "easymail",
    "superhuman",
    "bingpreview",
    "preview",
]


def is_preview(user_agent: Column) -> Column:
    """Whether a user agent fetches previews; null and blank do not."""
    return F.coalesce(F.lower(user_agent).rlike("|".join(PREVIEW_AGENTS)), F.lit(False))


def counts_as_view(user_agent: Column, fallback: Column, redirect: Column) -> Column:
    """A shown link is a view unless a preview fetched it, or a fallback or redirect was asked for."""
    return ~is_preview(user_agent) & ~F.coalesce(fallback, F.lit(False)) & ~F.coalesce(redirect, F.lit(False))


def append_utm(url: Column, **values: Column) -> Column:
    """The URL with the parameters that are present."""
    parts = F.concat_ws("&", *[F.when(F.coalesce(F.trim(v), F.lit("")) != "", F.concat(F.lit(f"utm_{k}="), F.url_encode(v))) for k, v in values.items()])
    return F.when(parts == "", url).otherwise(F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), parts))


def or_default(column: Column, *others: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in (column, *others)])


def _half(total: Column) -> Column:
    """Half of a whole number of cents, halves away from zero."""
    up = F.abs(total) + 1
    return F.sign(total).cast("long") * ((up - up % 2) / 2).cast("long")


def _cents(x: Column) -> Column:
    return F.round(x * 100).cast("long")


def halving_fold(values: Column) -> Column:
    """acc := round((acc + round(x, 2)) / 2, 2) from 0.0, in the array's order. It runs on whole cents, in which a
    half is a half."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: _half(a + _cents(x)), lambda a: a / F.lit(100.0))


def running_mean_fold(values: Column) -> Column:
    """acc := x where acc is 0, else round((acc + x) / 2, 2), in the array's order, on whole cents."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: F.when(a == 0, _cents(x)).otherwise(_half(a + _cents(x))), lambda a: a / F.lit(100.0))

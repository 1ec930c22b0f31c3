"""What the dashboards ask: projects, links, campaigns, visitors, usage."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expr import halving_fold, ilike_any, ratio, running_mean_fold
from millrace.operators.revenue import countable
from millrace.schemas import EVENTS, FREE_MAU, METRICS


def days(start: str, end: str) -> Column:
    """Whether event_date is in a closed range."""
    return F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def moments(start: str, end: str, column: str = "created_at") -> Column:
    """Whether a time is on the days of a closed range."""
    return (F.col(column) >= F.lit(start).cast("timestamp_ntz")) & (F.col(column) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))


def on_platforms(platforms: str | list[str] | None) -> Column:
    """A platform, several, or (None) all."""
    if platforms is None:
        return F.lit(True)
    return F.col("platform").isin([platforms] if isinstance(platforms, str) else platforms)


def calendar(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each date of a closed range."""
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("event_date"))


def zero_filled(series: DataFrame, start: str, end: str, values: list[str]) -> DataFrame:
    """A daily series with a row for every date, 0 where there was none."""
    return calendar(series, start, end).join(series, "event_date", "left").select("event_date", *[F.coalesce(v, F.lit(0)).cast("long").alias(v) for v in values])


def previous(start: str, end: str) -> tuple[str, str]:
    """The range of equal length before."""
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    return str(a - (b - a) - timedelta(1)), str(a - timedelta(1))


@dataclass
class Page:
    """A page of results and how many there are in all."""

    rows: DataFrame
    total: int
    page: int
    per_page: int

    @property
    def pages(self) -> int:
        return -(-self.total // self.per_page)


def page_of(df: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """One page of an ordered DataFrame; the order must have a unique last key."""
    return df.offset((max(1, page) - 1) * per_page).limit(per_page)


def paginate(df: DataFrame, page: int = 1, per_page: int = 20) -> Page:
    return Page(page_of(df, page, per_page), df.count(), max(1, page), per_page)


def ordered(df: DataFrame, allowed: list[str], sort_by: str | None, ascending: bool, fallback: list[Column], tie: str) -> DataFrame:
    """Sorted by an allowed column, nulls first when descending and last when ascending, else by the fallback."""
    if sort_by in allowed:
        first = F.col(sort_by).asc_nulls_last() if ascending else F.col(sort_by).desc_nulls_first()
        return df.orderBy(first, tie)
    return df.orderBy(*fallback, tie)


# Projects ---------------------------------------------------------------------------------------------------------------

SUMMED = ["views", "link_views", "opens", "installs", "reinstalls", "app_opens", "organic_users", "new_users", "first_time_visitors", "referred_users", "revenue", "units_sold", "cancellations", "first_time_purchases"]


def _payers(purchases: DataFrame, devices: DataFrame, project: int, start: str, end: str, platforms=None) -> DataFrame:
    own = countable(purchases).filter((F.col("project_id") == project) & F.col("event_type").isin("buy", "refund_reversed") & F.col("device_id").isNotNull() & moments(start, end, "date"))
    if platforms is not None:
        own = own.join(devices.filter(on_platforms(platforms)).select("device_id"), "device_id", "left_semi")
    return own


def paying_users(purchases: DataFrame, devices: DataFrame, project: int, start: str, end: str, platforms=None) -> DataFrame:
    """Devices that bought in a range, by the device's own platform if one is asked for."""
    return _payers(purchases, devices, project, start, end, platforms).agg(F.count_distinct("device_id").alias("paying_users"))


def dashboard(dpm: DataFrame, vds: DataFrame, purchases: DataFrame, devices: DataFrame, project: int, start: str, end: str, platforms=None) -> DataFrame:
    """The current range and the one before, a row each. Both are read in one pass over each table."""
    before, _ = previous(start, end)
    period = F.when(F.col("event_date") >= F.lit(start).cast("date"), "current").otherwise("previous").alias("period")
    own = (F.col("project_id") == project) & days(before, end) & on_platforms(platforms)
    sums = dpm.filter(own).groupBy(period).agg(*[F.sum(c).cast("long").alias(c) for c in SUMMED])
    people = vds.filter(own).groupBy(period).agg(F.count_distinct("visitor_id").alias("visitors"))
    payers = _payers(purchases, devices, project, before, end, platforms).withColumn("event_date", F.to_date("date")).groupBy(period).agg(F.count_distinct("device_id").alias("paying_users"))
    rows = dpm.sparkSession.range(1).select(F.explode(F.array(F.lit("current"), F.lit("previous"))).alias("period"))
    for part in (sums, people, payers):
        rows = rows.join(part, "period", "left")
    rows = rows.na.fill(0)
    returning = F.greatest(F.col("visitors") - F.col("first_time_visitors"), F.lit(0).cast("long"))
    return rows.withColumns({"returning_users": returning, "link_driven_installs": F.col("installs") - F.col("organic_users")}).withColumns({
        "returning_rate": ratio(F.col("returning_users"), F.col("visitors")),
        "arpu": ratio(F.col("revenue"), F.col("visitors"), 2),
        "arppu": ratio(F.col("revenue"), F.col("paying_users"), 2),
    })


def first_time_in_range(vds: DataFrame, project: int, start: str, end: str, platforms=None) -> DataFrame:
    """Visitors of a range who had no day before it on any platform."""
    own = vds.filter(F.col("project_id") == project)
    before = own.filter(F.col("event_date") < F.lit(start).cast("date")).select("visitor_id")
    return own.filter(days(start, end) & on_platforms(platforms)).join(before, "visitor_id", "left_anti").agg(F.count_distinct("visitor_id").alias("first_time"))


def returning_in_range(vds: DataFrame, project: int, start: str, end: str) -> DataFrame:
    """Visitors of a range with a day before it on the same platform."""
    own = vds.filter(F.col("project_id") == project)
    before = own.filter(F.col("event_date") < F.lit(start).cast("date")).select("visitor_id", "platform")
    return own.filter(days(start, end)).join(before, ["visitor_id", "platform"], "left_semi").agg(F.count_distinct("visitor_id").alias("returning"))


def dau_in_range(dau: DataFrame, project: int, start: str, end: str, platforms=None) -> DataFrame:
    return dau.filter((F.col("project_id") == project) & days(start, end) & on_platforms(platforms)).agg(F.coalesce(F.sum("active_users"), F.lit(0)).cast("long").alias("active_users"))


def link_views(dpm: DataFrame, project: int, start: str, end: str, platforms=None) -> DataFrame:
    own = dpm.filter((F.col("project_id") == project) & days(start, end) & on_platforms(platforms)).groupBy("event_date").agg(F.sum("link_views").alias("link_views"))
    return zero_filled(own, start, end, ["link_views"])


# Links and campaigns --------------------------------------------------------------------------------------------------


def top_links(lds: DataFrame, links: DataFrame, project: int, start: str, end: str, platforms=None, limit: int = 10) -> DataFrame:
    """The links with most installs that no SDK made; attributes are joined to the winners only."""
    shown = ["views", "opens", "installs", "reinstalls", "reactivations", "time_spent"]
    own = links.filter((F.col("project_id") == project) & ~F.col("sdk_generated"))
    made = lds.filter((F.col("project_id") == project) & days(start, end) & on_platforms(platforms)).join(own.select("link_id"), "link_id", "left_semi")
    best = made.groupBy("link_id").agg(*[F.sum(c).alias(c) for c in shown]).orderBy(F.desc("installs"), "link_id").limit(limit)
    return best.join(own.select("link_id", "name", "path"), "link_id")


def _with_sums(left: DataFrame, lds: DataFrame, keys: list[str], start: str, end: str, platforms) -> DataFrame:
    """Sums of the links in ``left`` alone: the semi join goes below the rollup's aggregation."""
    own = lds.filter(days(start, end) & on_platforms(platforms)).join(left.select("link_id"), "link_id", "left_semi")
    stats = own.groupBy("link_id").agg(*[F.sum(m).alias(m) for m in METRICS])
    return left.join(stats, "link_id", "left").groupBy(*keys).agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in METRICS])


def link_statistics(links: DataFrame, lds: DataFrame, project: int, start: str, end: str, platforms=None, active: bool | None = True, sdk: bool | None = None, campaign: int | None = None, link: int | None = None, term: str | None = None, sort_by: str | None = None, ascending: bool = False) -> DataFrame:
    """Every matching link with its sums; links without any have zeros."""
    own = links.filter(F.col("project_id") == project)
    for column, value in (("active", active), ("sdk_generated", sdk), ("campaign_id", campaign), ("link_id", link)):
        if value is not None:
            own = own.filter(F.col(column) == value)
    if term:
        from millrace.functions.expr import like_term

        own = own.filter(ilike_any(["name", "title", "path"], term) | F.exists("tags", lambda t: t.ilike(like_term(term))))
    made = _with_sums(own, lds, ["link_id", "name", "campaign_id"], start, end, platforms)
    return ordered(made, [*METRICS, "name"], sort_by, ascending, [F.desc("link_id")], "link_id")


def campaign_statistics(campaigns: DataFrame, links: DataFrame, lds: DataFrame, project: int, start: str, end: str, platforms=None, term: str | None = None, archived: bool | None = None, sort_by: str | None = None, ascending: bool = False) -> DataFrame:
    """Every campaign with the sums of all its links, inactive and SDK-made ones too."""
    own = campaigns.filter(F.col("project_id") == project)
    if term:
        own = own.filter(ilike_any(["name"], term))
    if archived is not None:
        own = own.filter(F.col("archived") == archived)
    theirs = own.join(links.select("link_id", F.col("campaign_id").alias("_campaign")), F.col("campaign_id") == F.col("_campaign"), "left")
    made = _with_sums(theirs, lds, ["campaign_id", "name", "archived"], start, end, platforms)
    return ordered(made, [*METRICS, "name"], sort_by, ascending, [F.desc("campaign_id")], "campaign_id")


def event_metrics_by_link(events: DataFrame, start: str, end: str) -> DataFrame:
    """For every link the count of each event type, and a running mean of engagement per device over the types by name."""
    own = events.filter(F.col("link_id").isNotNull() & moments(start, end))
    by_type = own.groupBy("link_id", "event").agg(F.count("*").alias("n"), F.sum("engagement_time").alias("spent"), F.count_distinct("device_id").alias("people"))
    mean = F.round(F.coalesce(F.col("spent"), F.lit(0)).cast("double") / F.col("people"), 2)
    folded = by_type.groupBy("link_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("event") == e, F.col("n"))), F.lit(0)).cast("long").alias(e) for e in EVENTS[:7]],
        F.array_sort(F.collect_list(F.struct("event", mean.alias("mean")))).alias("_means"),
    )
    return folded.withColumn("avg_engagement_time", running_mean_fold(F.transform("_means", lambda x: x["mean"]))).drop("_means")


def links_by_event(links: DataFrame, events: DataFrame, project: int, event: str, start: str, end: str, ascending: bool = False) -> DataFrame:
    """Links by the count of one event type, with their metrics (null without events)."""
    own = links.filter(F.col("project_id") == project).select("link_id", "name")
    events = events.join(own.select("link_id"), "link_id", "left_semi")
    counts = events.filter((F.col("event") == event) & moments(start, end)).groupBy("link_id").agg(F.count("*").alias("_n"))
    joined = own.join(counts, "link_id", "left").withColumn("sort_count", F.coalesce("_n", F.lit(0))).drop("_n").join(event_metrics_by_link(events, start, end), "link_id", "left")
    return joined.orderBy(F.col("sort_count").asc() if ascending else F.col("sort_count").desc(), "link_id")


def campaigns_by_event(campaigns: DataFrame, links: DataFrame, events: DataFrame, project: int, event: str, start: str, end: str) -> DataFrame:
    """Campaigns by the count of one event type over links that no SDK made; metrics, means too, are summed over links."""
    theirs = campaigns.filter(F.col("project_id") == project).select("campaign_id")
    own = links.filter(~F.col("sdk_generated") & F.col("campaign_id").isNotNull()).select("link_id", "campaign_id").join(theirs, "campaign_id", "left_semi")
    metrics = own.join(event_metrics_by_link(events.join(own.select("link_id"), "link_id", "left_semi"), start, end), "link_id")
    sums = metrics.groupBy("campaign_id").agg(*[F.sum(c).alias(c) for c in EVENTS[:7]], F.round(F.sum("avg_engagement_time"), 2).alias("avg_engagement_time"))
    joined = campaigns.filter(F.col("project_id") == project).select("campaign_id", "name").join(sums, "campaign_id", "left")
    return joined.orderBy(F.coalesce(event, F.lit(0)).desc(), "campaign_id")


def events_overview(events: DataFrame, links: DataFrame, project: int, start: str, end: str, period: str = "day", active: bool | None = None, sdk: bool | None = None, ads: str | None = None, campaigns: list[int] | None = None) -> DataFrame:
    """Event counts by day or month, and the halving mean of engagement over the types by name. A filter on
    links drops events without one."""
    own = events.filter((F.col("project_id") == project) & moments(start, end))
    wanted = [(c, v) for c, v in (("active", active), ("sdk_generated", sdk), ("ads_platform", ads)) if v is not None]
    if wanted or campaigns:
        kept = links
        for c, v in wanted:
            kept = kept.filter(F.col(c) == v)
        if campaigns:
            kept = kept.filter(F.col("campaign_id").isin(campaigns))
        own = own.join(kept.select("link_id"), "link_id", "left_semi")
    bucket = F.to_date(F.date_trunc(period, "created_at"))
    by_type = own.groupBy(bucket.alias("event_date"), "event").agg(F.count("*").alias("n"), F.avg("engagement_time").alias("mean"))
    made = by_type.groupBy("event_date").agg(
        *[F.coalesce(F.sum(F.when(F.col("event") == e, F.col("n"))), F.lit(0)).cast("long").alias(e) for e in EVENTS[:7]],
        F.array_sort(F.collect_list(F.struct("event", F.coalesce("mean", F.lit(0.0)).alias("mean")))).alias("_means"),
    )
    return made.withColumn("avg_engagement_time", halving_fold(F.transform("_means", lambda x: x["mean"]))).drop("_means")


def fill_gaps(overview: DataFrame, start: str, end: str, today: str, period: str = "day") -> DataFrame:
    """An overview with a row for every day or month up to today, zeros where there was none."""
    last = F.least(F.lit(end).cast("date"), F.lit(today).cast("date"))
    step = F.expr("interval 1 day") if period == "day" else F.expr("interval 1 month")
    first = F.to_date(F.date_trunc(period, F.lit(start).cast("timestamp")))
    wanted = overview.sparkSession.range(1).select(F.explode(F.sequence(first, last, step)).alias("event_date"))
    columns = [c for c in overview.columns if c != "event_date"]
    filled = wanted.join(overview, "event_date", "left").select("event_date", *[F.coalesce(c, F.lit(0)).cast(dict(overview.dtypes)[c]).alias(c) for c in columns])
    return filled.withColumn("key", F.concat(F.date_format("event_date", "yyyy-MM-dd"), F.lit(" 00:00:00 UTC")))


def metric_values(enriched: DataFrame, project: int) -> DataFrame:
    """The distinct platforms and versions that a project's events have."""
    own = enriched.filter(F.col("project_id") == project)
    return own.select(F.explode(F.create_map(F.lit("platform"), F.col("platform"), F.lit("app_version"), F.col("app_version"))).alias("name", "value")).filter("value is not null").distinct()


def link_search(links: DataFrame, project: int, active: bool | None = None, sdk: bool | None = None, ads: str | None = None, campaign: int | None = None, term: str | None = None, sort_by: str | None = None, ascending: bool = True) -> DataFrame:
    """Links by attributes and a term, whose wildcards work."""
    own = links.filter(F.col("project_id") == project)
    for column, value in (("active", active), ("sdk_generated", sdk), ("ads_platform", ads), ("campaign_id", campaign)):
        if value is not None:
            own = own.filter(F.col(column) == value)
    if term:
        own = own.filter(ilike_any(["name", "title", "path"], term, escape=False))
    return ordered(own, ["name", "title", "path", "campaign_id"], sort_by, ascending, [F.desc("link_id")], "link_id")


def campaign_search(campaigns: DataFrame, project: int, archived: bool | None = None, term: str | None = None) -> DataFrame:
    own = campaigns.filter(F.col("project_id") == project)
    if archived is not None:
        own = own.filter(F.col("archived") == archived)
    if term:
        own = own.filter(ilike_any(["name"], term, escape=False))
    return own.orderBy(F.desc("campaign_id"))


def link_export(links: DataFrame, lds: DataFrame, campaigns: DataFrame, project: int, start: str, end: str, active: bool = True, sdk: bool = False) -> DataFrame:
    """A project's links as rows of a CSV file; ``data``, a map, as "k=v" joined by commas in the order of its keys."""
    own = links.filter((F.col("project_id") == project) & (F.col("active") == active) & (F.col("sdk_generated") == sdk))
    named = own.join(campaigns.select(F.col("campaign_id").alias("_c"), F.col("name").alias("campaign")), F.col("campaign_id") == F.col("_c"), "left")
    pairs = F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    shown = named.withColumns({"tag_list": F.array_join("tags", ", "), "data_list": F.coalesce(F.array_join(pairs, ", "), F.lit(""))})
    columns = ["link_id", "name", "title", "subtitle", "updated_at", "generated_from_platform", "sdk_generated", "active", "path", "campaign", "ads_platform", "tag_list", "data_list"]
    return _with_sums(shown, lds, columns, start, end, None).withColumn("avg_engagement_time", F.lit(0.0))


def campaigns_with_links(campaigns: DataFrame, links: DataFrame) -> DataFrame:
    """Whether a campaign has links: active ones, or if it is archived any."""
    owned = links.filter("campaign_id is not null").groupBy("campaign_id").agg(F.count("*").alias("_all"), F.count(F.when(F.col("active"), 1)).alias("_active"))
    joined = campaigns.join(owned, "campaign_id", "left")
    return joined.select("campaign_id", F.coalesce(F.when(F.col("archived"), F.col("_all")).otherwise(F.col("_active")) > 0, F.lit(False)).alias("has_links"))


# Visitors ---------------------------------------------------------------------------------------------------------------


def visitor_statistics(visitors: DataFrame, vds: DataFrame, devices: DataFrame, project: int, start: str, end: str, visitor: int | None = None, term: str | None = None, platform: str | None = None, sort_by: str | None = None, ascending: bool = False) -> DataFrame:
    """A project's visitors with their sums in a range."""
    people = visitors.filter(F.col("project_id") == project).join(devices.select("device_id", F.col("platform").alias("device_platform")), "device_id")
    if visitor is not None:
        people = people.filter(F.col("visitor_id") == visitor)
    if term:
        people = people.filter(ilike_any(["sdk_identifier"], term, escape=False))
    if platform:
        people = people.filter(F.lower("device_platform") == platform.lower())
    sums = vds.filter((F.col("project_id") == project) & days(start, end)).groupBy("visitor_id").agg(*[F.sum(m).alias(f"total_{m}") for m in METRICS])
    made = people.join(sums, "visitor_id").select("visitor_id", "sdk_identifier", "device_platform", *[f"total_{m}" for m in METRICS])
    return ordered(made, [f"total_{m}" for m in METRICS], sort_by, ascending, [F.desc("visitor_id")], "visitor_id")


def referral_statistics(visitors: DataFrame, vds: DataFrame, devices: DataFrame, project: int, start: str, end: str) -> DataFrame:
    """What the visitors that each one invited did in a range."""
    inviters = visitors.filter(F.col("project_id") == project).select(F.col("visitor_id").alias("invited_by_id"))
    invited = vds.filter(F.col("invited_by_id").isNotNull() & days(start, end)).join(inviters, "invited_by_id", "left_semi")
    sums = invited.groupBy("invited_by_id").agg(*[F.sum(m).alias(f"invited_{m}") for m in METRICS])
    people = visitors.filter(F.col("project_id") == project).join(devices.select("device_id", F.col("platform").alias("device_platform")), "device_id", "left")
    return people.join(sums, people.visitor_id == sums.invited_by_id).select("visitor_id", "device_platform", *[f"invited_{m}" for m in METRICS]).orderBy(F.desc("invited_views"), "visitor_id")


def _type_counts(prefix: str = "") -> list[Column]:
    out = []
    for e in EVENTS:
        out.append(F.count(F.when(F.col("event") == e, 1)).alias(f"{e}_count"))
        out.append(F.coalesce(F.sum(F.when(F.col("event") == e, F.col("engagement_time"))), F.lit(0)).cast("long").alias(f"{e}_engagement_time"))
    return out


def own_event_counts(visitors: DataFrame, devices: DataFrame, events: DataFrame, project: int) -> DataFrame:
    """Counts and engagement of every event type for every visitor, zeros without events."""
    people = visitors.filter(F.col("project_id") == project).join(devices.select("device_id", "platform"), "device_id", "left")
    joined = people.join(events.select("project_id", "device_id", "event", "engagement_time"), ["project_id", "device_id"], "left")
    return joined.groupBy("visitor_id", "platform").agg(*_type_counts())


def referral_event_counts(visitors: DataFrame, links: DataFrame, events: DataFrame, project: int) -> DataFrame:
    """The same over events on links that the visitor made."""
    people = visitors.filter(F.col("project_id") == project).select("visitor_id")
    made = people.join(links.select("link_id", "visitor_id"), "visitor_id", "left")
    own = events.filter(F.col("project_id") == project).select("link_id", "event", "engagement_time")
    return made.join(own, "link_id", "left").groupBy("visitor_id").agg(*_type_counts())


def visitor_details(visitors: DataFrame, vds: DataFrame, devices: DataFrame, links: DataFrame, project: int, start: str, end: str) -> DataFrame:
    """Own sums, invited sums and the number of links made, of every visitor."""
    own = visitor_statistics(visitors, vds, devices, project, start, end).select("visitor_id", "total_views", "total_installs", "total_revenue")
    theirs = referral_statistics(visitors, vds, devices, project, start, end).select("visitor_id", "invited_views", "invited_installs")
    made = links.filter((F.col("project_id") == project) & F.col("visitor_id").isNotNull()).groupBy("visitor_id").agg(F.count("*").alias("links"))
    joined = own.join(theirs, "visitor_id", "left").join(made, "visitor_id", "left")
    return joined.na.fill(0, ["invited_views", "invited_installs", "links"])


def last_seen(events: DataFrame) -> DataFrame:
    """The latest event of every (project, device)."""
    return events.groupBy("project_id", "device_id").agg(F.max_by(F.struct("event_id", "event", "created_at"), F.struct("created_at", "event_id")).alias("e")).select("project_id", "device_id", "e.*")


def invited_visitors(visitors: DataFrame) -> DataFrame:
    """Whom each visitor invited."""
    return visitors.filter("inviter_id is not null").groupBy(F.col("inviter_id").alias("visitor_id")).agg(F.count("*").alias("invited"), F.array_join(F.transform(F.array_sort(F.collect_list("visitor_id")), lambda x: x.cast("string")), ",").alias("invited_ids"))


# Usage ------------------------------------------------------------------------------------------------------------------


def billing_series(dau: DataFrame, projects: list[int], start: str, end: str) -> DataFrame:
    own = dau.filter(F.col("project_id").isin(projects) & days(start, end)).groupBy("event_date").agg(F.sum("active_users").alias("active_users"))
    return zero_filled(own, start, end, ["active_users"])


def active_users_daily(vds: DataFrame, projects: list[int], start: str, end: str) -> DataFrame:
    own = vds.filter(F.col("project_id").isin(projects) & days(start, end)).groupBy("event_date").agg(F.count_distinct("visitor_id").alias("active_users"))
    return zero_filled(own, start, end, ["active_users"])


def active_users_monthly(vds: DataFrame, projects: list[int], start: str, end: str) -> DataFrame:
    """Distinct visitors of each month, of which only the days in the range count."""
    if start > end:
        raise ValueError("the range ends before it starts")
    month = F.trunc("event_date", "MM")
    own = vds.filter(F.col("project_id").isin(projects) & days(start, end)).groupBy(month.alias("month")).agg(F.count_distinct("visitor_id").alias("active_users"))
    wanted = vds.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("month"))
    return wanted.join(own, "month", "left").select("month", F.coalesce("active_users", F.lit(0)).cast("long").alias("active_users"))


def active_users_total(vds: DataFrame, projects: list[int], start: str, end: str) -> DataFrame:
    return active_users_monthly(vds, projects, start, end).agg(F.coalesce(F.sum("active_users"), F.lit(0)).cast("long").alias("active_users"))


def mau(vds: DataFrame, projects: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct visitors of each instance over its projects (instance_id, project_id), 0 for one without."""
    own = vds.filter(days(start, end)).join(projects, "project_id").groupBy("instance_id").agg(F.count_distinct("visitor_id").alias("mau"))
    return projects.select("instance_id").distinct().join(own, "instance_id", "left").withColumn("mau", F.coalesce("mau", F.lit(0)))


def mau_total(vds: DataFrame, projects: DataFrame, start: str, end: str) -> DataFrame:
    """Sums of each calendar month's distinct visitors."""
    own = vds.filter(days(start, end)).join(projects, "project_id").groupBy("instance_id", F.trunc("event_date", "MM").alias("month")).agg(F.count_distinct("visitor_id").alias("n"))
    total = own.groupBy("instance_id").agg(F.sum("n").alias("mau_total"))
    return projects.select("instance_id").distinct().join(total, "instance_id", "left").withColumn("mau_total", F.coalesce("mau_total", F.lit(0)))


def quota_status(usage: DataFrame, limit: int = FREE_MAU, warn_percent: int = 85) -> DataFrame:
    """From (instance_id, mau, enterprise): exceeded if above the limit, the share used, whether to warn, what is paid."""
    percent = F.round(F.col("mau") * 100 / F.lit(limit)).cast("long")
    free = ~F.coalesce("enterprise", F.lit(False))
    return usage.withColumns({
        "usage_percent": percent,
        "exceeded": free & (F.col("mau") > limit),
        "warn": free & (percent >= warn_percent) & (F.col("mau") <= limit),
        "paid_maus": F.greatest(F.col("mau") - limit, F.lit(0).cast("long")),
    })


def cache_report(hits: DataFrame) -> DataFrame:
    """(model, hits, misses): rates by model and for all."""
    made = hits.rollup("model").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    return made.select(F.coalesce("model", F.lit("TOTAL")).alias("model"), "hits", "misses", ratio(F.col("hits") * 100, F.col("hits") + F.col("misses"), 2).alias("rate"))

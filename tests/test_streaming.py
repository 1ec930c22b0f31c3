"""The event stream against the batch operators, and batches that run twice."""

import json

from pyspark.sql import functions as F

from millrace.operators import ingest, rollups
from millrace.schemas import METRICS
from millrace.sources.adapter import tables
from millrace.streaming import ingest as stream

FOLDER = "/root/testdata/sf0.001"
KEYS = ["project_id", "visitor_id", "event_date", "platform"]


def write_messages(spark, path, events):
    for k, rows in enumerate(events):
        path.mkdir(exist_ok=True)
        lines = [json.dumps({"type": r.event, "project_id": r.project_id, "device_id": r.device_id, "link_id": r.link_id, "engagement_time": r.engagement_time, "data": str(r.event_id), "created_at": r.created_at.isoformat()}) for r in rows]
        (path / f"part-{k}.json").write_text("\n".join([*lines, "{broken", '{"type":"view"}']) + "\n")


def test_stream_equals_batch(spark, tmp_path):
    t = tables(spark, FOLDER)
    events = t.events.orderBy("created_at", "event_id").collect()
    write_messages(spark, tmp_path / "in", [events[:400], events[400:]])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    messages = stream.messages(spark, str(tmp_path / "in"), files_per_batch=1)
    stream.start(messages, out, check, t.devices, t.visitors, t.links, "2024-02-01", delay="60 days").awaitTermination(300)
    found = ingest.referrals(ingest.dedup_views_fixed(t.events), t.links, t.visitors)
    everything = ingest.dedup_views_fixed(t.events).unionByName(ingest.referral_events(found))
    enriched = ingest.enrich(everything, t.devices, t.links)
    want = sorted(rollups.by_visitor(enriched, t.visitors).select(*KEYS, *METRICS).collect())
    assert sum(r.user_referred for r in want) > 0
    assert sorted(stream.visitor_days(spark, out).select(*KEYS, *METRICS).collect()) == want
    links = rollups.by_link(enriched, t.visitors)
    assert stream.link_days(spark, out).agg(F.sum("views")).first() == links.agg(F.sum("views")).first()
    last = {(r.project_id, r.visitor_id): r.updated_at for r in ingest.last_visits(t.events, t.visitors).collect()}
    assert {(r.project_id, r.visitor_id): r.updated_at.replace(tzinfo=None) for r in stream.visits(spark, out).collect()} == last
    touched = {r.visitor_id: r.updated_at for r in ingest.touched_visitors(everything, t.visitors).collect()}
    assert {r.visitor_id: r.updated_at.replace(tzinfo=None) for r in stream.touched(spark, out).collect()} == touched
    assert {r.visitor_id for r in stream.inviters(spark, out).collect()} == {r.visitor_id for r in found.collect()}

    stored = spark.read.parquet(f"{out}/received/batch=0")
    first = spark.createDataFrame(stored.collect(), stored.schema)
    stream.batch_writer(out, t.devices, t.visitors, t.links)(first, 0)  # the first batch again
    assert sorted(stream.visitor_days(spark, out).select(*KEYS, *METRICS).collect()) == want
    stream.compact(spark, out, str(tmp_path / "vds"))
    assert spark.read.parquet(str(tmp_path / "vds")).count() == len(want)


def test_a_view_across_batches_and_an_install_through_a_link(spark, tmp_path):
    """Two views one second apart in neighbouring batches count once; a referrer is credited in the batch of the install."""
    devices = spark.createDataFrame([(1, "ios", "1.0"), (2, "web", "1.0")], "device_id long, platform string, app_version string")
    visitors = spark.createDataFrame([(10, 1, 7, None, "a"), (20, 2, 7, None, "b")], "visitor_id long, device_id long, project_id long, inviter_id long, sdk_identifier string")
    links = spark.createDataFrame([(5, 7, 20, "p")], "link_id long, project_id long, visitor_id long, path string")
    (tmp_path / "in").mkdir()
    say = lambda kind, second, link=None: json.dumps({"type": kind, "project_id": 7, "device_id": 1, "link_id": link, "data": f"{kind}{second}", "created_at": f"2024-01-01T00:00:{second:02d}"})
    (tmp_path / "in" / "0.json").write_text(say("view", 10) + "\n")
    (tmp_path / "in" / "1.json").write_text(say("view", 11) + "\n" + say("install", 12, 5) + "\n" + say("view", 30) + "\n")
    out = str(tmp_path / "out")
    stream.start(stream.messages(spark, str(tmp_path / "in"), files_per_batch=1), out, str(tmp_path / "check"), devices, visitors, links, "2024-02-01").awaitTermination(300)
    got = {r.visitor_id: r for r in stream.visitor_days(spark, out).collect()}
    assert (got[10].views, got[10].installs, got[20].user_referred) == (2, 1, 1)
    assert [(r.visitor_id, r.referrer_id) for r in stream.inviters(spark, out).collect()] == [(10, 20)]
    assert [(r.visitor_id, r.link_id) for r in stream.visits(spark, out).collect()] == [(10, 5)]


def test_daily_counts(spark, tmp_path):
    t = tables(spark, FOLDER)
    t.events.select(F.col("created_at").cast("timestamp").alias("created_at"), "project_id", "event").write.parquet(str(tmp_path / "events"))
    source = spark.readStream.schema("created_at timestamp, project_id long, event string").parquet(str(tmp_path / "events"))
    query = stream.daily_counts(source).writeStream.format("memory").queryName("daily_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("daily_counts").agg(F.sum("n")).first()[0] == t.events.count()


def test_views_are_deduplicated_over_batches(spark, tmp_path):
    times = [("a", 0, "view"), ("b", 3, "view"), ("c", 6, "view"), ("d", 9, "view"), ("e", 9, "open"), ("f", 20, "view")]
    for k, half in enumerate((times[:2], times[2:])):
        rows = [(name, 1, event, f"2024-01-01 00:00:{second:02d}") for name, second, event in half]
        spark.createDataFrame(rows, "name string, device_id long, event string, at string").coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema("name string, device_id long, event string, at string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    events = source.select("name", "device_id", "event", F.to_timestamp("at").alias("created_at"))
    query = stream.dedup_views(events).writeStream.format("memory").queryName("kept_views").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.name for r in spark.table("kept_views").collect()} == {"a", "c", "e", "f"}

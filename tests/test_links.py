"""Links are the whole part table, and events reach all of them."""

from millrace.sources.adapter import tables

FOLDER = "/root/testdata/sf0.01"


def test_links_are_the_whole_part_table(spark):
    t = tables(spark, FOLDER)
    projects = {r.link_id: r.project_id for r in t.links.collect()}
    assert len(projects) == spark.read.parquet(f"{FOLDER}/part.parquet").count() == t.links.count()
    assert t.campaigns.count() == spark.read.parquet(f"{FOLDER}/nation.parquet").count()
    raw = spark.read.parquet(f"{FOLDER}/events.parquet")
    assert t.events.count() + t.purchases.count() == raw.count()
    for found in (t.events, t.purchases):
        of = found.filter("link_id is not null").select("link_id", "project_id").collect()
        assert all(projects[r.link_id] == r.project_id for r in of)
        assert len({r.link_id for r in of}) > len(projects) / 2

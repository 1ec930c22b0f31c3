"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

A row's size is its number of words. Each source has a weight; the weights share a share of all sizes,
a source gets ``most`` times its own size at most, and what is over goes to the others by weight until none
is above. Which rows are taken follows from a hash of their key: a source's target is a number of whole
passes over it, plus a rest, for which rows are taken in the order of their hash. That order is
never built: sizes are summed by (source, hash bucket), the bucket in which the sum crosses the rest is
the only one refined, by the hash's next bits, and after LEVELS steps there is a threshold for each
source. A row is taken once more if its hash is below. The last bucket, mostly one row, goes to the side that
leaves the sum nearer to the rest.

Thresholds are nested: a smaller target takes a subset. Rows with equal keys (or null ones) have equal
hashes and are taken together. Null text has size 0; null sources form one source, ordered last. An
empty table gives an empty one. If all sizes are 0, so are all targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import scratch
from millrace.llm.names import column, packed, unpacked
from millrace.llm.words import SPACES

BITS, LEVELS = 12, 4


def size(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def digest(key: Column) -> Column:
    """BITS * LEVELS bits from the MD5 of the key's text."""
    hexes = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4)
    return F.conv(hexes, 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """From (source, source_size): also target, passes and rest. Sources by code point, null last, get the
    ``weights`` in turn."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("_i", (F.row_number().over(in_order) - 1) % len(weights))
    weighed = weighed.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_i") + 1))
    # The sources that reach their limit are the first ones by limit / weight; the rest share by weight.
    limit = F.col("source_size") * most
    ratio = limit / F.col("_w")
    weighed = weighed.withColumns({"_limit": limit.cast("double"), "_ratio": ratio.cast("double")})
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = weighed.withColumns({
        "_full": F.coalesce(F.sum("_limit").over(before), F.lit(0.0)),
        "_used": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        "_total": F.sum("source_size").over(everything) * F.lit(float(share)),
        "_all": F.sum("_w").over(everything),
    })
    rate = (F.col("_total") - F.col("_full")) / (F.col("_all") - F.col("_used"))
    # The first source whose own limit is not reached sets the rate for itself and all after it.
    level = level.withColumn("_rate", F.when(rate <= F.col("_ratio"), rate))
    level = level.withColumn("_rate", F.first("_rate", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("_rate").isNull(), F.col("_limit")).otherwise(F.least(F.col("_limit"), F.col("_rate") * F.col("_w")))
    out = level.withColumn("target", target)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("passes", passes)
    return out.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).select("source", "source_size", "target", "passes", "rest")


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """For every source of ``budgets`` (source, rest) the least hash that is not taken. ``sized`` has
    (source, size, hash) and is read once a level; only the boundary bucket's rows are summed again."""
    state = budgets.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(True).alias("open"))
    for level in range(LEVELS):
        below = BITS * (LEVELS - level - 1)
        bucket = F.shiftright("hash", below)
        inside = sized.alias("d").join(
            state.filter("open").select(F.col("source").alias("_s"), F.col("prefix").alias("_p")).alias("s"),
            F.col("d.source").eqNullSafe(F.col("s._s")) & (F.shiftright(F.col("d.hash"), below + BITS) == F.col("s._p")),
        )
        sums = inside.groupBy(F.col("d.source").alias("source"), bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        # A bucket is whole if the sum up to it keeps within what is left; the first that does not is the boundary.
        upto = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("size").over(upto)).withColumnRenamed("source", "_s")
        found = sums.join(state.select(F.col("source").alias("_t"), "rest"), F.col("_s").eqNullSafe(F.col("_t")))
        found = found.groupBy("_s").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))).alias("edge"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("spent"),
            F.min(F.when(F.col("upto") > F.col("rest"), F.col("upto") - F.col("rest"))).alias("over"),
        )
        nearer = F.col("over") < F.col("rest") - F.col("spent") if not below else F.lit(False)
        state = state.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source",
            (F.col("rest") - F.when(F.col("open"), F.coalesce("spent", F.lit(0))).otherwise(0)).alias("rest"),
            # Without an edge all of the bucket (at the first level, of the source) is taken: the next prefix.
            F.when(F.col("open") & F.col("edge").isNotNull(), F.col("edge") + F.when(nearer, 1).otherwise(0))
            .when(F.col("open"), F.shiftleft(F.col("prefix") + 1, BITS))
            .otherwise(F.shiftleft("prefix", BITS)).alias("prefix"),
            (F.col("open") & F.col("edge").isNotNull()).alias("open"),
        )
        state = scratch.table(state, "edges")
    return state.select(F.col("source").alias("_s"), F.col("prefix").alias("threshold"))


#: Rows of the plan (one for each source) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def plan(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """_s, source_size, target, passes and threshold of every source; a stored table."""
    slim = df.select(column(source).cast("string").alias("source"), size(column(text).cast("string")).alias("size"), digest(column(key)).alias("hash"))
    sized = scratch.table(slim, "sizes")
    budgets = scratch.table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **how), "targets")
    edges = thresholds(sized, budgets)
    made = budgets.join(edges, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("source", "_s")
    made = scratch.table(made.drop("rest"), "plan")
    scratch.drop(sized)
    return made


def _planned(df: DataFrame, by: DataFrame, source: str) -> DataFrame:
    if by.count() <= BROADCAST_ROWS:
        by = F.broadcast(by)
    return df.join(by, F.col(source).cast("string").eqNullSafe(F.col("_s")))


def _copies(key: str) -> Column:
    return F.col("passes") + F.when(digest(F.col(key)) < F.col("threshold"), 1).otherwise(0)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row."""
    slim = df.select(column(key).alias("doc_id"), column(source).cast("string").alias("source"), size(column(text).cast("string")).alias("size"))
    taken = _planned(slim, plan(df, key, text, source, **how), "source").withColumn("copies", _copies("doc_id"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def resample(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of the mix: each as often as it is taken, with its own columns."""
    row = packed(df.columns).alias("_row")
    by = plan(df, key, text, source, **how)
    planned = _planned(df.select(row, column(source).alias("_source"), column(key).alias("_key")), by, "_source")
    repeated = planned.withColumn("_copies", _copies("_key")).filter("_copies > 0")
    return repeated.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*unpacked("_row", df.columns))

"""Shards by a hierarchical weighted hash tree.

A tree has regions, regions have racks, racks have shards, and every node weighs what its shards weigh.
A row descends from the root: at each level every child draws -ln(u) / weight, with u from a hash of the
row's key and the child's name, and the least draw wins. A node's draw depends on its own name and weight
alone, so where a weight changes, rows move only into or out of that node's subtree; all others stay.
:func:`grow` puts a further shard into a region of its own, so rows move into that shard and nowhere else.

Equal keys go together, a null key is a key of its own, and weights of 0 get no rows. A null text has no bytes, a long one is
measured whole. Slots are in the order of blocks, then key (null first), checksum, size and a hash of the text, so the same rows
get the same slots in any order of theirs; rows that agree in key and text are the same, and each gets one of the slots.
An empty table gives an empty one. Only key and text are read, so other columns' names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import scratch
from millrace.llm.names import column

#: Regions of racks of (shard, weight).
Tree = list[list[list[tuple[int, float]]]]
#: Rows that are numbered together, about.
SLOT_ROWS = 20_000


def tree(shards: int, racks: int = 3, per_rack: int = 4) -> Tree:
    """Shards 0, 1, ... of equal weight in regions of ``racks`` racks of ``per_rack`` shards."""
    ids = [(s, 1.0) for s in range(shards)]
    split = [ids[i : i + per_rack] for i in range(0, shards, per_rack)]
    return [split[i : i + racks] for i in range(0, len(split), racks)]


def grow(base: Tree) -> Tree:
    """The tree with one more shard of weight 1, in a region of its own."""
    return [*base, [[(1 + max((s for region in base for rack in region for s, _ in rack), default=-1), 1.0)]]]


def _draw(key: Column, children: list[tuple[int, str, float]]) -> Column:
    """The child with the least draw; children are (number, name, weight)."""
    draws = []
    for number, name, weight in children:
        if weight > 0:
            # 52 bits of the hash, in (0, 1)
            u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
            draws.append(F.struct((-F.log(u) / F.lit(weight)).alias("draw"), F.lit(number).alias("child")))
    if len(draws) == 1:
        return draws[0]["child"]
    return F.least(*draws)["child"]


def shard(key: Column, by: Tree) -> Column:
    """The shard of a key."""
    weight = lambda rack: sum(w for _, w in rack)

    def in_rack(r: int, k: int) -> Column:
        return _draw(key, [(s, f"shard {s}", w) for s, w in by[r][k]])

    def in_region(r: int) -> Column:
        racks = [(k, f"rack {r}.{k}", weight(rack)) for k, rack in enumerate(by[r])]
        racks = [x for x in racks if x[2] > 0]
        return _branch(_draw(key, racks), [(k, in_rack(r, k)) for k, _, _ in racks])

    regions = [(r, f"region {r}", sum(map(weight, racks))) for r, racks in enumerate(by)]
    regions = [x for x in regions if x[2] > 0]
    if not regions:
        raise ValueError("no shard has a weight")
    return _branch(_draw(key, regions), [(r, in_region(r)) for r, _, _ in regions])


def _branch(on: Column, cases: list[tuple[int, Column]]) -> Column:
    if len(cases) == 1:
        return cases[0][1]
    out = F.when(on == cases[0][0], cases[0][1])
    for value, then in cases[1:]:
        out = out.when(on == value, then)
    return out


def slots(df: DataFrame, shard_column: str, order: list[str], out: str = "slot") -> DataFrame:
    """Number each shard's rows from 0 without gaps, in an order that the rows alone decide. Rows are dealt by a hash of the
    columns ``order`` into blocks of about SLOT_ROWS and ordered there by these columns; rows that agree in all columns are
    counted before and dealt out after, so no block has many of them. Blocks are counted, and a row's slot is its
    rank in its block after the blocks before. The plan reads ``df`` twice, so it should be a stored table."""
    blocks = max(1, -(-df.count() // SLOT_ROWS))
    names = df.columns
    # Blocks of a shard lie in one hash range each, and hold what has equal values in ``order``.
    distinct = df.groupBy(*names).agg(F.count("*").alias("_n")).withColumn("_block", F.pmod(F.xxhash64(F.lit("block"), *order), F.lit(blocks)))
    counts = distinct.groupBy(shard_column, "_block").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy(shard_column).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    starts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    own = Window.partitionBy(shard_column, "_block").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    ranked = distinct.withColumn("_rank", F.coalesce(F.sum("_n").over(own), F.lit(0))).join(starts, [shard_column, "_block"])
    base = (F.col("_start") + F.col("_rank")).alias("_base")
    # Equal rows get the next slots, in steps, so that very many of them are dealt to many tasks.
    steps = ranked.select(*names, base, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(SLOT_ROWS).cast("long"))).alias("_step"))
    steps = steps.repartition(shard_column, F.shiftright(F.col("_base") + F.col("_step"), 14))
    last = F.least(F.col("_n"), F.col("_step") + SLOT_ROWS) - 1
    return steps.select(*names, F.explode(F.sequence(F.col("_base") + F.col("_step"), F.col("_base") + last)).alias(out))


def assign(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard of every row."""
    base = tree(shards)
    data = F.coalesce(column(text).cast("string"), F.lit("")).cast("binary")
    placed = df.select(
        column(key).alias("key"),
        (F.length(data).cast("long") + 8).alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias("digest"),
        shard(column(key), base).alias("shard"),
        shard(column(key), grow(base)).alias("grown_shard"),
    )
    stored = scratch.table(placed, "shards")
    found = slots(stored, "shard", ["key", "text_crc32", "size", "digest"])
    return found.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

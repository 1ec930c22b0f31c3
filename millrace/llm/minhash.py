"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct shingles of WORDS lower-cased (A-Z) words. Its sketch has M registers:
each is the least of exponential draws over the set, kept as a truncated exponent of base B, so
registers of a union are the larger ones of its parts, and two documents agree in a register about as often as
their Jaccard similarity says. A shingle's draws are one Poisson process dealt over the registers, and
stops as soon as it can lower none, so a set costs its size and a few hundred draws.

1. Documents with the same words are one node; the least doc_id stands for them.
2. Bands of ROWS registers put nodes into buckets. At the lowest similarity that is linked, a pair shares
   no bucket with a probability of 6e-11 at 85 percent and of 5e-8 at 80.
3. Every node is paired with the least node of each of its buckets. A pair goes on if its sizes allow the
   similarity and the likelihood of the registers' order, given both sizes, peaks at LEAST of that limit or more
   (over five standard deviations below it); links are then confirmed on the full sets.
4. Buckets that still hold more than one component are searched in blocks of BLOCK x BLOCK nodes, which carry their
   sets. A pair is looked at in the first band that it shares, passes the same tests, and its sets are intersected
   there; of the links a block finds, those that join components go on, so a block gives at most one link a
   node, however many pairs it compares. They are confirmed again on the texts.

Nulls and texts without words have an empty set and are linked with nothing. Rows with the same doc_id
are one document, linked with all that any of its rows is. Rows with a null doc_id are linked with
nothing. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import scratch
from millrace.llm.arrow import release, slices
from millrace.llm.components import components
from millrace.llm.names import column
from millrace.llm.words import mix, window_hashes, word_hashes

WORDS = 5
#: The lowest similarity that is linked, unless near_duplicates is asked for another.
PERCENT = 85
M, ROWS = 128, 4
B, A, LIMIT = 1.001, 20.0, 65535
#: Estimates below which a pair is not confirmed, by the limit in percent.
LEAST = {85: 0.68, 80: 0.55}
#: Equal registers below which a pair is not looked at further; the limits give 109 and 102 on average.
FEWEST = 64
BLOCK = 512
KEPT = np.uint64(2**48 - 1)
#: Rows of ids that may be broadcast (some 60 bytes each in memory); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(window_hashes(hashes, min(WORDS, len(words))) + np.uint64(min(WORDS, len(words))))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches of some non-empty sets: one row of M registers each."""
    if not sets:
        return np.empty((0, M), "<u2")
    sizes = np.array([len(x) for x in sets])
    least = np.full((len(sets), M), np.inf)
    flat = least.reshape(-1)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    x = np.zeros(len(element))
    step = 0
    while len(element):
        step += 1
        z = mix(element + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        x -= np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (A * M)
        np.minimum.at(flat, owner * M + (z & np.uint64(M - 1)).astype(np.int64), x)
        go_on = x < least.max(axis=1)[owner]
        element, owner, x = element[go_on], owner[go_on], x[go_on]
    return np.clip(np.floor(1 - np.log(least) / np.log(B)), 0, LIMIT).astype("<u2")


def similarity(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n: np.ndarray, o: np.ndarray) -> np.ndarray:
    """The similarity at which seeing ``more`` registers above the other's, ``less`` below and ``equal`` ones is
    likeliest, for sets of ``n`` and ``o`` elements."""
    u, v = n / (n + o), o / (n + o)
    scale = (B - 1) / B

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        above = -np.log1p(-scale * np.maximum(u - v * j, 0)) / np.log(B)
        below = -np.log1p(-scale * np.maximum(v - u * j, 0)) / np.log(B)
        return more * np.log(above + 1e-12) + less * np.log(below + 1e-12) + equal * np.log(np.maximum(1 - above - below, 1e-12))

    low, high = np.zeros(len(n)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood has one peak
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = log_likelihood(a) > log_likelihood(b)
        high, low = np.where(left, b, high), np.where(left, low, a)
    return (low + high) / 2


def sketch(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, same (a digest of the words; null without words) and sketch (M registers, u16)."""
    schema = "doc_id long, n_shingles long, same binary, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            sets = [shingles(x) for x in texts]
            rows = registers([x for x in sets if len(x)])
            made = iter(rows)
            same = [hashlib.blake2b(b" ".join(t.encode().lower().split()), digest_size=16).digest() if len(s) else None for t, s in zip(texts, sets, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(same, pa.binary()), pa.array([next(made).tobytes() if len(x) else None for x in sets], pa.binary())],
                ["doc_id", "n_shingles", "same", "sketch"],
            )
        release()

    return df.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text")).mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, M)


def _plausible(x: np.ndarray, y: np.ndarray, n: np.ndarray, o: np.ndarray) -> np.ndarray:
    """The estimated similarity of rows of registers x and y."""
    more, less = (x > y).sum(1), (x < y).sum(1)
    return similarity(more, less, M - more - less, n.astype(float), o.astype(float))


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose sizes and registers allow the similarity."""
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"k_{s}"))
    joined = pairs.join(side("v"), "v").join(side("u"), "u").filter(_sizes("n_u", "n_v", percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                good = _plausible(_matrix(batch.column("k_u")), _matrix(batch.column("k_v")), get("n_u"), get("n_v")) >= LEAST[percent]
                yield batch.select(["u", "v"]).filter(pa.array(good))

    return joined.mapInArrow(run, "u long, v long").distinct()


def _sizes(n: str, o: str, percent: int):
    return F.least(n, o) * 100 >= F.greatest(n, o) * percent


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union of their documents' full sets."""
    pairs = scratch.table(pairs, "pairs")
    ids = scratch.table(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "ids")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = scratch.table(docs.join(ids, "doc_id", "left_semi"), "texts")
    side = lambda s: texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}"))
    joined = pairs.join(side("v"), "v").join(side("u"), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[str, np.ndarray]] = {}

        def of(key: int, text: str) -> np.ndarray:
            if key not in known or known[key][0] != text:
                if len(known) >= 256:
                    known.clear()
                known[key] = text, shingles(text)
            return known[key][1]

        for batch in slices(batches, "text_u"):
            good = []
            for u, v, text_u, text_v in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "text_u", "text_v")), strict=True):
                x, y = of(u, text_u), of(v, text_v)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    links = scratch.table(joined.mapInArrow(run, "u long, v long").distinct(), "links")
    scratch.drop(texts)
    return links


def _sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The sets of the documents with these ids: the first six bytes of each hash, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            made = [np.unique(shingles(t) & KEPT).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["id", "shingles"])
        release()

    ids = ids.select(F.col("id").alias("doc_id"))
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_semi").mapInArrow(run, "id long, shingles binary")


def _blocks(rows: DataFrame, percent: int) -> DataFrame:
    """From (bucket, band, size, id, n, sketch, component, shingles): links (u, v) between different components."""
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), count).cast("int")
    dealt = rows.withColumns({"_n": count, "_b": own}).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("bucket", "band", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), "_b", "id", "n", "sketch", "component", "shingles")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            for part in slices([batch], "shingles", 16 << 20):
                t = pa.Table.from_batches([part])
                t = pa.concat_tables([left, t]) if left is not None else t
                keys = np.stack([t.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
                whole = int(np.flatnonzero((keys == keys[-1]).all(1))[0])  # the last group may go on
                if whole:
                    yield _joining(t.slice(0, whole), percent)
                left = t.slice(whole)
        if left is not None and left.num_rows:
            yield _joining(left, percent)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def _joining(t: pa.Table, percent: int) -> pa.RecordBatch:
    """Of the links within each group of rows sorted by (bucket, i, j), those that join components, likeliest first."""
    at = {c: t.column(c).to_numpy() for c in ("id", "n", "component", "_b", "bucket", "i", "j", "band")}
    k = _matrix(t.column("sketch"))
    group = np.cumsum(np.r_[True, np.any([at[c][1:] != at[c][:-1] for c in ("bucket", "i", "j")], axis=0)])
    across = at["i"] != at["j"]  # two blocks are compared with each other, one block with itself
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    x = np.arange(len(group))
    for apart in range(1, int(np.bincount(group).max())):
        x = x[x + apart < len(group)]
        x = x[group[x] == group[x + apart]]
        y = x + apart
        n, o = at["n"][x], at["n"][y]
        ok = (at["component"][x] != at["component"][y]) & (100 * np.minimum(n, o) >= percent * np.maximum(n, o))
        ok &= ~across[x] | (at["_b"][x] != at["_b"][y])
        p, q = x[ok], y[ok]
        for start in range(0, len(p), 20_000):
            a, b = p[start : start + 20_000], q[start : start + 20_000]
            same = k[a] == k[b]
            first = same.reshape(len(a), M // ROWS, ROWS).all(2).argmax(1)
            near = (same.sum(1) >= FEWEST) & (first == at["band"][a])
            a, b = a[near], b[near]
            likely = _plausible(k[a], k[b], at["n"][a], at["n"][b])
            good = likely >= LEAST[percent]
            found.append((a[good], b[good], likely[good]))
    us, vs = [], []
    if found:
        x, y, likely = (np.concatenate([f[side] for f in found]) for side in range(3))
        data = t.column("shingles")
        known: dict[int, np.ndarray] = {}

        def of(row: int) -> np.ndarray:
            if row not in known:
                packed = np.frombuffer(data[row].as_py(), np.uint8).reshape(-1, 6)
                known[row] = np.pad(packed, ((0, 0), (0, 2))).view("<u8").reshape(-1)
            return known[row]

        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = parent.get(parent[c], parent[c])
                c = parent[c]
            return c

        for r in np.argsort(-likely, kind="stable").tolist():
            a, b = int(x[r]), int(y[r])
            p, q = root(int(at["component"][a])), root(int(at["component"][b]))
            if p == q:
                continue
            one, two = of(a), of(b)
            both = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * both >= percent * (len(one) + len(two) - both):
                parent[max(p, q)] = min(p, q)
                us.append(max(int(at["id"][a]), int(at["id"][b])))
                vs.append(min(int(at["id"][a]), int(at["id"][b])))
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row, linked from a similarity of ``percent`` (one of LEAST) up."""
    docs = df.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    sketches = scratch.table(sketch(df, key, text), "sketches")
    groups = sketches.filter("same is not null and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("id"))
    groups = scratch.table(groups, "groups")
    nodes = sketches.join(groups, "same").filter("doc_id = id").dropDuplicates(["same"])
    nodes = scratch.table(nodes.select("id", F.col("n_shingles").alias("n"), "sketch"), "nodes")

    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(M // ROWS - 1)), lambda b: F.xxhash64(b, F.substr("sketch", b * width + 1, F.lit(width))))
    placed = nodes.select("id", F.posexplode(keys).alias("band", "bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("least")).filter("size > 1")
    members = scratch.table(placed.join(shared, "bucket"), "buckets")

    stars = scratch.table(members.filter("id > least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct(), "pairs")
    own = sketches.filter("doc_id is not null").join(groups, "same").select("doc_id", F.col("id").alias("u")).distinct()
    first = own.groupBy("doc_id").agg(F.min("u").alias("v"))
    repeated = own.join(first, "doc_id").filter("u <> v").select("u", "v")  # rows of one doc_id
    joined = components(_confirmed(_estimated(stars, nodes, percent), docs, percent).union(repeated))
    named = members.join(joined, members.id == joined.node, "left").select("bucket", "band", "size", "id", F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("bucket")
    open_ = scratch.table(named.join(mixed, "bucket"), "mixed")
    sets = scratch.table(_sets(open_.select("id").distinct(), docs), "sets")
    rows = open_.join(nodes, "id").join(sets, "id")
    new = _confirmed(_blocks(rows, percent), docs, percent)
    if not new.isEmpty():
        joined = components(joined.toDF("u", "v").union(new))
    scratch.drop(sets)

    of_group = groups.join(joined, groups.id == joined.node, "left").select("same", F.coalesce("component", "id").alias("_component"))
    out = sketches.filter("same is not null").select("doc_id", "n_shingles", "same").join(of_group, "same", "left").drop("same")
    # Texts without words meet no group; they are no key of the join.
    out = out.unionByName(sketches.filter("same is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("_component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

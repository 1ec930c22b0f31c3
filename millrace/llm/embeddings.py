"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

1. Equal vectors with one label are one node with a number of copies.
2. Nodes of a label are dealt by hash into shards of SHARD nodes at most on average, and every shard gets a graph
   of its own: layers of shrinking size over a random order, each node wired to LINKS neighbours chosen
   for nearness and spread.
3. Every pair of a label's shards is one task, which searches each shard's nodes in the other's graph (and a shard's
   own in its own). Shards are files in the shared folder, and a task gets the names of two. A search whose beam is full of
   hits is repeated with a beam four times as wide. AUDIT nodes are compared with the whole shard; if a link of theirs
   was missed, or more than a part of their NEAREST nodes, all beams are doubled and the search is repeated, up to a quarter of the
   shard, from where on all its nodes are compared. The recall that the audit measures is kept with every pair.
4. What is found is confirmed by the cosine in double precision. A task gives each node's number of links
   and a forest of its components, one row a node at most, however many links there are.

Vectors that are null, empty, zero, or hold a null or non-finite component, and those with a null label or
id, link with nothing. Vectors of different lengths do not either. Repeated rows are vectors of their
own. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import scratch
from millrace.llm.components import components
from millrace.llm.names import column

COSINE = 0.93
SHARD = 8192
LINKS, BUILD_BEAM, BEAM, SHRINK = 24, 48, 64, 16
AUDIT, NEAREST, RECALL = 128, 10, 0.95
BLOCK, STEP = 512, 4
#: Tasks of one stage; each takes several pairs of shards where there are more.
MOST_PARTS = 100_000


def search(v: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the beam and their similarities for every query, best first; -1 where there are fewer."""
    if 4 * beam >= len(v):  # as wide as a quarter of the graph: every node
        sims = queries @ v.T
        nodes = np.argsort(-sims, axis=1).astype(np.int32)
        return nodes, np.take_along_axis(sims, nodes, 1)
    top = len(layers[-1])
    sims = queries @ v[:top].T
    width = min(top, 8)
    nodes = np.argsort(-sims, axis=1, kind="stable")[:, :width].astype(np.int32)
    for depth in range(len(layers) - 1, -1, -1):
        nodes, sims = _beam(v, layers[depth], queries, nodes, beam if depth == 0 else min(beam, 12))
        if depth:
            nodes = nodes[:, :8]
    return nodes, sims


def _beam(v: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    q, n = len(queries), len(graph)
    beam = min(beam, n)
    seen = np.zeros((q, n + 1), bool)
    rows = np.arange(q)[:, None]
    nodes = np.full((q, beam), -1, np.int32)
    sims = np.full((q, beam), -np.inf, np.float32)
    width = min(beam, entries.shape[1])
    nodes[:, :width] = entries[:, :width]
    sims[:, :width] = np.where(nodes[:, :width] >= 0, np.einsum("qmd,qd->qm", v[nodes[:, :width]], queries), -np.inf)
    seen[rows, nodes] = True
    done = nodes < 0
    active = np.arange(q)
    step = max(STEP, beam // 16)
    while len(active):
        open_ = np.where(done[active], -np.inf, sims[active])
        best = np.argsort(-open_, axis=1, kind="stable")[:, :step]
        at = active[:, None]
        chosen = np.where(np.take_along_axis(open_, best, 1) > -np.inf, nodes[at, best], -1)
        done[at, best] = True
        near = np.where((chosen >= 0)[:, :, None], graph[chosen], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = np.where(seen[at, near], -1, near)
        seen[at, near] = True
        seen[:, -1] = False  # the place of -1
        new = np.where(near >= 0, np.einsum("qmd,qd->qm", v[near], queries[active]), -np.inf).astype(np.float32)
        all_nodes = np.concatenate([nodes[active], near], 1)
        all_sims = np.concatenate([sims[active], new], 1)
        all_done = np.concatenate([done[active], near < 0], 1)
        keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        nodes[active] = np.take_along_axis(all_nodes, keep, 1)
        sims[active] = np.take_along_axis(all_sims, keep, 1)
        done[active] = np.take_along_axis(all_done, keep, 1)
        active = active[(~done[active] & (nodes[active] >= 0)).any(1)]
    return nodes, sims


def _choose(v: np.ndarray, q: np.ndarray, nodes: np.ndarray, sims: np.ndarray, count: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) those nearer to the query than to any chosen before; free
    places go to the nearest of the rest."""
    x = v[nodes]
    between = np.einsum("qcd,qed->qce", x, x)
    chosen = np.zeros(nodes.shape, bool)
    closest = np.full(nodes.shape, -np.inf, np.float32)
    for c in range(nodes.shape[1]):
        good = (nodes[:, c] >= 0) & (closest[:, c] < sims[:, c]) & (chosen.sum(1) < count)
        chosen[:, c] = good
        closest = np.where(good[:, None], np.maximum(closest, between[:, c, :]), closest)
    rank = np.argsort(np.where(nodes < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :count]
    return np.take_along_axis(nodes, rank, 1)


def build(v: np.ndarray) -> list[np.ndarray]:
    """The layers of a graph over unit vectors in random order; layer 0 has all, the last is searched whole."""
    sizes = [len(v)]
    while sizes[-1] > 64:
        sizes.append(-(-sizes[-1] // SHRINK))
    layers: list[np.ndarray] = []
    for n in reversed(sizes):
        graph = np.full((n, LINKS), -1, np.int32)
        start = min(n, 128)
        _wire(v, graph, np.arange(start), np.broadcast_to(np.arange(start, dtype=np.int32), (start, start)))
        while start < n:
            stop = min(n, start + min(start, BLOCK))
            own = v[start:stop]
            # The nodes so far by search, from the layers above as far as they are in; the batch's own by comparison.
            above = [g for g in layers if len(g) <= start]
            found, _ = search(v, [graph[:start], *reversed(above)] if above else [graph[:start], graph[: min(start, 64)]], own, BUILD_BEAM)
            inside = np.argsort(-(own @ own.T), axis=1, kind="stable")[:, :16].astype(np.int32) + start
            _wire(v, graph, np.arange(start, stop), np.concatenate([found, inside], 1))
            start = stop
        layers.append(graph)
    return layers[::-1]


def _wire(v: np.ndarray, graph: np.ndarray, new: np.ndarray, candidates: np.ndarray) -> None:
    """Give new nodes their neighbours among the candidates, and the neighbours the new nodes."""
    candidates = np.where(candidates == new[:, None], -1, candidates)
    sims = np.where(candidates >= 0, np.einsum("qmd,qd->qm", v[candidates], v[new]), -np.inf).astype(np.float32)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
    candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
    graph[new] = -1
    chosen = _choose(v, v[new], candidates, sims, LINKS)
    graph[new, : chosen.shape[1]] = chosen
    to, frm = graph[new].reshape(-1), np.repeat(new, LINKS).astype(np.int32)
    to, frm = to[to >= 0], frm[to >= 0]
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    targets, first, counts = np.unique(to, return_index=True, return_counts=True)
    for lo in range(0, len(targets), BLOCK):
        t, c = targets[lo : lo + BLOCK], counts[lo : lo + BLOCK]
        place = np.arange(c.max())
        added = np.where(place < c[:, None], frm[np.minimum(first[lo : lo + BLOCK, None] + place, len(frm) - 1)], -1)
        both = np.concatenate([graph[t], added], 1)
        both = np.sort(both, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        sims = np.where(both >= 0, np.einsum("qmd,qd->qm", v[both], v[t]), -np.inf).astype(np.float32)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * LINKS]
        both, sims = np.take_along_axis(both, order, 1), np.take_along_axis(sims, order, 1)
        chosen = _choose(v, v[t], both, sims, LINKS)
        graph[t] = -1
        graph[t, : chosen.shape[1]] = chosen


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))).astype(np.float32)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x with the same row of y, in double precision."""
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def find(raw: np.ndarray, v: np.ndarray, layers: list[np.ndarray], q_raw: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The linked (query, node) pairs, and the recall that the audit has measured. AUDIT queries are compared with
    all nodes: their links and their NEAREST nodes are the truth, which there always is. Beams widen until all of those links
    and RECALL of the nearest are found."""
    audited = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    sims = q[audited] @ v.T
    true = _confirm(raw, q_raw, *np.nonzero(sims >= least - 1e-4), audited, least)
    near = np.argpartition(-sims, min(NEAREST, len(v)) - 1, axis=1)[:, :NEAREST]
    beam = min(BEAM, len(v))
    while True:
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for start in range(0, len(q), BLOCK):
            rows, width = np.arange(start, min(start + BLOCK, len(q))), beam
            while len(rows):
                many = max(1, min(len(rows), BLOCK * BEAM // width))
                full = []
                for some in np.array_split(rows, -(-len(rows) // many)):
                    nodes, sims = search(v, layers, q[some], width)
                    hit = (sims >= least - 1e-4) & (nodes >= 0)
                    # A query whose beam is full of hits is searched again; its links come from there.
                    again = hit.all(1) & (4 * width < len(v))
                    full.append(some[again])
                    i, j = np.nonzero(hit & ~again[:, None])
                    i, j = some[i], nodes[i, j].astype(np.int64)
                    ok = _true(raw, q_raw, i, j, least)
                    links.append((i[ok], j[ok]))
                rows = np.concatenate(full)
                width = min(4 * width, len(v))
        i, j = (np.concatenate([x[side] for x in links]) for side in (0, 1))
        nodes, _ = search(v, layers, q[audited], beam)
        recall = float(np.mean([len(np.intersect1d(a, b)) / near.shape[1] for a, b in zip(nodes, near, strict=True)]))
        missing = np.setdiff1d([a * len(v) + b for a, b in true], i * len(v) + j)
        if 4 * beam >= len(v) or (not len(missing) and recall >= RECALL):
            return i, j, recall
        beam = min(2 * beam, len(v))


def _true(raw: np.ndarray, q_raw: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    out = np.empty(len(i), bool)
    for start in range(0, len(i), 50_000):
        some = slice(start, start + 50_000)
        out[some] = cosines(q_raw[i[some]], raw[j[some]]) >= least
    return out


def _confirm(raw: np.ndarray, q_raw: np.ndarray, i: np.ndarray, j: np.ndarray, rows: np.ndarray, least: float) -> list[tuple[int, int]]:
    i = rows[i]
    ok = _true(raw, q_raw, i, j, least)
    return list(zip(i[ok].tolist(), j[ok].tolist(), strict=True))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches by the links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def _store(to: str, **arrays: np.ndarray) -> str:
    """Write a shard as a file of its own below ``to``; an attempt that is repeated writes another one."""
    store, base = fs.FileSystem.from_uri(to)
    store.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}.npz"
    held = io.BytesIO()
    np.savez(held, **arrays)
    with store.open_output_stream(f"{base}/{name}") as f:
        f.write(held.getbuffer())
    return f"{to}/{name}"


def _fetch(file: str) -> dict[str, np.ndarray]:
    store, base = fs.FileSystem.from_uri(file)
    with store.open_input_file(base) as f:
        found = np.load(io.BytesIO(f.read()))
        return {k: found[k] for k in found.files}


def _layers(shard: dict[str, np.ndarray]) -> list[np.ndarray]:
    return [shard[k] for k in sorted((k for k in shard if k.startswith("layer")), key=lambda k: int(k[5:]))]


def compared(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Ids, least reachable id and number of linked copies of the nodes of two shards (or one), and the recall measured."""
    x, u = a["x"], unit(a["x"])
    if b is None:
        i, j, recall = find(x, u, _layers(a), x, u, least)
        ids, copies, width = a["ids"], a["copies"], len(x)
    else:
        y, v = b["x"], unit(b["x"])
        i, j, one = find(y, v, _layers(b), x, u, least)
        k, h, other = find(x, u, _layers(a), y, v, least)
        ids, copies, width, recall = np.concatenate([a["ids"], b["ids"]]), np.concatenate([a["copies"], b["copies"]]), len(x) + len(y), min(one, other)
        i, j = np.concatenate([i, h]), np.concatenate([j, k]) + len(x)
    i, j = i[i != j], j[i != j]
    pairs = np.unique(np.concatenate([np.minimum(i, j) * width + np.maximum(i, j)]))
    i, j = pairs // width, pairs % width
    # Sums of whole numbers below 2**53 are exact in double precision.
    counts = (np.bincount(i, copies[j], width) + np.bincount(j, copies[i], width)).astype(np.int64)
    return ids, ids[forest(i, j, width)], counts, recall


def near_duplicates(df: DataFrame, least: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = df.select(column(key).cast("long").alias("vec_id"), column(vector).cast("array<double>").alias("x"), column(label).alias("label"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    valid = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(~bad & F.exists("x", lambda c: c != 0))
    nodes = valid.groupBy("label", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    nodes = scratch.table(nodes.withColumn("dim", F.size("x")), "vectors")
    per = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / SHARD).cast("long").alias("shards"))
    dealt = nodes.join(per, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("x"), F.col("shards")))

    to = scratch.folder(df.sparkSession, "shards")

    def graph(t: pa.Table) -> pa.Table:
        x = np.array(t.column("x").to_pylist(), np.float64)
        order = np.random.default_rng(len(x)).permutation(np.argsort(t.column("id").to_numpy(), kind="stable"))
        x = x[order]
        layers = {f"layer{k}": g for k, g in enumerate(build(unit(x)))}
        file = _store(to, ids=t.column("id").to_numpy()[order], copies=t.column("copies").to_numpy()[order], x=x, **layers)
        return pa.table({"label": t.column("label")[:1], "dim": t.column("dim")[:1], "shard": t.column("shard")[:1], "file": [file]})

    kind = dict(nodes.dtypes)["label"]
    shards = scratch.table(dealt.groupBy("label", "dim", "shard").applyInArrow(graph, f"label {kind}, dim int, shard long, file string"), "graphs")
    # A task is a pair of names; it fetches the two shards itself, so nothing is copied for the others.
    other = shards.select("label", "dim", F.col("shard").alias("other"), F.col("file").alias("o_file"))
    tasks = shards.join(other, ["label", "dim"]).filter("shard <= other").select("file", "o_file")
    parts = max(1, tasks.count())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, o_file in zip(batch.column("file").to_pylist(), batch.column("o_file").to_pylist(), strict=True):
                ids, root, counts, recall = compared(_fetch(file), None if file == o_file else _fetch(o_file), least)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root), pa.array(counts), pa.array(np.full(len(ids), recall))], ["id", "root", "n", "recall"])

    dealt_tasks = tasks.repartition(min(parts, MOST_PARTS), "file", "o_file")
    found = scratch.table(dealt_tasks.mapInArrow(compare, "id long, root long, n long, recall double"), "found")
    scratch.delete(df.sparkSession, to)
    lowest = found.agg(F.min("recall")).first()[0]
    if lowest is not None and lowest < RECALL:  # the last beam compares all nodes
        raise ValueError(f"the audit has found only {lowest} of the nearest nodes")
    joined = components(found.filter("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    summed = nodes.join(counts, "id").join(joined, nodes.id == joined.node, "left")
    summed = summed.select(F.col("label").alias("_label"), F.col("x").alias("_x"), (F.col("n") + F.col("copies") - 1).alias("_n"), F.coalesce("component", "id").alias("_component"))
    out = rows.join(summed, (F.col("label") == F.col("_label")) & (F.col("x") == F.col("_x")) & F.col("vec_id").isNotNull(), "left")
    out = out.select("vec_id", F.coalesce("_n", F.lit(0)).alias("n_links"), F.coalesce("_component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""Quality rules, language identification and embeddings against plain Python."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from millrace.llm import embeddings, languages, quality, queries

WORD = re.compile("[^\x20\x09-\x0d]+")
QSCHEMA = "doc_id long, text string, kept string, n_words int, _w int"


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = [False] * len(words)
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            hit[k : k + 3] = [True] * 3
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit), n < 50 or 100 * sum(hit) > 50 * n


def spark_hash(x, seed=42):
    data = x.encode() if isinstance(x, str) else (x % (1 << 64)).to_bytes(8, "little")
    found = xxhash.xxh64_intdigest(data, seed)
    return found - (1 << 64) * (found >> 63)


def grams(text):
    words = [spark_hash(w) for w in WORD.findall(text or "")]
    return [x % quality.BUCKETS for x in [*words, *(spark_hash(b, spark_hash(a) % (1 << 64)) for a, b in itertools.pairwise(words))]]


def quality_documents(seed):
    rng = random.Random(seed)
    good = [f"{a}{b}" for a in ("the", "on", "ré", "zu") for b in ("", "ing", "ed", "s", "tion")]
    rows = []
    for i in range(80):
        words = [rng.choice(good) for _ in range(rng.randint(1, 120))]
        if i % 4 == 0:
            words = [w.upper() + "!!" for w in words]
        if i % 7 == 0:
            words = words[:9] * 9
        rows.append((i, rng.choice([" ", "\n", "\t", "  "]).join(words)))
    return [*rows, (200, None), (201, ""), (202, "\n \n"), (203, "a | b\na | b\n\n c<>&"), (204, "x"), (None, "no id " * 60), (205, " ".join(f"é{k % 977}" for k in range(20_000))), (205, "again " * 3)]


def quality_frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], QSCHEMA)


def test_quality_by_hand(spark):
    rows = quality_documents(1)
    trusted = [i for i in range(80) if i % 4 and i % 7]
    ids = spark.createDataFrame([(i,) for i in [*trusted, trusted[0], None, 999]], "id long")
    got = quality.judge(quality_frame(spark, rows).repartition(3), ids).collect()
    raw, good = Counter(), (Counter(), Counter())
    for i, t in rows:
        raw.update(grams(t))
        if i in trusted:
            good[spark_hash(str(i)) % 2].update(grams(t))
    size = quality.BUCKETS
    part = lambda x, b: (x[b] + 1) / (sum(x.values()) + size)
    unseen = [(math.log(part(model, b) / part(raw, b)), n) for model, other in (good, good[::-1]) for b, n in other.items()]
    mean = sum(x * n for x, n in unseen) / sum(n for _, n in unseen)
    spread = math.sqrt(sum(n * (x - mean) ** 2 for x, n in unseen) / sum(n for _, n in unseen))
    threshold = mean - quality.SIGMAS * spread / math.sqrt(99)
    ratio = [math.log(part(good[0] + good[1], b) / part(raw, b)) for b in range(size)]
    want = {}
    for i, t in rows:
        own = grams(t)
        score = sum(ratio[b] for b in own) / len(own) if own else None
        want[i, t] = (*base(t), score)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id, r.text]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == w[:6]
        assert (r.score is None) == (w[6] is None) and (w[6] is None or abs(r.score - w[6]) < 1e-9)
        assert r.kept == (not w[5] and (w[6] is None or r.score >= threshold))


def test_quality_without_trust_or_rows(spark):
    none = spark.createDataFrame([], "id long")
    got = quality.judge(quality_frame(spark, quality_documents(2)), none).collect()
    assert all(r.score is None and r.kept != r.base_failed for r in got)
    assert quality.judge(quality_frame(spark, []), none).count() == 0


def test_quality_keeps_the_trusted_and_drops_the_rejected(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [(labels.get(r.doc_id), r.base_failed, r.kept) for r in queries.op8_quality(spark, folder).collect()]
    assert all(kept for label, failed, kept in got if label == 1 and not failed)
    assert not any(kept for label, _, kept in got if label == 0)


def small_lattice():
    return languages.Lattice(["a", "b", "ab", "ba", "▁", "▁a", "abab", "c"])


def by_enumeration(names, p, text):
    if not text:
        return 1.0
    total = 0.0
    for k in range(1, len(text) + 1):
        if text[:k] in names:
            total += p[names.index(text[:k])] * by_enumeration(names, p, text[k:])
        elif k == 1:
            total += languages.UNKNOWN * by_enumeration(names, p, text[k:])
    return total


def test_forward_sums_all_segmentations():
    names = ["a", "b", "ab", "ba", "▁", "▁a", "abab", "c"]
    rng = np.random.default_rng(1)
    p = np.append(rng.random(8) / 8, 0.0)[:, None]
    words = ["".join(x) for n in range(1, 6) for x in itertools.product("abz", repeat=n)]
    got = languages.log_probabilities(small_lattice(), p, words)[:, 0]
    for word, value in zip(words, got, strict=True):
        assert math.isclose(value, math.log(by_enumeration(names, p[:8, 0], "▁" + word)), rel_tol=1e-9)


def test_fit_raises_the_likelihood():
    lattice, counts = small_lattice(), {"abab": 5.0, "ba": 2.0, "c": 1.0}
    words = list(counts)
    flat = np.append(np.full(8, 1 / 8), 0.0)[:, None]
    value = lambda p: languages.log_probabilities(lattice, p, words)[:, 0] @ np.array(list(counts.values()))
    fitted = languages.fit(lattice, counts)
    assert abs(fitted[:-1].sum() - 1) < 1e-9 and value(fitted) > value(flat)


def test_language_edges(spark):
    rows = [(0, "the thing and the other", "en"), (1, "der und die das", "de"), (2, None, "en"), (3, "123 ½ !!", "de"), (4, "", None), (5, "the and", None), (6, "x" * 50_000, None), (None, "der und", "de"), (7, "日本語", None), (7, "der das", None)]
    df = spark.createDataFrame([(i, t, x, "clash") for i, t, x in rows], "doc_id long, text string, lang string, score string")
    model = languages.train(df.filter(~languages.held_out(languages.F.col("doc_id"))), queries.PIECES)
    got = languages.predict(df, model).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (r.text in (None, "123 ½ !!", "")) for r in got)
    assert {r.lang_pred for r in got} <= {"en", "de", "und"}
    nothing = languages.predict(df, languages.train(df.limit(0), queries.PIECES)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert languages.predict(df.limit(0), model).count() == 0


def test_language_accuracy_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op9_language(spark, folder).collect() if r.held_out]
    assert len(got) > 250 and sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.98 * len(got)


def exact_links(rows, least=embeddings.COSINE):
    ok = lambda x: x is not None and len(x) and all(c is not None and math.isfinite(c) for c in x) and any(x)
    parent, count = {r[0]: r[0] for r in rows}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        if ok(a[1]) and ok(b[1]) and len(a[1]) == len(b[1]) and a[2] is not None and a[2] == b[2]:
            x, y = np.array(a[1], float), np.array(b[1], float)
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                count[a[0]] += 1
                count[b[0]] += 1
                p, q = find(a[0]), find(b[0])
                parent[max(p, q)] = min(p, q)
    return {(i, count[i], find(i)) for i, _, _ in rows}


@pytest.mark.parametrize("shard", [embeddings.SHARD, 60])
def test_embeddings_by_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD", shard)
    rng = np.random.default_rng(5)
    rows, centres = [], rng.normal(size=(12, 16))
    for i in range(420):
        x = centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35, 3])
        rows.append((i, [float(np.float32(c)) for c in x], int(rng.integers(2))))
    rows += [(500 + k, rows[0][1], rows[0][2]) for k in range(30)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [], 1), (603, [1.0, None] * 8, 1), (604, [float("nan")] * 16, 0), (605, [float("inf")] * 16, 0), (606, rows[0][1], None), (607, [2 * c for c in rows[3][1]], rows[3][2]), (608, [1e30] * 16, 1), (609, [1e-30] * 16, 1), (610, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(i, x, label, 1) for i, x, label in rows], "vec_id long, embedding array<float>, label int, id int")
    got = embeddings.near_duplicates(df.repartition(3)).collect()
    rounded = [(i, x if x is None else [None if c is None else float(np.float32(c)) for c in x], label) for i, x, label in rows]
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == exact_links(rounded)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_no_embeddings(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_graph_search_recall():
    rng = np.random.default_rng(7)
    v = embeddings.unit(rng.normal(size=(3000, 24)))
    layers = embeddings.build(v)
    nodes, _ = embeddings.search(v, layers, v[:200], 64)
    true = np.argsort(-(v[:200] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(nodes.tolist(), true.tolist(), strict=True)]) >= 0.9
    assert [len(g) for g in layers] == [3000, 188, 12]


def test_graphs_find_the_links_of_large_shards(spark, monkeypatch):
    """Above 256 vectors a shard the graphs are walked: links and recall against brute force, end to end."""
    monkeypatch.setattr(embeddings, "SHARD", 700)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(500, 24))
    x = (centres[rng.integers(500, size=2400)] + rng.normal(size=(2400, 24)) * rng.choice([0.1, 0.2, 0.25, 2.0], size=(2400, 1))).astype(np.float32).astype(float)
    walked = []
    search = embeddings.search
    monkeypatch.setattr(embeddings, "search", lambda v, layers, q, beam: walked.append(4 * beam < len(v)) or search(v, layers, q, beam))
    one = {"ids": np.arange(900), "copies": np.ones(900, np.int64), "x": x[:900], **{f"layer{k}": g for k, g in enumerate(embeddings.build(embeddings.unit(x[:900])))}}
    ids, root, n, recall = embeddings.compared(one, None, embeddings.COSINE)
    assert any(walked) and recall >= embeddings.RECALL
    want = exact_links([(i, list(x[i]), 0) for i in range(900)])
    assert sum(c for _, c, _ in want) > 500 and sum(n) >= 0.99 * sum(c for _, c, _ in want)
    assert all(n[i] <= c for i, c, _ in want)
    df = spark.createDataFrame([(i, v.tolist(), 1, "clash", 0.5) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, file string, recall double")
    got = {(r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df.repartition(3)).collect()}
    want = exact_links([(i, v.tolist(), 1) for i, v in enumerate(x)])
    assert len(got & want) >= 0.99 * len(want)

"""Near-duplicates, repeated passages and components against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import minhash, queries, substrings
from millrace.llm.components import components

SCHEMA = "doc_id long, text string, same string, kept string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(rows, percent=85):
    """doc_id -> (set sizes, component) by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {(i, len(x), None if i is None else find(i)) for i, x in sets}


def made_documents(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            text = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((i, " ".join(text)))
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 150)))))
    return rows


def near_rows(spark, rows):
    got = minhash.near_duplicates(frame(spark, rows).repartition(3)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(rows)
    return {(r.doc_id, r.n_shingles, r.component_id) for r in got}


def test_near_duplicates_by_brute_force(spark):
    long = "long " + " ".join(f"l{k}" for k in range(30_000))
    rows = [*made_documents(1), (500, None), (501, ""), (502, " \n\t"), (503, "One two"), (504, "ONE  two"), (505, "one twó"), (506, long), (507, long + " end"), (None, "one two"), (508, "É a b c d"), (509, "é a b c d")]
    assert near_rows(spark, rows) == near(rows)


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"c{k}" for k in range(200)]
    rows = []
    for i in range(40):
        words[i * 5] = f"x{i}"
        rows.append((i, " ".join(words)))
    want = near(rows)
    assert {c for _, _, c in want} == {0}
    assert near_rows(spark, rows) == want


def test_repeats_where_no_text_has_a_passage(spark):
    rows = [(1, "a b c"), (2, "a b c"), (3, ""), (4, None), (None, "x")]
    got = substrings.remove_repeats(frame(spark, rows).repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]


def test_rows_with_one_doc_id_are_one_document(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    got = near_rows(spark, [(5, a), (5, b), (3, a), (9, b)])
    assert {c for _, _, c in got} == {3}


def test_no_documents(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    assert near_rows(spark, [(1, None), (2, " ")]) == {(1, 0, 1), (2, 0, 2)}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    x, y = pool[:2200], pool[400:2600]
    a, b, union = minhash.registers([x, y, pool[:2600]])
    assert (np.maximum(a, b) == union).all()
    true = 1800 / 2600
    guess = minhash._plausible(a[None], b[None], np.array([2200]), np.array([2200]))[0]
    assert abs(guess - true) < 0.15
    same = minhash._plausible(a[None], a[None], np.array([2200]), np.array([2200]))[0]
    assert same > 0.98


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        p, q = find(u), find(v)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    for node in parent:
        assert got.get(node, node) == find(node)


def removed(rows, window=13):
    first = defaultdict(lambda: 1 << 62)
    for i, t in rows:
        words = (t or "").encode().split()
        for k in range(len(words) - window + 1):
            if i is not None:
                first[tuple(words[k : k + window])] = min(i, first[tuple(words[k : k + window])])
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [substrings.GROUP, 50])
def test_repeats_by_brute_force(spark, group, monkeypatch):
    if group == 50:
        monkeypatch.setattr(substrings, "FLUSH", 3000)
    rng = random.Random(4)
    hot = " ".join(f"h{k}" for k in range(40))
    rows = [(i, t + (" " + hot + "\n" + t[:50] if i % 3 == 0 else "")) for i, t in made_documents(3, 150)]
    rows += [(900, None), (901, ""), (902, "few words"), (903, "same " * 60), (904, "same " * 30), (None, hot), (905, hot), (905, hot), (-3, hot + " é\tü"), (906, " ".join(f"z{k % 700}" for k in range(20_000)))]
    rng.shuffle(rows)
    got = substrings.remove_repeats(frame(spark, rows).repartition(4), group=group).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=str) == removed(rows)
    assert all(r.same == "x" and r.id == 1 for r in got)


@pytest.mark.parametrize("name", ["op3_minhash", "op10_substrings"])
def test_queries_on_the_small_tables(spark, name):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.QUERIES[name](spark, folder).collect()
    if name == "op3_minhash":
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == near(rows)
    else:
        assert sorted([(r.doc_id, r.n_words, r.n_removed) for r in got], key=str) == [x[:3] for x in removed(rows)]


def test_a_passage_in_all_documents_and_odd_names(spark, monkeypatch):
    """One passage everywhere, null ids, hot prefixes down to whole passages, and names that meet the operator's own."""
    monkeypatch.setattr(substrings, "FLUSH", 500)
    hot = " ".join(f"h{k % 7}" for k in range(30))
    rows = [(None if i % 9 == 0 else i % 50, f"a{i} b{i} " + hot + " " + " ".join(f"c{i * k}" for k in range(20)) + " " + "x" * 100) for i in range(120)]
    names = ["_bucket", "bucket", "row", "words", "key", "kept", "n_words", "a.b", "a`c"]
    df = spark.createDataFrame([(i, t, *[f"mine {n}" for n in names]) for i, t in rows], ["doc_id", "text", *names]).repartition(5)
    for group in (20, substrings.GROUP):
        got = substrings.remove_repeats(df, group=group, prefix="_cut_").collect()
        assert sorted([(r.doc_id, r._cut_n_words, r._cut_n_removed, r._cut_kept) for r in got], key=str) == removed(rows)
        assert all(r[n] == f"mine {n}" for r in got for n in names)
    assert substrings.remove_repeats(df).columns.count("kept") == 1


def test_the_trees_of_a_group():
    rng = random.Random(2)
    segments = [[rng.choice("abc") for _ in range(rng.randint(13, 22))] for _ in range(60)]
    numbers = np.array([ord(c) for x in segments for c in x], np.uint32)
    tree = substrings.Tree(numbers, np.array([len(x) for x in segments]), 13)
    leaves = ["".join(segments[s][o : o + 13]) for s, o in zip(tree.segment[tree.order], tree.offset[tree.order], strict=True)]
    assert leaves == sorted(leaves) and len(leaves) == sum(len(x) - 12 for x in segments)
    for k in range(1, len(leaves)):
        assert tree.common[k] == next((i for i in range(13) if leaves[k][i] != leaves[k - 1][i]), 13)
    for depth in (1, 3, 13):
        node = tree.deep(depth)
        assert all((node[k] == node[k - 1]) == (leaves[k][:depth] == leaves[k - 1][:depth]) for k in range(1, len(leaves)))


def test_equal_hashes_of_different_passages(monkeypatch):
    found = substrings.Suffixes(13, [])
    found.add([" ".join(f"{p}{k}" for k in range(13)) for p in "abab"], [4, 3, 2, 1])
    found.close()
    found.path[:] = 7
    first, later = found.first_of_equal()
    assert first.all() and not later.any()

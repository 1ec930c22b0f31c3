"""BPE, URL rules, records, shards and mixing against plain Python."""

import base64
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyarrow import fs
from pyspark.sql import types as T
from tokenizers import Tokenizer

from millrace.llm import bpe, mixing, queries, records, scratch, sharding, urls
from millrace.llm.words import chunks

ODD = ["", " ", "a", "  two  spaces ", "tabs\t and\n\nlines \n x", "it's 'll 've\u00a0nbsp \u3000wide", "日本語 テキスト 123", "\x1c odd \x1f ctl", "<|endoftext|> x", "é" * 50, "a" * 30_000, " " * 30_000 + "x", "x" + "\n" * 25_000 + "y  ", "\t" * 20_000]
SCHEMA = "doc_id long, text string, source string, ids string, size long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, "clash", 7) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.MULTILINGUAL, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chunks_join_to_the_text():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b1", " ", " ", "\n", "'s", "!", "\u00a0"]) for _ in range(rng.randint(0, 30)))
        assert "".join(chunks(text)) == text


def test_bpe_as_the_library(spark, library):
    rng = random.Random(2)
    texts = [*ODD, *["".join(rng.choice(["a", "bc", " ", "  ", "\n", "'s", "!", "é", "9", "\u00a0", "\x1d"]) for _ in range(60)) for _ in range(200)]]
    rows = bpe.encode(documents(spark, [*texts, None]), queries.MULTILINGUAL, P.PATTERN, decoded="decoded").collect()
    for row in rows:
        text = row.text or ""
        assert bytes(row.decoded) == text.encode()
        assert row.ids == library.encode_ordinary(text), text[:40]
        assert row.source is None and row.size == 7


def test_very_long_white_space(library):
    codec = bpe.Codec.load(queries.MULTILINGUAL, P.PATTERN)
    for text in (" " * 2_000_000 + "x", "a" + "\n" * 1_500_000, " \n" * 800_000 + " b c"):
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert codec.decode(ids) == text.encode()


def test_decode_raw_bytes(spark):
    df = spark.createDataFrame([([200, 201],), ([],), (None,)], "ids array<int>")
    codec = bpe.Codec.load(queries.MULTILINGUAL, P.PATTERN)
    got = [r.decoded for r in bpe.decode(df, queries.MULTILINGUAL, P.PATTERN).collect()]
    assert [None if x is None else bytes(x) for x in got] == [codec.tokens[200] + codec.tokens[201], b"", None]


def test_bpe_digests(spark, library):
    df = documents(spark, ["one two", None])
    rows = {r.doc_id: r for r in bpe.digests(bpe.encode(df, queries.MULTILINGUAL, P.PATTERN, decoded="decoded")).collect()}
    ids = library.encode_ordinary("one two")
    assert (rows[0].n_tokens, rows[0].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert rows[1].n_tokens == 0 and rows[1].decoded_sha256 == hashlib.sha256(b"").hexdigest() == rows[1].ids_sha256


def test_empty_tables(spark):
    empty = documents(spark, []).limit(0)
    assert bpe.encode(empty, queries.MULTILINGUAL, P.PATTERN).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.assign(empty, 24).count() == 0
    manifest = records.write(empty, queries.ENGLISH, 2, scratch.folder(spark, "records"))
    assert records.read(spark, manifest).count() == 0
    assert urls.judge(spark.createDataFrame([], "url string"), queries.URL_RULES).count() == 0


def test_url_rules(spark):
    given = ["http://A.Example.COM/en/71?x", "https://example.com/en/6", "http://x.net/de/", "http://example.net/de/8#a", "http://xexample.com/en/7", "http://com/en/", "ftp://u.org/es", "a.org/es/", None, "://", "http://é.org/es/\nb", "http://com?/en/", "http://.com/en/", "x://y://com/en/"]
    rows = urls.judge(spark.createDataFrame([(i, u, "c", "r") for i, u in enumerate(given)], "page_id long, url string, host string, rule string"), queries.URL_RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[1] == ("example.com", "/en/6", "com/en/", "block")
    assert got[3][2:] == ("example.net/de/8", "block")
    assert got[4][2:] == ("com/en/", "block")
    assert got[5] == ("com", "/en/", "com/en/", "block")
    assert got[6] == ("u.org", "/es", None, "allow")
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[10][:3] == ("é.org", "/es/\nb", "org/es/")
    assert got[11][1:3] == ("", None)
    assert got[12][2] == "com/en/"
    assert got[13][:2] == ("y:", "//com/en/")


def plain_url_rule(url, rules):
    """host, path, rule and verdict of one URL, rule by rule."""
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3 :]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:end]), re.split("[?#]", rest[end:])[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_url_rules_by_brute_force(spark):
    rng = random.Random(8)
    part = lambda: rng.choice(["a", "b", "ab", "é", ""])
    rules = [(".".join(rng.choice(["a", "b", "ab", "é"]) for _ in range(rng.randint(1, 3))), "/" + part() + rng.choice(["", "/", "b"]), rng.choice(["block", "allow"])) for _ in range(60)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls_ = [rng.choice(["http://", "x:", "", "s://"]) + ".".join(part().upper() for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "/a/b", "/ab", "/b?q", "#f", "/é/é"]) for _ in range(600)] + [None, "", "http://" + "a." * 3000 + "b/" + "a" * 50_000]
    got = urls.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls_)], "page_id long, url string").repartition(3), rules).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain_url_rule(u, rules) for i, u in enumerate(urls_)}
    # Equal length: the longer host wins. The same key twice: the last one counts. No rules: the default.
    tie = [("a.b", "/", "block"), ("b", "/xy", "allow"), ("b", "/xy", "block"), ("a.b", "/x", "allow"), ("b", "/xyz", "block")]
    one = spark.createDataFrame([("h://a.b/xyz", "mine", "dot")], "url string, _found string, `a.b` string")
    assert [(r.rule, r.verdict, r._found, r["a.b"]) for r in urls.judge(one, tie).collect()] == [("a.b/x", "allow", "mine", "dot")]
    assert [r.rule for r in urls.judge(one, tie[:3]).collect()] == ["a.b/"]
    assert [r.verdict for r in urls.judge(one, tie[1:3]).collect()] == ["block"]
    assert [(r.rule, r.verdict) for r in urls.judge(one, []).collect()] == [(None, "allow")]


def test_url_index_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda s: 5)
    (tmp_path / "i").write_bytes(urls.index_bytes([("a.com", "/x", "block"), ("b.com", "/x", "allow"), ("c.com", "/", "block")]))
    index = urls.Index(str(tmp_path / "i"))
    assert index.probe(["b.com", "q.a.com", "d.com"], ["/xy", "/x", "/x"]) == (["b.com/x", "a.com/x", None], ["allow", "block", None])


def test_records_round_trip(spark):
    texts = [*ODD, None, "same", "same"]
    df = documents(spark, texts).union(spark.createDataFrame([(None, "no key", None, "", 0), (3, "tie", None, "", 0)], SCHEMA))
    to = scratch.folder(spark, "records")
    manifest = records.write(df.repartition(3), queries.ENGLISH, 2, to)
    rows = sorted(records.read(spark, manifest).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(queries.ENGLISH)
    tokenizer.encode_special_tokens = True
    want = sorted([(-1 if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect()])
    at = 0
    for row, (key, text) in zip(rows, want, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert (-1 if row.key is None else row.key, row.start, row.n_tokens) == (key, at, len(ids))
        assert bytes(row.ids) == np.array(ids, "<u4").tobytes()
        at += len(ids)


def test_record_damage_is_found():
    payload = records.struct.pack(records._PAYLOAD, 0, 9, 1) + b"\1\0"
    length = records.struct.pack("<Q", len(payload))
    whole = length + records.struct.pack("<I", records.masked(length)) + payload + records.struct.pack("<I", records.masked(payload))
    assert records.parse(whole, 2) == (0, 9, 1, b"\1\0")
    for i in range(len(whole)):
        with pytest.raises(ValueError):
            records.parse(whole[:i] + bytes([whole[i] ^ 1]) + whole[i + 1 :], 2)


def test_shards(spark):
    texts = [None, "", "é", *["same"] * 5, *[f"t{i}" for i in range(6000)]]
    df = documents(spark, texts).union(spark.createDataFrame([(None, "x", None, "", 0)] * 3 + [(4, "again", None, "", 0)], SCHEMA))
    rows = sharding.assign(df, 24).collect()
    assert len(rows) == len(texts) + 4
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].size == 8 and by_id[0].text_crc32 == 0
    assert by_id[2].size == 10 and by_id[2].text_crc32 == zlib.crc32("é".encode())
    for s in range(24):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own))) and 170 < len(own) < 330
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    assert 150 < sum(r.grown_shard == 24 for r in rows) < 350
    assert len({r.shard for r in rows if r.doc_id == 4}) == 1


def spark_hash(data, seed):
    found = xxhash.xxh64_intdigest(data, seed % (1 << 64))
    return found - (1 << 64) * (found >> 63)


def descended(key, tree):
    """The shard of a key by the plain law: at every level the least draw wins."""

    def best(children):
        draws = []
        for number, name, weight in children:
            h = spark_hash(name.encode(), 42)
            h = spark_hash((key % (1 << 64)).to_bytes(8, "little"), h) if key is not None else h
            u = (((h % (1 << 64)) >> 12) + 0.5) / 2**52
            draws.append((-math.log(u) / weight, number))
        return min(draws)[1]

    weight = lambda rack: sum(w for _, w in rack)
    r = best([(r, f"region {r}", sum(map(weight, racks))) for r, racks in enumerate(tree)])
    k = best([(k, f"rack {r}.{k}", weight(rack)) for k, rack in enumerate(tree[r])])
    return best([(s, f"shard {s}", w) for s, w in tree[r][k]])


def test_shards_by_brute_force(spark):
    rows = [(i, t) for i in [None, -5, *range(400)] for t in ([None, "a", "a"] if i in (None, 7) else [f"t{i}"])]
    got = sharding.assign(documents(spark, []).union(spark.createDataFrame([(i, t, None, "", 0) for i, t in rows], SCHEMA)), 24).collect()
    base = sharding.tree(24)
    assert len(got) == len(rows)
    assert all(r.shard == descended(r.doc_id, base) and r.grown_shard == descended(r.doc_id, sharding.grow(base)) for r in got)


def test_slots_do_not_depend_on_the_order(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 50)
    rows = [(1 if i % 3 else None, f"t{i % 40}" if i % 5 else None, None, "", 0) for i in range(600)]
    random.Random(5).shuffle(rows)
    runs = [sorted(map(str, sharding.assign(spark.createDataFrame(rows[::step], SCHEMA).repartition(parts), 24).collect())) for step, parts in ((1, 1), (-1, 5))]
    assert runs[0] == runs[1] and len(runs[0]) == 600
    for s in {r.split("shard=")[1].split(",")[0] for r in runs[0]}:
        own = sorted(int(r.split("slot=")[1].split(",")[0]) for r in runs[0] if f" shard={s}," in r)
        assert own == list(range(len(own)))


def test_weights_move_only_into_their_subtree(spark):
    base = sharding.tree(24)
    heavier = [[list(rack) for rack in region] for region in base]
    heavier[1][2][3] = (heavier[1][2][3][0], 3.0)
    moved = spark.range(5000).select(sharding.shard(sharding.F.col("id"), base).alias("a"), sharding.shard(sharding.F.col("id"), heavier).alias("b")).collect()
    subtree = {s for rack in heavier[1] for s, _ in rack}
    assert all(r.a == r.b or r.b in subtree for r in moved) and any(r.a != r.b for r in moved)


def test_mixing_by_hand(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(0, 30)) if i % 50 else None, rng.choice(["a", "a", "a", "b", "ç", "z", None]), "", 0) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    source = {r[0]: r[2] for r in rows}
    names = ["a", "b", "z", "ç", None]
    totals = {n: sum(size[i] for i in size if source[i] == n) for n in names}
    weight = {n: 1 + k % 3 for k, n in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(totals.values()))
    while True:
        over = [n for n in open_ if left * weight[n] / sum(weight[m] for m in open_) > 3 * totals[n]]
        if not over:
            break
        for n in over:
            target[n] = 3.0 * totals[n]
        open_ -= set(over)
        left = sum(totals.values()) - sum(target.values())
    target |= {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
    assert {r.source: r.source_size for r in got} == totals
    for r in got:
        assert r.size == size[r.doc_id] and abs(r.target - target[r.source]) < 1e-6 and r.taken <= 3 * r.size
    for n in names:
        taken = sum(r.taken for r in got if r.source == n)
        assert abs(taken - target[n]) <= 15 + 1e-6
    assert sorted(got) == sorted(mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())


def test_mixing_without_words(spark):
    rows = mixing.mix(documents(spark, [None, "", " \n"])).collect()
    assert all((r.size, r.target, r.taken) == (0, 0.0, 0) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    folder = "/root/testdata/sf0.001"
    frame = queries.QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    with duckdb.connect() as con:
        for t in ("documents", "pages", "embeddings", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in frame.collect())


def test_files_have_no_temporary_names(spark):
    to = scratch.folder(spark, "records")
    records.write(documents(spark, ["a", "b"]), queries.ENGLISH, 2, to).collect()
    store, base = fs.FileSystem.from_uri(to)
    assert all(not x.base_name.startswith(".") for x in store.get_file_info(fs.FileSelector(base)))


def test_records_are_read_by_one_task_a_file(spark):
    df = documents(spark, [f"text {i}" for i in range(400)]).repartition(7)
    to = scratch.folder(spark, "records")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = records.write(df, queries.ENGLISH, 2, to)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1
    assert records.read(spark, manifest).rdd.getNumPartitions() == manifest.count()


def test_a_second_attempt_leaves_the_same_files(spark):
    df = documents(spark, [f"text {i}" for i in range(50)])
    to = scratch.folder(spark, "records")
    store, base = fs.FileSystem.from_uri(to)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/.000000-dead.rec") as f:  # what a lost attempt has left
        f.write(b"half a record")
    first = [tuple(r) for r in records.read(spark, records.write(df, queries.ENGLISH, 2, to)).collect()]
    assert first == [tuple(r) for r in records.read(spark, records.write(df, queries.ENGLISH, 2, to)).collect()]
    assert all(not x.base_name.startswith(".") for x in store.get_file_info(fs.FileSelector(base)))


@pytest.mark.parametrize("name", ["op1_bpe", "op6_records"])
def test_queries_against_the_libraries(spark, library, name):
    folder = "/root/testdata/sf0.001"
    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = sorted(queries.QUERIES[name](spark, folder).collect())
    if name == "op1_bpe":
        ids = {i: library.encode_ordinary(t) for i, t in texts}
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert [tuple(r) for r in got] == [(i, len(ids[i]), sha(",".join(map(str, ids[i])).encode()), sha(t.encode())) for i, t in texts]
    else:
        tokenizer, at = Tokenizer.from_file(queries.ENGLISH), 0
        for r, (i, t) in zip(got, texts, strict=True):
            ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
            assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)


def test_encoder_against_the_library_on_odd_texts():
    rng = random.Random(5)
    signs = [*"ab'stéß×\n\n  \t\r\x0b  .,!&<>|12٣中ʼ́_", "<|endoftext|>", "don't", "it's", "\r\n", "\n\n", "'ll"]
    texts = ["", "\n", " ", "\nfoo", "foo\n", "a\nb", " \n", "a.\nb,\n\nc", *("".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(5000))]
    encoder = records.Encoder(queries.ENGLISH)
    for start in range(0, len(texts), 500):
        some = texts[start : start + 500]
        expected = [np.array(x.ids, "<u2").tobytes() for x in encoder.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert encoder.encode(some) == expected


def test_encoding_leaves_nothing_with_the_worker():
    """Python workers live on: what a task remembers would stand beside the next operator's memory."""

    class Frame:
        schema = T.StructType([T.StructField("text", T.StringType())])

        def mapInArrow(self, run, schema):
            return run

    run = bpe.encode(Frame(), queries.MULTILINGUAL, P.PATTERN)
    (made,) = run(iter([pa.RecordBatch.from_pydict({"text": ["some words", None]})]))
    assert made.column("ids").to_pylist()[0] and made.column("ids").to_pylist()[1] == []
    assert not bpe.Codec.load(queries.MULTILINGUAL, P.PATTERN).seen

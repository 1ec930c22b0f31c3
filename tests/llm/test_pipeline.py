"""The pipeline's stages against plain Python."""

import base64
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from test_duplicates import near, removed

from millrace.llm import queries, scratch

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    rows = {"": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, FOLDER), "stage")
        rows[name] = docs.collect()
        if name != "bpe encoding":
            assert docs.columns == columns
    kept = {r.doc_id for r in queries.op8_quality(spark, FOLDER).collect() if r.kept}
    good = rows["quality rules"]
    assert {r.doc_id for r in good} == kept and len(good) == len(kept)
    unique = rows["minhash near-dedup"]
    want = {i for i, _, c in near([(r.doc_id, r.text) for r in good], percent=80) if i == c}
    assert {r.doc_id for r in unique} == want and len(unique) == len(want)
    cut = {r.doc_id: r for r in rows["substring dedup"]}
    before = {r.doc_id: r for r in unique}
    for i, _, n_removed, text in removed([(r.doc_id, r.text) for r in unique]):
        assert cut[i].text == (text if n_removed else before[i].text)
        assert cut[i].n_chars == (len(text) if n_removed else before[i].n_chars)
    words = lambda rs: Counter({s: sum(len((r.text or "").encode().split()) for r in rs if r.source == s) for s in {r.source for r in rs}})
    mixed = rows["mixing sources"]
    assert {r.doc_id for r in mixed} <= set(cut) and max(Counter(r.doc_id for r in mixed).values()) <= 3
    assert all(r.text == cut[r.doc_id].text for r in mixed)
    total = sum(words(list(cut.values())).values())
    assert 0.7 * total <= sum(words(mixed).values()) <= total
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.MULTILINGUAL, "rb"))}
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r.doc_id, r.ids) for r in rows["bpe encoding"]) == sorted((r.doc_id, library.encode_ordinary(r.text)) for r in mixed)


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, FOLDER), "stage")
        assert docs.count() == 0


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "src0", 0), (3, "word " * 5, "en", "src0", 25), (3, "word " * 5, "en", "src0", 25), (4, " ".join(f"w{k}" for k in range(30_000)), "en", "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, FOLDER).collect()
        assert name == "quality rules" or any(r.doc_id == 4 for r in got)


def test_names_that_meet_the_stages_own(spark):
    """Columns of any name keep their values through the stages that return the columns of documents."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = ["kept", "n_words", "n_removed", "_row", "_copies", "_quality_kept", "_cut_kept", "_gone", "same", "id", "key", "row", "a.b", "score"]
    for n in names:
        docs = docs.withColumn(n, corpus_pipeline.F.concat(corpus_pipeline.F.lit(f"{n} of "), corpus_pipeline.F.col("doc_id").cast("string")))
    columns, cut = docs.columns, 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == columns
        rows = docs.collect()
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names), name

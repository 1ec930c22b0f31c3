"""The pipeline's near-dedup stage links from a similarity of 0.8 up."""

import corpus_pipeline
from test_duplicates import shingle_set

FOLDER = "/root/testdata/sf0.001"


def test_near_dedup_links_from_four_fifths(spark):
    words = [f"n{k}" for k in range(104)]  # 100 shingles; the copy shares 90 of 110
    low = [f"l{k}" for k in range(104)]  # the copy shares 88 of 112
    made = [(1, " ".join(words)), (2, " ".join([*words[:94], *(f"x{k}" for k in range(10))])), (3, " ".join(low)), (4, " ".join([*low[:92], *(f"y{k}" for k in range(12))]))]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()} == {1, 3, 4}


def test_near_dedup_by_brute_force_at_four_fifths(spark):
    docs = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    sets = [(r.doc_id, shingle_set(r.text)) for r in docs.collect()]
    least = {i: i for i, _ in sets}
    links = [(i, j) for a, (i, x) in enumerate(sets) for j, y in sets[:a] if x and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in sets:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()} == {i for i, k in least.items() if i == k}

"""No piece of letters is left out of the segmentations."""

import math

import numpy as np

from millrace.llm import languages, queries


def test_all_pieces_of_letters_are_in_the_lattice():
    names = [x for x in languages.pieces(queries.PIECES) if x.replace(languages.MARK, "").isalpha() and languages.MARK not in x[1:]]
    lattice = languages.Lattice(names)
    assert lattice.size == len(set(names)) and max(map(len, names)) == lattice.longest
    assert languages.Lattice(languages.pieces(queries.PIECES)).size >= lattice.size


def test_a_long_piece_counts():
    names = [languages.MARK, "information"]
    lattice = languages.Lattice(names)
    got = languages.log_probabilities(lattice, np.array([[0.5], [0.25], [0.0]]), ["information"])[0, 0]
    assert math.isclose(got, math.log(0.5 * (0.25 + languages.UNKNOWN**11)), rel_tol=1e-9)


def by_enumeration(names, p, text):
    """The sum over all segmentations, exactly, in whole texts."""
    sums = [1.0] + [0.0] * len(text)
    for i in range(1, len(text) + 1):
        for k in range(i):
            if text[k:i] in names:
                sums[i] += sums[k] * p[names.index(text[k:i])]
            elif i - k == 1:
                sums[i] += sums[k] * languages.UNKNOWN
    return sums[-1]


def test_long_words_are_not_cut():
    names = [languages.MARK, "a", "b", "ab", "ba", "abab", languages.MARK + "ab"]
    p = np.array([[0.2], [0.2], [0.1], [0.2], [0.1], [0.1], [0.1], [0.0]])
    lattice = languages.Lattice(names)
    for word in ("ab" * 16, "abba" * 9 + "b", "a" * 23, "a" * 24, "abz" * 11):
        got = languages.log_probabilities(lattice, p, [word])[0, 0]
        assert math.isclose(got, math.log(by_enumeration(names, p[:, 0], languages.MARK + word)), rel_tol=1e-9)
    # A piece over character 24 counts, and so does every character of a very long word.
    one = languages.log_probabilities(lattice, p, ["ab" * 20_000, "ab" * 20_001])[:, 0]
    assert np.isfinite(one).all() and one[1] < one[0]


def test_expected_counts_of_long_words():
    names = [languages.MARK, "a", "ab", "b"]
    p = np.array([[0.4], [0.2], [0.2], [0.2], [0.0]])
    lattice = languages.Lattice(names)
    short = languages.expectations(lattice, p, ["ab" * 6], np.array([2.0]))
    long = languages.expectations(lattice, p, ["ab" * 30], np.array([2.0]))
    assert math.isclose(short[0], 2) and math.isclose(long[0], 2)
    assert np.allclose(short[1:] / 6, long[1:] / 30)


def test_prediction_by_brute_force(spark, monkeypatch):
    """Counts, expectation maximisation, sums over all segmentations and posterior in plain Python."""
    names = [languages.MARK, "d", "e", "r", "t", "h", "th", "the", "der", "er", languages.MARK + "the"]
    monkeypatch.setattr(languages, "_LATTICES", {})
    lattice = languages.Lattice(names)
    monkeypatch.setattr(languages.Lattice, "of", staticmethod(lambda vocabulary: lattice))
    given = [("the the her", "en"), ("ther", "en"), ("der der erd", "de"), ("", "de"), (None, "de"), ("x", None)]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(given)], "doc_id long, text string, lang string").repartition(3)
    counted = languages.scratch.table(languages._sample(df.select(languages.F.col("doc_id").alias("key"), "text", "lang").filter("lang is not null"), df.groupBy("lang").agg(languages.F.count("*").alias("n"))), "words")
    assert {(r.lang, r.word, r.n) for r in counted.collect()} == {("en", "the", 2), ("en", "her", 1), ("en", "ther", 1), ("de", "der", 2), ("de", "erd", 1)}
    models = {}
    for lang, words in (("en", {"the": 2, "her": 1, "ther": 1}), ("de", {"der": 2, "erd": 1})):
        p = [1 / len(names)] * len(names)
        for _ in range(languages.ROUNDS):
            expected = [0.0] * len(names)
            for word, n in words.items():
                paths = list(segmentations(names, languages.MARK + word))
                weight = [math.prod(languages.UNKNOWN if x is None else p[x] for x in path) for path in paths]
                for path, w in zip(paths, weight, strict=True):
                    for x in path:
                        if x is not None:
                            expected[x] += n * w / sum(weight)
            p = [(e + languages.SMOOTHING) / (sum(expected) + languages.SMOOTHING * len(names)) for e in expected]
        models[lang] = p
    trained = {lang: languages.fit(lattice, words) for lang, words in (("en", {"the": 2.0, "her": 1.0, "ther": 1.0}), ("de", {"der": 2.0, "erd": 1.0}))}
    for lang in models:
        assert np.allclose(trained[lang][:-1, 0], models[lang])
    scorer = languages.Scorer(languages.Model("any", trained, {"en": 2, "de": 3}))
    for text in ("the erd", "der", "her her", "quer"):
        logs = {x: math.log({"en": 2, "de": 3}[x] / 5) + sum(math.log(by_enumeration(names, models[x], languages.MARK + w)) for w in text.split()) for x in models}
        best = max(sorted(logs), key=logs.get)
        found, score = scorer.predict([text])
        assert found == [best] and math.isclose(score[0], 1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel_tol=1e-6)


def segmentations(names, text):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        if text[:k] in names or k == 1:
            for rest in segmentations(names, text[k:]):
                yield [names.index(text[:k]) if text[:k] in names else None, *rest]

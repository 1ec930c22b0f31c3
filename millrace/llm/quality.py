"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

The n-grams are all words and all pairs of neighbouring words, hashed into BUCKETS. Multinomials are
counted over the trusted documents (those labelled with quality 1) and over all documents, smoothed by one in every
bucket; a document's score is the mean over its n-grams of log p_trusted - log p_raw. Counts cover all
documents and are collected as one row for each bucket.

The threshold follows from the counts. Trusted documents fall into two halves by a hash of their id; each half
is scored, from its bucket counts alone, by the ratios of the other, which gives the mean and the standard deviation of an
n-gram that the model has not seen. A document is kept if it passes the base rules and its score is no more than SIGMAS
standard errors below that mean, where the standard error is that of the shortest document that passes them (2 * MIN_WORDS - 1
n-grams). The same threshold holds for all documents.

Null and empty texts have no words, and fail the base rules. Without trusted documents, or with trusted ones in one half
only, there is no ratio, and the base rules alone decide. Labels may repeat; a document is trusted if any of its labels says so.
Rows repeat as they come, equal scores are judged alike, a null doc_id has no label, and an empty table gives an empty
one. All columns of the input pass through, whatever their names, but for those that the result's own replace.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.names import column, packed, unpacked
from millrace.llm.words import words_column

BITS = 16
BUCKETS = 1 << BITS
SIGMAS = 2.0
MIN_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
#: Labelled documents whose ids may be broadcast (some 60 bytes each in memory); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


@dataclass
class Ratios:
    """The log ratio of every bucket, and the score from which documents are kept."""

    table: list[float]
    threshold: float


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions may read many times; a generator keeps the optimizer from
    putting its expression in each of their places."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _chained(left: Column, right: Column, skip: int) -> Column:
    """A hash of every element of ``left`` with the element of ``right`` that is ``skip`` places further on."""
    n = F.greatest(F.size(right) - skip, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1 + skip), n), lambda x, y: F.xxhash64(x, y))


def _bucket(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(BUCKETS - 1).cast("long"))


def fitted(raw: list[int], halves: tuple[list[int], list[int]]) -> Ratios | None:
    """Ratios and threshold from the counts of all documents and of the trusted ones' halves."""
    if not all(map(sum, halves)):
        return None

    def smooth(counts: list[int]) -> list[float]:
        total = sum(counts) + BUCKETS
        return [math.log((n + 1) / total) for n in counts]

    def ratios(good: list[int]) -> list[float]:
        return [g - r for g, r in zip(smooth(good), smooth(raw), strict=True)]

    total = seen = squares = 0.0
    for model, other in (halves, halves[::-1]):
        for ratio, n in zip(ratios(model), other, strict=True):
            seen += n
            total += n * ratio
            squares += n * ratio * ratio
    mean = total / seen
    spread = math.sqrt(max(0.0, squares / seen - mean * mean))
    return Ratios(ratios([a + b for a, b in zip(*halves, strict=True)]), mean - SIGMAS * spread / math.sqrt(2 * MIN_WORDS - 1))


def log_ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> Ratios | None:
    """Count both multinomials. ``trusted`` has ids in the column ``id``."""
    ids = trusted.select(F.col("id").alias("_id")).dropna().distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    marked = docs.select(column(key).alias("_key"), column(text).cast("string").alias("_text")).join(ids, F.col("_key") == F.col("_id"), "left")
    half = F.when(F.col("_id").isNotNull(), F.pmod(F.xxhash64(F.col("_key").cast("string")), F.lit(2)))
    held = _held(marked.select(half.alias("_half"), words_column(F.col("_text")).alias("_w")), "_h", _hashes(F.col("_w"))).select("_half", "_h")
    grams = held.select("_half", F.explode(F.concat("_h", _chained(F.col("_h"), F.col("_h"), 1))).alias("_g"))
    counted = grams.groupBy(_bucket(F.col("_g")).alias("bucket")).agg(F.count("*").alias("raw"), *[F.count(F.when(F.col("_half") == k, 1)).alias(f"half{k}") for k in (0, 1)])
    raw, halves = [0] * BUCKETS, ([0] * BUCKETS, [0] * BUCKETS)
    for row in counted.collect():  # one row for each bucket
        raw[row.bucket], halves[0][row.bucket], halves[1][row.bucket] = row.raw, row.half0, row.half1
    return fitted(raw, halves)


def judge(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept to every row,
    with ``prefix`` before their names; columns of the same name are replaced."""
    ratios = log_ratios(docs, trusted, key, text)
    names = [c for c in docs.columns if c not in {prefix + x for x in OWN}]
    held = docs.select(packed(names).alias("_row"), F.coalesce(column(text).cast("string"), F.lit("")).alias("_t"))
    t = F.col("_t")
    held = _held(held, "_w", words_column(t))
    held = _held(held, "_h", _hashes(F.col("_w")))
    n = F.size("_h")
    held = _held(held, "_p", _chained(F.col("_h"), F.col("_h"), 1))
    held = _held(held, "_3", _chained(F.col("_p"), F.col("_h"), 2))
    # Only texts with a repeated window are sorted.
    pairs = F.sort_array(F.transform("_3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    held = _held(held, "_s", F.when(F.size(F.array_distinct("_3")) < F.size("_3"), pairs))
    twice = F.filter("_s", lambda x, k: F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce((k > 0) & (F.get("_s", F.greatest(k - 1, F.lit(0)))["h"] == x["h"]), F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    repeated = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    held = _held(held, "_l", F.when(F.contains(t, F.lit("\n")), lines))
    if ratios is None:
        score = F.lit(None).cast("double")
    else:
        table = F.split(F.lit(",".join(map(repr, ratios.table))), ",").cast("array<double>")  # one literal
        total = lambda grams: F.aggregate(grams, F.lit(0.0), lambda a, g: a + table[_bucket(g)])
        score = F.when(n > 0, (total("_h") + total("_p")) / (n + F.size("_p")))
    columns = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate(t, _BLANKS, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.coalesce(F.size("_l") - F.size(F.array_distinct("_l")), F.lit(0)).cast("long"),
        "n_repeat_words": F.coalesce(repeated, F.lit(0)).cast("long"),
        "score": score,
    }
    made = held.select("_row", *[c.alias(f"_{k}") for k, c in columns.items()])
    failed = (F.col("_n_words") < MIN_WORDS) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * MOST_REPEATED)
    made = made.withColumn("_base_failed", failed)
    likely = F.coalesce(F.col("_score") >= F.lit(ratios.threshold if ratios else 0.0), F.lit(True))
    made = made.withColumn("_kept", ~F.col("_base_failed") & likely)
    return made.select(*unpacked("_row", names), *[F.col(f"_{x}").alias(prefix + x) for x in OWN])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids labelled with quality 1."""
    return labels.filter("quality = 1").select(F.col("doc_id").alias("id"))

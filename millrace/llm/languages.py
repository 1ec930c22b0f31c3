"""Language identification by unigrams over pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary; only their probabilities are learned, one set
for each language. The probability of a word is the sum over all ways to cut it into pieces of the product of
the pieces' probabilities, which the forward algorithm gives in one pass; a text's is the product over
its words. Probabilities are fitted by expectation maximisation over the forward and backward sums, and
texts get the language of the highest posterior.

Words are runs of letters, lower-cased, with the vocabulary's word mark before them, whole however long they are. All pieces
that can lie in such a word are used. A character that is no piece has a small fixed probability in every language.

The fit takes a bounded sample: about DOCUMENTS documents of each language, chosen by a hash of the key, with all the
words of their whole texts. The words stay in a table; a round adds up expected counts where they are, and the driver
holds one number for each piece and language. Prediction scores all words of every whole text.

Texts that are null, empty or have no letter give ``und`` with a score of 0, and so does everything if nothing can be learned
from; an empty table gives an empty one. Null languages are not learned, null keys are documents like others. Equal
posteriors go to the language that is first by code point. Repeated rows repeat, and are learned from as often; other columns
pass through, but for lang_pred and score, which are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import scratch
from millrace.llm.arrow import slices
from millrace.llm.names import column

DOCUMENTS, ROUNDS = 1500, 4
#: Characters up to which words of one length are scored together; longer ones are scored one by one, in logarithms.
SHORT = 24
UNKNOWN, SMOOTHING = 1e-7, 0.05
#: Words that a worker remembers; then it starts again.
CACHE_WORDS = 1_000_000
#: Expected counts are added up as whole numbers of this part, so that their order does not matter.
PART = float(1 << 24)
MARK = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xBF58476D1CE4E5B9
_READY: dict[str, Scorer] = {}
_LATTICES: dict[str, Lattice] = {}


def words(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def pieces(vocabulary: str) -> list[str]:
    """The text pieces of a sentencepiece model."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


class Lattice:
    """Looks up all substrings of many words among the pieces."""

    def __init__(self, names: list[str]):
        # What holds anything but letters after a mark lies in no word.
        names = [x for x in dict.fromkeys(names) if x == MARK or _LETTERS.fullmatch(x.removeprefix(MARK))]
        self.size = len(names)
        self.longest = max(map(len, names), default=1)
        self.powers = np.array([pow(_BASE, k, 1 << 64) for k in range(max(SHORT, self.longest) + 2)], np.uint64)
        hashes = np.array([self._hash(x) for x in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)
        # A first look by the top bits leaves few candidates, so most probes touch one entry.
        self.shift = np.uint64(44)
        self.first = np.searchsorted(self.hashes, np.arange(1 << 20, dtype=np.uint64) << self.shift).astype(np.int32)
        top = (self.hashes >> self.shift).astype(np.int64)
        self.deep = int(np.bincount(top).max()) if len(top) else 0

    @staticmethod
    def of(vocabulary: str) -> Lattice:
        """The worker's lattice of a vocabulary file."""
        if vocabulary not in _LATTICES:
            _LATTICES[vocabulary] = Lattice(pieces(vocabulary))
        return _LATTICES[vocabulary]

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + (ord(c) + 1) * _STEP) & (2**64 - 1)
        return h

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The piece of every hash, or the number of pieces where there is none."""
        at = self.first[(wanted >> self.shift).astype(np.int64)]
        out = np.full(len(wanted), self.size, np.int32)
        for k in range(self.deep):
            j = np.minimum(at + k, len(self.hashes) - 1)
            same = self.hashes[j] == wanted
            out[same] = self.ids[j[same]]
        return out

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return (np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP)

    def arcs(self, group: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length: (start, end) -> the piece of every word there."""
        n = len(group[0])
        codes = self._codes("".join(group)).reshape(len(group), n)
        prefix = np.zeros((n + 1, len(group)), np.uint64)
        for i in range(n):
            prefix[i + 1] = prefix[i] * np.uint64(_BASE) + codes[:, i]
        return {(i - k, i): self.find(prefix[i] - prefix[i - k] * self.powers[k]) for i in range(1, n + 1) for k in range(1, min(i, self.longest) + 1)}

    def ending(self, word: str) -> np.ndarray:
        """For a long word: the piece of k + 1 characters that ends after character i, at (i, k)."""
        codes = self._codes(word)
        n = len(codes)
        out = np.full((n, self.longest), self.size, np.int32)
        own = np.zeros(n, np.uint64)
        for k in range(min(n, self.longest)):
            own[k:] = codes[: n - k] * self.powers[k] + own[k:]
            out[k:, k] = self.find(own[k:])
        return out


def forward(arcs: dict, n: int, count: int, p: np.ndarray, longest: int) -> np.ndarray:
    """The forward sums (position, word, language). p has a row more than pieces: 0, for what is none."""
    a = np.zeros((n + 1, count, p.shape[1]))
    a[0] = 1
    for i in range(1, n + 1):
        for k in range(1, min(i, longest) + 1):
            ids = arcs[i - k, i]
            if k == 1:
                a[i] += a[i - 1] * np.where((ids == len(p) - 1)[:, None], UNKNOWN, p[ids])
            else:
                hit = np.flatnonzero(ids < len(p) - 1)
                if len(hit):
                    a[i, hit] += a[i - k, hit] * p[ids[hit]]
    return a


def _steps(ids: np.ndarray, log_p: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every character of a long word: its place from 1, the lengths of the pieces that end there, their logs."""
    none = len(log_p) - 1
    for i, row in enumerate(ids, 1):
        k = np.flatnonzero(row < none)
        logs = log_p[row[k]]
        if row[0] == none:
            k, logs = np.r_[0, k], np.concatenate([np.full((1, log_p.shape[1]), np.log(UNKNOWN)), logs])
        yield i, k + 1, logs


def _add(logs: np.ndarray) -> np.ndarray:
    """The logarithm of the sum over the first axis."""
    top = logs.max(0)
    return top + np.log(np.exp(logs - top).sum(0))


def log_forward(lattice: Lattice, log_p: np.ndarray, word: str) -> np.ndarray:
    """The logarithms of the forward sums (position, language) of one word of any length."""
    a = np.zeros((len(word) + 1, log_p.shape[1]))
    for i, k, logs in _steps(lattice.ending(word), log_p):
        a[i] = _add(a[i - k] + logs)
    return a


def _logs(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p)


def _grouped(given: list[str]) -> tuple[dict[int, list[int]], list[int]]:
    """Places of the marked words by length, and those of the long ones."""
    groups: dict[int, list[int]] = {}
    for at, word in enumerate(given):
        groups.setdefault(len(word), []).append(at)
    long = [at for n in list(groups) if n > SHORT for at in groups.pop(n)]
    return groups, long


def log_probabilities(lattice: Lattice, p: np.ndarray, given: list[str]) -> np.ndarray:
    """The log probability of every word in every language."""
    marked = [MARK + w for w in given]
    out = np.zeros((len(given), p.shape[1]))
    groups, long = _grouped(marked)
    for n, at in groups.items():
        for start in range(0, len(at), 20_000):
            some = at[start : start + 20_000]
            out[some] = np.log(forward(lattice.arcs([marked[x] for x in some]), n, len(some), p, lattice.longest)[n])
    log_p = _logs(p) if long else p
    for at in long:
        out[at] = log_forward(lattice, log_p, marked[at])[-1]
    return out


def expectations(lattice: Lattice, p: np.ndarray, given: list[str], weights: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the weighted words, under the probabilities p of one language."""
    size = lattice.size
    marked = [MARK + w for w in given]
    expected = np.zeros(size + 1)
    groups, long = _grouped(marked)
    for n, at in groups.items():
        for start in range(0, len(at), 20_000):
            some = at[start : start + 20_000]
            arcs = lattice.arcs([marked[x] for x in some])
            a = forward(arcs, n, len(some), p, lattice.longest)[:, :, 0]
            b = np.zeros((n + 1, len(some)))
            b[n] = 1
            for i in range(n, 0, -1):
                for k in range(1, min(i, lattice.longest) + 1):
                    own = p[arcs[i - k, i], 0]
                    if k == 1:
                        own = np.where(arcs[i - 1, i] == size, UNKNOWN, own)
                    b[i - k] += own * b[i]
            scale = weights[some] / a[n]
            for (i, j), ids in arcs.items():
                hit = np.flatnonzero(ids < size)
                if len(hit):
                    expected += np.bincount(ids[hit], a[i, hit] * p[ids[hit], 0] * b[j, hit] * scale[hit], size + 1)
    log_p = _logs(p) if long else p
    for at in long:
        ids = lattice.ending(marked[at])
        a = log_forward(lattice, log_p, marked[at])[:, 0]
        b = np.full(len(a), -np.inf)
        b[-1] = 0
        for i, k, logs in reversed(list(_steps(ids, log_p))):
            b[i - k] = np.logaddexp(b[i - k], logs[:, 0] + b[i])
        for i, k, logs in _steps(ids, log_p):
            np.add.at(expected, ids[i - 1, k - 1], weights[at] * np.exp(a[i - k] + logs[:, 0] + b[i] - a[-1]))
    return expected[:size]


def improved(expected: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts, with a last row for what is no piece."""
    kept = expected + SMOOTHING
    return np.append(kept / kept.sum(), 0.0)[:, None]


def flat(size: int) -> np.ndarray:
    return np.append(np.full(size, 1 / max(1, size)), 0.0)[:, None]


def fit(lattice: Lattice, counts: dict[str, float]) -> np.ndarray:
    """Piece probabilities that make the counted words likely."""
    given, weights = list(counts), np.array(list(counts.values()), float)
    p = flat(lattice.size)
    for _ in range(ROUNDS):
        p = improved(expectations(lattice, p, given, weights))
    return p


class Model:
    """Languages, their priors, and the probabilities of the pieces in each."""

    def __init__(self, vocabulary: str, p: dict[str, np.ndarray], documents: dict[str, int]):
        self.vocabulary = vocabulary
        self.languages = sorted(p)
        self.p = np.concatenate([p[x] for x in self.languages], axis=1) if p else np.zeros((1, 0))
        self.prior = np.log(np.array([documents[x] for x in self.languages], float) / max(1, sum(documents[x] for x in self.languages)))


class Scorer:
    """A model in a worker, with the words that it has scored."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice.of(model.vocabulary)
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)))

    def add(self, new: list[str]) -> None:
        if not new:
            return
        scores = log_probabilities(self.lattice, self.model.p, new)
        scores[[not any(map(str.isalpha, w)) for w in new]] = 0  # numerals that are no digits
        start = len(self.index)
        while len(self.table) < start + len(new):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[start : start + len(new)] = scores
        self.index.update(zip(new, range(start, start + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words(x) for x in texts]
        if len(self.index) > CACHE_WORDS:
            self.index.clear()
        index = self.index
        if self.model.languages:
            self.add(list(dict.fromkeys(w for x in split for w in x if w not in index)))
        names, scores = [], []
        for text, x in zip(texts, split, strict=True):
            if not x or not self.model.languages or not any(map(str.isalpha, text)):
                names.append("und")
                scores.append(0.0)
                continue
            total = self.model.prior + self.table[[index[w] for w in x]].sum(0)
            best = int(np.argmax(total))
            names.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


def held_out(key: Column) -> Column:
    """Rows kept out of learning: crc32 of the key's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(df: DataFrame, documents: DataFrame) -> DataFrame:
    """(lang, word, n): the words of about DOCUMENTS documents of each language."""
    chosen = df.join(F.broadcast(documents), "lang").filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(float((1 << 20) * DOCUMENTS)) / F.col("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found: Counter = Counter()
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.update((name, w) for w in words(t))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return scratch.table(counted.sortWithinPartitions("lang", "word"), "words")


def _round(counted: DataFrame, vocabulary: str, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The probabilities after one more round."""
    shared = counted.sparkSession.sparkContext.broadcast(p)  # pieces x languages, whatever the input

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.of(vocabulary)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            given, n = batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(float)
            for name in dict.fromkeys(names.tolist()):
                some = np.flatnonzero(names == name)
                found = expectations(lattice, shared.value.get(name, flat(lattice.size)), [given[x] for x in some], n[some])
                total[name] = total.get(name, 0) + found
        for name, found in total.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(np.round(found[at] * PART).astype(np.int64))], ["lang", "piece", "n"])

    size = Lattice.of(vocabulary).size
    out: dict[str, np.ndarray] = {}
    for row in counted.mapInArrow(expect, "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
        out.setdefault(row.lang, np.zeros(size))[row.piece] = row.n / PART
    shared.destroy()
    return {name: improved(found) for name, found in out.items()}


def train(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit a model on the rows of ``df`` with a language."""
    rows = df.select(column(key).alias("key"), column(text).cast("string").alias("text"), column(lang).cast("string").alias("lang")).filter("lang is not null")
    documents = scratch.table(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    counted = _sample(rows, documents)
    p: dict[str, np.ndarray] = {}
    for _ in range(ROUNDS):
        p = _round(counted, vocabulary, p)
    scratch.drop(counted)
    return Model(vocabulary, p, {r.lang: r.n for r in documents.collect()})  # one row for each language


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row; columns of the same name are replaced."""
    kept = [f for f in df.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    shared = df.sparkSession.sparkContext.broadcast(model)  # pieces x languages, whatever the input
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ready(name, shared)
        for batch in slices(batches, text, 4 << 20):
            found, scores = scorer.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return df.mapInArrow(run, schema)


def ready(key: str, shared) -> Scorer:
    if key not in _READY:
        _READY.clear()
        _READY[key] = Scorer(shared.value)
    return _READY[key]

"""Repeated passages by prefix-partitioned suffix trees.

A passage is WINDOW consecutive words of one document. Words that a passage covers go if the passage also
starts in a document with a smaller doc_id.

1. A passage is filed under one suffix that starts in it, its anchor: of the places at which a prefix of the greatest
   length still fits into the passage, the one whose prefix has the least hash. Equal passages have equal anchors, and
   some five passages in a row share one, so they travel as one segment of text and not as one window each.
2. Anchors are counted by the hash of their first 1, 2 and 3 words. A segment belongs to its anchor's shortest prefix
   that has GROUP passages at most; passages without such a prefix are filed one by one by all their words. The driver
   gets the prefixes that have more.
3. Every FLUSH passages, a task keeps those with the least doc_id of equal ones (equal hashes are compared word by
   word), and sends each group the segments of those. The others already have a smaller doc_id in sight and do not go to the group, so a
   passage that stands in a third of all documents is one document's entry each time.
4. A group sorts the suffixes of its segments, takes the common prefixes of neighbours, and has with them the tree's
   internal nodes. Leaves below a node WINDOW words deep or more are repeats, unless they are of the least
   doc_id there. Repeats in a row are joined along their segment, and further along the document: its maximal repeats.
5. The maximal repeats, as places in a document, meet the documents in buckets of about BUCKET rows.

Null and empty texts have no words and lose none. Texts are read whole; words of over LONG bytes stand by a 256-bit
digest. Ties: rows with equal doc_id do not count as smaller, so repeated rows keep what they share, and lose
alike what smaller ones have. A null doc_id neither gives nor loses passages. An empty table gives an empty one. All
columns of the input pass through, whatever their names, but for those that the result's own three replace: n_words,
n_removed and kept, with ``prefix`` before them.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import scratch
from millrace.llm.arrow import release, slices
from millrace.llm.names import column, packed, unpacked
from millrace.llm.words import mix, window_hashes

WINDOW = 13
PREFIXES = (1, 2, 3)
#: Passages that a group of short prefixes may have (about 100 bytes each while they are sorted).
GROUP = 1_500_000
BUCKET = 400
CHUNK_BYTES = 4 << 20
#: Passages that a task gathers before it sends them on (about 80 bytes each while they are sorted).
FLUSH = 500_000
#: Bytes of a word that are kept as they are.
LONG = 64
#: Words that have the same number everywhere: the most frequent ones, and how often a word must be in one batch to be counted.
#: All others travel as they are, so this is only for size.
COMMON, OFTEN = 1 << 16, 4
#: Groups that take the places that need no tree.
DIRECT = 4096


class Suffixes:
    """Documents of some batches: words by number, and the places at which a passage starts."""

    def __init__(self, window: int, common: list[bytes]):
        self.window, self.reach = window, max(1, window - max(PREFIXES) + 1)
        self.common, self.names = pa.array(common, pa.large_binary()), common
        self.parts: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.tags: list[np.ndarray] = []
        self.seen: set[tuple[int, int]] = set()
        self.waiting = 0

    def add(self, texts: list[str | None], keys: list[int | None]) -> None:
        """Documents without a key have no passages, and rows with one key and text have the same places."""
        tags, repeated = [], set()
        for k, (text, key) in enumerate(zip(texts, keys, strict=True)):
            tags.append(0 if text is None or key is None else tag(text))
            if text is None or key is None or (key, tags[-1]) in self.seen:
                repeated.add(k)
            else:
                self.seen.add((key, tags[-1]))
        given = pa.array([None if k in repeated else t for k, t in enumerate(texts)], pa.large_string())
        # The six ASCII blanks are what cuts words; at the ends of a text they leave an empty one.
        split = pc.ascii_split_whitespace(pc.fill_null(given, ""))
        ends, values = split.offsets.to_numpy(), split.values.cast(pa.large_binary())
        real = pc.greater(pc.binary_length(values), 0)
        counts = np.diff(np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][ends])
        enough = np.repeat(counts >= self.window, np.diff(ends))
        values = values.filter(pc.and_(real, pa.array(enough)))
        counts = np.where(counts < self.window, 0, counts)
        self.waiting += int(np.maximum(counts - self.window + 1, 0).sum())
        self.parts.append(values)
        self.counts.append(np.array(counts, np.int64))
        self.keys.append(np.array([0 if k is None else k for k in keys], np.int64))
        self.tags.append(np.array(tags, np.uint64))

    def _number(self) -> None:
        """Number the words: common ones as they are numbered everywhere, the others in the order in which they come."""
        coded = pa.chunked_array(self.parts, pa.large_binary()).dictionary_encode()
        # Without a word there is no chunk, and no dictionary to combine.
        coded = coded.combine_chunks() if coded.num_chunks else pa.array([], pa.large_binary()).dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0)
        self.parts = []
        words = coded.dictionary
        long = np.flatnonzero(pc.binary_length(words).to_numpy() > LONG)
        if len(long):  # different words have different digests
            own = words.to_pylist()
            for k in long.tolist():
                own[k] = shortened(own[k])
            words = pa.array(own, pa.large_binary())
        numbers = pc.index_in(words, self.common).fill_null(-1).to_numpy().astype(np.int32)
        rare = np.flatnonzero(numbers < 0)
        numbers[rare] = len(self.names) + np.arange(len(rare), dtype=np.int32)
        self.names = self.names + words.take(pa.array(rare)).to_pylist()
        self.words = numbers[coded.indices.to_numpy()]

    def close(self, paths: bool = True) -> None:
        """Lay out what was added: for every passage its document, start, anchor and, if asked for, hash."""
        w = self.window
        self._number()
        counts = np.concatenate([*self.counts, np.empty(0, np.int64)])
        self.key = np.concatenate([*self.keys, np.empty(0, np.int64)])
        self.tag = np.concatenate([*self.tags, np.empty(0, np.uint64)])
        self.begin = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        n = max(0, len(self.words) - w + 1)
        self.start = np.flatnonzero(owner[:n] == owner[len(owner) - n :]) if n else np.empty(0, np.int64)
        self.document = owner[self.start]
        own = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, self.names)), ">u8").astype(np.uint64)
        self.hashes = own[self.words] if len(self.words) else np.empty(0, np.uint64)
        self.path = window_hashes(self.hashes, w)[self.start] if n and paths else np.empty(0, np.uint64)
        best = window_hashes(self.hashes, min(w, max(PREFIXES)))
        first, at = best, np.zeros(n, np.int8)
        best = best[:n].copy()
        for k in range(1, self.reach):
            other = first[k : k + n]
            less = other < best
            np.copyto(best, other, where=less)
            at[less] = k
        self.anchor = self.start + at[self.start]

    def prefix(self, length: int, bits: int) -> np.ndarray:
        """The bin of the first words of every passage's anchor."""
        if not len(self.start):
            return np.empty(0, np.int64)
        return (window_hashes(self.hashes, min(length, self.window))[self.anchor] >> np.uint64(64 - bits)).astype(np.int64)

    def first_of_equal(self) -> tuple[np.ndarray, np.ndarray]:
        """Which passages have the least key of their equals here; and which have an equal with a smaller one."""
        order = np.argsort(self.path)
        path, key = self.path[order], self.key[self.document[order]]
        cuts = _cuts(path)
        sizes = np.diff(cuts)
        least = np.repeat(np.minimum.reduceat(key, cuts[:-1]), sizes) if len(order) else key
        head = np.repeat(cuts[:-1], sizes)
        again = np.flatnonzero(head != np.arange(len(order)))
        left, right = self.start[order[again]], self.start[order[head[again]]]
        same = np.ones(len(again), bool)
        for k in range(self.window):  # the words themselves, not their hash
            same &= self.words[left + k] == self.words[right + k]
        mixed = np.isin(head, head[again[~same]])  # different passages with one hash are for the tree to tell apart
        first = np.zeros(len(order), bool)
        first[order] = mixed | (key == least)
        return first, ~first


def shortened(word: bytes) -> bytes:
    """A long word's digest, which starts with a byte that no word has."""
    return word if len(word) <= LONG else b"\xff" + hashlib.blake2b(word, digest_size=32).hexdigest().encode()


def tag(text: str) -> int:
    """A 64-bit hash of a text, to tell rows with one key apart."""
    return xxhash.xxh3_64_intdigest(text.encode())


def prefix_counts(df: DataFrame, bits: int, window: int) -> DataFrame:
    """(level, bin, word, n): the passages by hashed prefix of their anchors; and, at level -1, the frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            found = Suffixes(window, [])
            found.add(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist())
            found.close(paths=False)
            parts = [_counted(found.prefix(k, bits), bits) for k in PREFIXES]
            level = np.repeat(np.arange(len(PREFIXES), dtype=np.int32), [len(x) for x, _ in parts])
            often = np.bincount(found.words, minlength=1)
            some = np.flatnonzero(often >= OFTEN)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[level, np.full(len(some), -1, np.int32)]),
                    pa.array(np.concatenate([*[x for x, _ in parts], np.zeros(len(some), np.int64)]).astype(np.int64)),
                    pa.array([*[None] * len(level), *[found.names[x] for x in some.tolist()]], pa.binary()),
                    pa.array(np.concatenate([*[n for _, n in parts], often[some]]).astype(np.int64)),
                ],
                ["level", "bin", "word", "n"],
            )
            del found
        release()

    made = df.select("doc_id", "text").mapInArrow(run, "level int, bin long, word binary, n long")
    return made.groupBy("level", "bin", "word").agg(F.sum("n").alias("n"))


def _counted(bins: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins that there are, and how often."""
    if bits > 20:
        return np.unique(bins, return_counts=True)
    n = np.bincount(bins, minlength=1 << bits)
    return np.flatnonzero(n), n[n > 0]


def _route(found: Suffixes, hot: list[np.ndarray], bits: int) -> np.ndarray:
    """The group of every passage. ``hot`` has for each length the sorted bins with too many passages."""
    group = (found.path >> np.uint64(64 - bits)).astype(np.int64) + (len(PREFIXES) << bits)
    for level in range(len(PREFIXES) - 1, -1, -1):
        at = found.prefix(PREFIXES[level], bits)
        place = np.searchsorted(hot[level], at)
        cold = np.r_[hot[level], -1][place] != at
        group[cold] = at[cold] + (level << bits)
    return group


def _squeeze(values: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values if isinstance(values, bytes) else values.tobytes())


def _numbers(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _cuts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, values[1:] != values[:-1]]), len(values)] if len(values) else np.zeros(1, np.int64)


_COLUMNS = ("keys", "tags", "starts", "lengths", "words", "vocabulary")
_ROW = pa.schema([("group", pa.int64()), *[(c, pa.binary()) for c in _COLUMNS]])


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers with all first bytes first, which pack well, without the planes that are empty."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return _squeeze(planes[: max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)].copy())


def _unplaned(data: bytes, n: int) -> np.ndarray:
    planes = _numbers(data, "u1").reshape(-1, n)
    out = np.zeros((n, 4), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u4").reshape(-1)


def _runs(some: np.ndarray, *alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of passages that follow one another begin in ``some``, and their lengths; ``alike`` is equal within a run."""
    joined = some[1:] == some[:-1] + 1
    for x in alike:
        joined &= x[1:] == x[:-1]
    heads = np.flatnonzero(np.r_[True, ~joined][: len(some)])
    return heads, np.diff(np.r_[heads, len(some)]) if len(some) else heads


def _sent(found: Suffixes, hot: list[np.ndarray], bits: int, direct: int, common: int) -> pa.RecordBatch:
    """For each group its segments, as numbers of words of a vocabulary; and, under ``direct``, the places that need no tree."""
    first, later = found.first_of_equal()
    rows: list[tuple] = []

    some = np.flatnonzero(first)
    group = _route(found, hot, bits)[some]
    # All passages that start at following words and have one anchor; without a short prefix each goes alone.
    anchor = np.where(group >= len(PREFIXES) << bits, found.start[some], found.anchor[some])
    heads, lengths = _runs(found.start[some], anchor)
    order = np.argsort(group[heads], kind="stable")
    heads, lengths = heads[order], lengths[order]
    group, at = group[heads], some[heads]
    sizes = lengths + found.window - 1
    ends = np.cumsum(sizes)
    numbers = found.words[np.arange(ends[-1] if len(ends) else 0) + np.repeat(found.start[at] - (ends - sizes), sizes)]
    document = found.document[at]
    key, tags, own = found.key[document], found.tag[document], (found.start[at] - found.begin[document]).astype(np.uint32)
    words = np.array([*found.names, None], object)
    own_number = np.zeros(len(words), np.int32)
    cuts = _cuts(group).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        used = numbers[ends[a] - sizes[a] : ends[b - 1]]
        # Common words keep their number; the others are numbered after them, in the row's own vocabulary.
        rare = np.flatnonzero(used >= common)
        if 8 * len(rare) < len(words):
            vocabulary, place = np.unique(used[rare], return_inverse=True)
        else:
            own_number[used[rare]] = 1
            vocabulary = np.flatnonzero(own_number)
            own_number[vocabulary] = np.arange(len(vocabulary))
            place = own_number[used[rare]]
            own_number[vocabulary] = 0
        renumbered = used.copy()
        renumbered[rare] = common + place
        rows.append((int(group[a]), _squeeze(key[a:b]), _squeeze(tags[a:b]), _planes(own[a:b]), _planes(lengths[a:b]), _planes(renumbered), _squeeze(b" ".join(words[vocabulary].tolist()))))

    some = np.flatnonzero(later)
    if len(some):
        heads, lengths = _runs(found.start[some], found.document[some])
        document = found.document[some[heads]]
        rows.append((direct, _squeeze(found.key[document]), _squeeze(found.tag[document]), _planes(found.start[some[heads]] - found.begin[document]), _planes(lengths), b"", b""))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _ROW.types[k]) for k in range(len(_ROW))], schema=_ROW)


def _segments(df: DataFrame, hot: list[np.ndarray], bits: int, window: int, common: list[bytes]) -> DataFrame:
    """Segments by group, places by a group below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, salt = Suffixes(window, common), 0
        for batch in slices(batches, "text", CHUNK_BYTES):
            found.add(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist())
            if found.waiting >= FLUSH:
                found.close()
                salt = (salt + int(found.tag.sum() % DIRECT) + 1) % DIRECT
                yield _sent(found, hot, bits, -1 - salt, len(common))
                found = Suffixes(window, common)
                release()
        if found.waiting:
            found.close()
            yield _sent(found, hot, bits, -1 - (salt + int(found.tag.sum() % DIRECT) + 1) % DIRECT, len(common))
        del found
        release()

    return df.select("doc_id", "text").mapInArrow(run, "group long, " + ", ".join(f"{c} binary" for c in _COLUMNS))


class Tree:
    """The suffix tree over the segments of a group, cut at ``window`` words: leaves in order, and how many words
    each has in common with the one before. Segments are runs of numbered words, ``sizes`` long."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, window: int):
        leaves = sizes - window + 1
        self.segment = np.repeat(np.arange(len(sizes), dtype=np.int32), leaves)
        self.offset = (np.arange(len(self.segment)) - np.repeat(np.cumsum(leaves) - leaves, leaves)).astype(np.int32)
        start = (np.cumsum(sizes) - sizes)[self.segment] + self.offset
        bits = max(1, int(words.max(initial=0)).bit_length())
        each = 64 // bits
        words = words.astype(np.uint64)
        columns = []
        for a in range(0, window, each):
            column_ = words[start + a]
            for k in range(a + 1, min(a + each, window)):
                column_ = (column_ << np.uint64(bits)) | words[start + k]
            columns.append(column_)
        self.order = _sorted(columns)
        self.common = np.zeros(len(start), np.int8)
        alike = np.ones(max(0, len(start) - 1), bool)
        for j, column_ in enumerate(columns):
            ordered = column_[self.order]
            differ = ordered[1:] ^ ordered[:-1]
            in_column = min(each, window - j * each)
            for k in range(in_column):
                self.common[1:] += alike & (differ >> np.uint64(bits * (in_column - 1 - k)) == 0)
            alike &= differ == 0

    def deep(self, depth: int) -> np.ndarray:
        """The number, in order, of each leaf's highest node that is ``depth`` words deep (a leaf alone is its own)."""
        return np.cumsum(self.common < depth) - 1


def _sorted(columns: list[np.ndarray]) -> np.ndarray:
    """The order by all columns; most rows are told apart by the first two."""
    order = np.lexsort(columns[1::-1])
    if len(columns) < 3 or not len(order):
        return order
    same = (columns[0][order][1:] == columns[0][order][:-1]) & (columns[1][order][1:] == columns[1][order][:-1])
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    run = np.cumsum(np.r_[True, ~same])[tied]
    rows = order[tied]
    order[tied] = rows[np.lexsort((*[c[rows] for c in columns[:1:-1]], run))]
    return order


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    folded = keys.astype(np.uint64)
    folded = (folded ^ (folded >> np.uint64(17))) & np.uint64(2**63 - 1)
    return (folded % np.uint64(buckets)).astype(np.int64)


def _bucket_column(key: Column, text: Column, buckets: int) -> Column:
    """The same on the JVM's side; rows without a key, which meet nothing, are spread by their text."""
    own = F.coalesce(key, F.xxhash64(text))
    return own.bitwiseXOR(F.shiftrightunsigned(own, 17)).bitwiseAND(F.lit(2**63 - 1)) % F.lit(buckets).cast("long")


_PLACES = "bucket long, keys binary, tags binary, starts binary, lengths binary"


def _places(segments: DataFrame, buckets: int, window: int, common: int) -> DataFrame:
    """(bucket, keys, tags, starts, lengths): the maximal repeats, in passages, by a hash of the key."""

    def run(t: pa.Table) -> pa.Table:
        sent = {c: t.column(c).to_pylist() for c in _COLUMNS}
        keys, tags = ([_numbers(x, kind) for x in sent[c]] for c, kind in (("keys", "<i8"), ("tags", "<u8")))
        start, length = (np.concatenate([_unplaned(x, len(k)) for x, k in zip(sent[c], keys, strict=True)]) for c in ("starts", "lengths"))
        if t.column("group")[0].as_py() >= 0:
            known: dict[bytes, int] = {}
            words, at, free = [], 0, common
            for k, x, vocabulary in zip(keys, sent["words"], sent["vocabulary"], strict=True):
                n = int(length[at : at + len(k)].sum()) + len(k) * (window - 1)
                own = zstandard.ZstdDecompressor().decompress(vocabulary).split()
                # New words get the next numbers; known ones leave theirs unused.
                named = np.fromiter(map(known.setdefault, own, itertools.count(free)), np.uint32, len(own))
                free += len(own)
                words.append(np.r_[np.arange(common, dtype=np.uint32), named][_unplaned(x, n)])
                at += len(k)
            del sent
            tree = Tree(np.concatenate(words), length.astype(np.int64) + window - 1, window)
        key, tags = np.concatenate(keys), np.concatenate(tags)
        if t.column("group")[0].as_py() >= 0:
            node = tree.deep(window)
            leaf_key = key[tree.segment[tree.order]]
            repeated = np.zeros(len(node), bool)
            repeated[tree.order] = leaf_key > np.minimum.reduceat(leaf_key, _cuts(node)[:-1])[node]
            some = np.flatnonzero(repeated)
            heads, length = _runs(some, tree.segment[some])
            heads = some[heads]
            key, tags, start = key[tree.segment[heads]], tags[tree.segment[heads]], start[tree.segment[heads]] + tree.offset[heads].astype(np.uint32)
        start, length = start.astype(np.uint32), length.astype(np.uint32)
        bucket = _bucket(key, buckets)
        order = np.lexsort((start, tags, key, bucket))
        cuts = _cuts(bucket[order])
        made = [[int(bucket[order[a]]), *[_squeeze(x[order[a:b]]) for x in (key, tags, start, length)]] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.table({n: pa.array([m[k] for m in made], kind) for k, (n, kind) in enumerate([("bucket", pa.int64()), ("keys", pa.binary()), ("tags", pa.binary()), ("starts", pa.binary()), ("lengths", pa.binary())])})

    return segments.groupBy("group").applyInArrow(run, _PLACES)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """Which of n words runs of passages cover."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + lengths + window - 1, n), -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP, prefix: str = "") -> DataFrame:
    """Add n_words, n_removed and kept (the words that stay, joined by one space) to every row."""
    slim = df.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    rows, size = slim.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = max(4, math.ceil(math.log2(1 + size / 6 / group)))
    counts = scratch.table(prefix_counts(slim, bits, window), "prefixes")
    hot: list[list[int]] = [[] for _ in PREFIXES]
    for row in counts.filter((F.col("level") >= 0) & (F.col("n") > group)).collect():  # size / group at most of each length
        hot[row.level].append(row.bin)
    frequent = counts.filter("level < 0").orderBy(F.desc("n"), "word").limit(COMMON).collect()
    common = [bytes(r.word) for r in frequent]
    scratch.drop(counts)
    buckets = max(1, rows // BUCKET) | 1
    segments = _segments(slim, [np.array(sorted(x), np.int64) for x in hot], bits, window, common)
    places = _places(segments, buckets, window, len(common))

    # The text goes along once.
    texts_type = dict(df.dtypes)[text] == "string"
    dealt = df.select(packed([c for c in df.columns if c != text or not texts_type]).alias("row"), column(key).cast("long").alias("key"), column(text).cast("string").alias("words"))
    dealt = dealt.withColumn("bucket", _bucket_column(F.col("key"), F.col("words"), buckets))
    row = next(f for f in dealt.schema.fields if f.name == "row")
    schema = T.StructType([row, T.StructField("words", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        parts = [[_numbers(x, kind) for x in found.column(c).to_pylist()] for c, kind in (("keys", "<i8"), ("tags", "<u8"), ("starts", "<u4"), ("lengths", "<u4"))]
        keys, tags, starts, lengths = (np.concatenate([*p, np.empty(0, kind)]) for p, kind in zip(parts, ("<i8", "<u8", "<u4", "<u4"), strict=True))
        name = mix(keys.astype(np.uint64)) ^ tags
        order = np.lexsort((starts, name))
        name, keys, tags, starts, lengths = name[order], keys[order], tags[order], starts[order].astype(np.int64), lengths[order].astype(np.int64)
        n_words, n_removed, texts = [], [], []
        for k, t in zip(docs.column("key").to_pylist(), docs.column("words").to_pylist(), strict=True):
            words = (t or "").encode().split()
            removed = 0
            if k is not None and len(words) >= window and len(name):
                own = int(mix(np.array([k], np.int64).astype(np.uint64))[0]) ^ tag(t)
                a, b = np.searchsorted(name, np.uint64(own), "left"), np.searchsorted(name, np.uint64(own), "right")
                some = np.flatnonzero(keys[a:b] == k) + a
                if len(some):
                    gone = covered(len(words), starts[some], lengths[some], window)
                    removed = int(gone.sum())
            n_words.append(len(words))
            n_removed.append(removed)
            texts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed else words).decode())
        return pa.table({"row": docs.column("row"), "words": docs.column("words"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(texts, pa.string())})

    made = dealt.groupBy("bucket").cogroup(places.groupBy("bucket")).applyInArrow(run, schema)
    own = {f"{prefix}{c}": F.col(c) for c in ("n_words", "n_removed", "kept")}
    rest = [F.col("words").alias(c) if c == text and texts_type else unpacked("row", [c])[0] for c in df.columns if c not in own]
    return made.select(*rest, *[c.alias(n) for n, c in own.items()])

"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts are cut at safe boundaries (:func:`millrace.llm.words.chunks`); ids of chunks that were met
before come from a bounded cache in each Python worker, so repeated words are merged once. Decoding
joins the tokens' raw bytes.

Null texts count as empty and give no ids. Texts of any length are encoded whole; long runs of white
space, which the library's pattern cannot match, are cut where its matches would end. Rows repeat
as they come; other columns pass through untouched, whatever their names, but for ids and decoded, which are replaced. An
empty table gives an empty one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.arrow import binary_lists, release, slices
from millrace.llm.names import column
from millrace.llm.words import chunks

#: Chunks a task remembers (about 200 bytes each); then it starts again.
CACHE_CHUNKS = 1_000_000
LONG = 10_000
#: White space as the library's pattern has it (Unicode White_Space).
_WS = "\t-\r \x85\xa0  -     　"
_RUNS = re.compile(f"[{_WS}]+|[^{_WS}]+")

_LOADED: dict[tuple[str, str], Codec] = {}


class Codec:
    """An encoder and decoder for one rank file."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.seen: dict[str, bytes] = {}

    @staticmethod
    def load(rank_file: str, pattern: str) -> Codec:
        """The worker's codec for these parameters."""
        key = rank_file, pattern
        if key not in _LOADED:
            _LOADED[key] = Codec(rank_file, pattern)
        return _LOADED[key]

    def _chunk(self, chunk: str) -> list[int]:
        if len(chunk) <= LONG:
            return self.encoding.encode_ordinary(chunk)
        ids: list[int] = []
        runs, before = _RUNS.findall(chunk), ""
        for k, run in enumerate(runs):
            if not re.match(f"[{_WS}]", run):
                ids += self.encoding.encode_ordinary(before + run)
                before = ""
                continue
            # The last space of a run belongs to what follows, the others are one match.
            own, before = (run, "") if k + 1 == len(runs) else (run[:-1], run[-1])
            if own:
                ids += self.encoding._encode_single_piece(own)
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        seen, parts = self.seen, chunks(text)
        try:
            return b"".join([seen[x] for x in parts])
        except KeyError:
            pass
        if len(seen) > CACHE_CHUNKS:
            seen.clear()
        out = []
        for x in parts:
            ids = seen.get(x)
            if ids is None:
                ids = np.array(self._chunk(x), "<u4").tobytes()
                if len(x) <= 64:
                    seen[x] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids`` (array of int) and, if a name is given, ``decoded`` (binary): the bytes that the ids
    stand for, decoded from the ids."""
    new = {ids, decoded} - {None}
    kept = [f for f in df.schema.fields if f.name not in new]
    rest = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    if decoded:
        schema = schema.add(decoded, T.BinaryType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(rank_file, pattern)
        for batch in slices(batches, text, 4 << 20):
            rows = [codec.encode(x or "") for x in batch.column(text).to_pylist()]
            columns = [*[batch.column(c) for c in rest], binary_lists(rows, pa.int32(), 4)]
            if decoded:
                columns.append(pa.array([codec.decode(np.frombuffer(x, "<u4").tolist()) for x in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [*rest, ids, *([decoded] if decoded else [])])
        codec.seen = {}  # the worker lives on beside the next operator's
        release()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary): the bytes of the tokens in ``ids``; null ids give null. They need not be UTF-8."""
    rest = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in rest]
    schema = T.StructType([*rest, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(rank_file, pattern)
        for batch in slices(batches, ids):
            rows = [None if x is None else codec.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(rows, pa.binary())], [*names, out])

    return df.mapInArrow(run, schema)


def digests(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Counts and SHA-256 digests of encoded rows."""
    return encoded.select(
        column(key).alias(key),
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )

"""Token ids in length-delimited binary records with a separate offset index.

A data file is a run of records; a record is

    length   u64   bytes of the payload
    crc      u32   masked CRC-32 of the eight length bytes
    payload  u8 flags (1: the key is null), i64 key, u32 number of ids, the ids (u16 or u32)
    crc      u32   masked CRC-32 of the payload

all little-endian. The mask is ((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2**32 over zlib's CRC-32. The
index beside it has ``RIDX``, the width of an id, the number of records, and every record's offset as
u64, so a reader can fetch records in any order. Files are named by range of the key, in its order.

Writing: rows are range-partitioned by key and sorted by (key, text), nulls first, so repeated keys
keep a defined order. Each task writes under a name of its own attempt and renames when whole; a task
that is run again writes the same bytes. Null texts are empty texts, whose record holds the end id
alone; texts of any length are encoded whole. An empty table gives no files. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import scratch
from millrace.llm.arrow import slices
from millrace.llm.names import column
from millrace.llm.words import chunks

#: Chunks a worker remembers; then it starts again.
CACHE_CHUNKS = 1_000_000
#: Formats of a record's head, its payload's head, and the index's head.
_HEAD, _PAYLOAD, _INDEX = "<QI", "<BqI", "<4sIQ"
#: A space beside white space, as Python's \\s has it (fixed values).
_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = f" [{_WS}]|[{_WS}] "
#: Chunks that are encoded on their own: the empty ones and those with white space behind their first character, or other than a space there.
_ALONE = f"(?s)^ ?$|.[{_WS}]|^[{_WS.replace('-\\x20', '-\\x1f')}]"
#: Other chunks that are encoded as one text.
JOINED = 200
#: A line end beside white space.
_LINES = f"\\n[{_WS}]|[{_WS}]\\n"
#: What ends in a letter of the Latin blocks, and ASCII punctuation behind it up to the end: two matches of the pattern at least.
_TAIL = r"(?s)^(?P<core>.*[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])(?P<tail>[!-/:-@\[-`{-~]+)$"
_LOADED: dict[str, Encoder] = {}


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


class Encoder:
    """A tokenizers file, with the ids of chunks met before."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = {2: "H", 4: "I"}[self.width]  # little-endian machines
        self.seen: dict[str, bytes] = {}
        ids = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = ids[0] if len(ids) == 1 else None
        rule = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        #: The byte-level pattern matches a line end between other characters on its own.
        self.cuts_lines = rule.get("type") == "ByteLevel" and rule.get("use_regex", False)

    @staticmethod
    def load(tokenizer_file: str) -> Encoder:
        if tokenizer_file not in _LOADED:
            _LOADED[tokenizer_file] = Encoder(tokenizer_file)
        return _LOADED[tokenizer_file]

    def _chunks(self, chunks_: list[str]) -> list[bytes]:
        """The ids of some chunks; those met before are remembered."""
        if len(self.seen) > CACHE_CHUNKS:
            self.seen.clear()
        found = list(map(self.seen.get, chunks_))
        late = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(late, self._library([chunks_[k] for k in late]), strict=True):
            found[k] = ids
        self.seen.update((chunks_[k], found[k]) for k in late if len(chunks_[k]) <= 64)
        return found

    def _library(self, chunks_: list[str]) -> list[bytes]:
        """The ids of some chunks from the library. A line end between chunks without inner white space is a match of the
        pattern of its own, so many go as one text, whose ids are cut at the line ends."""
        out: list[bytes] = [b""] * len(chunks_)
        alone = pc.match_substring_regex(pa.array(chunks_, pa.large_string()), _ALONE).to_numpy(zero_copy_only=False)
        single = np.flatnonzero(alone | (self.line is None)).tolist()
        joined = np.flatnonzero(~alone & (self.line is not None)).tolist()
        for start in range(0, len(single), 20_000):
            some = single[start : start + 20_000]
            for k, encoded in zip(some, self.tokenizer.encode_batch_fast([chunks_[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = array(self.kind, encoded.ids).tobytes()
        for start in range(0, len(joined), JOINED):
            some = joined[start : start + JOINED]
            ids = array(self.kind, self.tokenizer.encode_batch_fast(["\n".join([chunks_[k] for k in some])], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(np.frombuffer(ids, f"<u{self.width}") == self.line) * self.width
            if len(ends) != len(some) - 1:  # a line end is part of a token of another pattern
                for k in some:
                    out[k] = array(self.kind, self.tokenizer.encode(chunks_[k], add_special_tokens=False).ids).tobytes()
                continue
            blob, last = ids.tobytes(), 0
            for k, end in zip(some, [*ends.tolist(), len(blob)], strict=True):
                out[k] = blob[last:end]
                last = end + self.width
        return out

    def _parts(self, parts: pa.Array) -> list[bytes]:
        """The ids of some chunks, with punctuation at their ends apart from what is before it."""
        split = pc.extract_regex(parts, _TAIL)
        core, tail = (pc.struct_field(split, k).dictionary_encode() for k in (0, 1))
        ends = split.is_valid().to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(parts)
        whole = np.flatnonzero(~ends)
        for k, ids in zip(whole.tolist(), self._chunks(parts.take(pa.array(whole)).to_pylist()), strict=True):
            out[k] = ids
        cores, tails = (self._chunks(x.dictionary.to_pylist()) for x in (core, tail))
        both = np.flatnonzero(ends)
        for k, a, b in zip(both.tolist(), *(x.indices.take(pa.array(both)).to_pylist() for x in (core, tail)), strict=True):
            out[k] = cores[a] + tails[b]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``width`` bytes. Each word of a batch is looked up once."""
        given = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(given, _ODD).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            out[k] = b"".join(self._chunks(chunks(texts[k])))
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        # Without odd spaces a text is cut at every space, as chunks() does; all parts but the first keep theirs. So it is at
        # line ends.
        given = given.take(pa.array(plain))
        if self.cuts_lines:
            given = pc.if_else(pc.match_substring_regex(given, _LINES), given, pc.replace_substring(given, "\n", " \n"))
        parts = pc.split_pattern(given, " ")
        ends = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        of = coded.indices.to_numpy().astype(np.int32)
        names = coded.dictionary
        first = names.take(pa.array(of[ends[:-1]]))
        of[ends[:-1]] = len(names) + np.arange(len(plain))
        ids = self._parts(pc.if_else(pc.starts_with(names, "\n"), names, pc.binary_join_element_wise(pa.scalar("", names.type), names, pa.scalar(" ", names.type)))) + self._parts(first)
        flat = np.frombuffer(b"".join(ids), f"<u{self.width}")
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // self.width
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        counts = sizes[of]
        upto = np.cumsum(counts, dtype=np.int32)  # a batch has a few million ids, or those of one text
        made = flat[np.arange(upto[-1], dtype=np.int32) + np.repeat(starts[of] - (upto - counts), counts)].tobytes()
        last = 0
        for k, end in zip(plain.tolist(), (upto[ends[1:] - 1] * self.width).tolist(), strict=True):
            out[k] = made[last:end]
            last = end
        return out


def _one_thread() -> None:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def write(df: DataFrame, tokenizer_file: str, end_id: int, to: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write the files below ``to``. Returns the manifest, one row
    for each file: part, file, width, rows, ids, and start (ids in all files before it)."""
    spark = df.sparkSession
    slim = df.select(column(key).cast("long").alias("key"), column(text).cast("string").alias("text"))
    dealt = slim.repartitionByRange("key").sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _one_thread()
        encoder = Encoder.load(tokenizer_file)
        end = np.array([end_id], f"<u{encoder.width}").tobytes()
        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(to)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{part:06d}"
        own = f"{base}/.{part:06d}-{uuid.uuid4().hex}"
        offsets, at, rows, total = [], 0, 0, 0
        out = None
        for batch in slices(batches, "text", 4 << 20):
            out = out or store.open_output_stream(own + ".rec")
            encoded = encoder.encode([x or "" for x in batch.column("text").to_pylist()])
            blobs = []
            for k, ids in zip(batch.column("key").to_pylist(), encoded, strict=True):
                ids += end
                payload = struct.pack(_PAYLOAD, k is None, k or 0, len(ids) // encoder.width) + ids
                length = struct.pack("<Q", len(payload))
                blobs.append(length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload)))
                offsets.append(at)
                at += len(blobs[-1])
                total += len(ids) // encoder.width
            rows += len(encoded)
            out.write(b"".join(blobs))
        if out is None:
            return
        out.close()
        with store.open_output_stream(own + ".idx") as f:
            f.write(struct.pack(_INDEX, b"RIDX", encoder.width, rows) + np.array(offsets, "<u8").tobytes())
        for end_of_name in (".rec", ".idx"):  # with its index a file is whole
            store.move(own + end_of_name, name + end_of_name)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{to}/part-{part:06d}"], "width": [encoder.width], "rows": [rows], "ids": [total]}, schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("width", pa.int32()), ("rows", pa.int64()), ("ids", pa.int64())]))

    files = scratch.table(dealt.mapInArrow(run, "part long, file string, width int, rows long, ids long"), "manifest")
    sweep(to)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return scratch.table(files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))), "manifest")


def sweep(to: str) -> None:
    """Remove what attempts that did not end have left below ``to``."""
    store, base = fs.FileSystem.from_uri(to)
    for found in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if found.base_name.startswith(".") and found.base_name.endswith((".rec", ".idx")):
            store.delete_file(found.path)


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest: key, start (ids of all records before it), n_tokens, ids (binary,
    little-endian 32-bit). A wrong checksum or length fails the task. Files are read by as many tasks as there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, base = fs.FileSystem.from_uri(row["file"])
                with store.open_input_file(base + ".idx") as f:
                    magic, width, rows = struct.unpack(_INDEX, f.read(struct.calcsize(_INDEX)))
                    offsets = np.frombuffer(f.read(), "<u8")
                if magic != b"RIDX" or len(offsets) != rows:
                    raise ValueError(f"{row['file']}.idx is not whole")
                start = row["start"]
                with store.open_input_file(base + ".rec") as f:
                    size = f.size()
                    ends = [*offsets[1:].tolist(), size]
                    for first in range(0, rows, 2000):
                        last = min(first + 2000, rows)
                        f.seek(int(offsets[first]))
                        block = f.read(ends[last - 1] - int(offsets[first]))
                        keys, starts, counts, blobs = [], [], [], []
                        for k in range(first, last):
                            record = block[int(offsets[k] - offsets[first]) : ends[k] - int(offsets[first])]
                            null, key, n, ids = parse(record, width)
                            keys.append(None if null else key)
                            starts.append(start)
                            counts.append(n)
                            blobs.append(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
                            start += n
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], ["key", "start", "n_tokens", "ids"])

    files = max(1, manifest.count())
    return manifest.select("part", "file", "start").repartitionByRange(files, "part").mapInArrow(run, "key long, start long, n_tokens long, ids binary")


def parse(record: bytes, width: int) -> tuple[int, int, int, bytes]:
    """(null flag, key, number of ids, ids) of one framed record; ValueError if it is damaged."""
    length, crc = struct.unpack_from(_HEAD, record)
    payload = record[struct.calcsize(_HEAD) : struct.calcsize(_HEAD) + length]
    if masked(record[:8]) != crc or len(payload) != length or struct.unpack_from("<I", record, struct.calcsize(_HEAD) + length)[0] != masked(payload):
        raise ValueError("a record's checksum is wrong")
    null, key, n = struct.unpack_from(_PAYLOAD, payload)
    ids = payload[struct.calcsize(_PAYLOAD) :]
    if len(ids) != n * width:
        raise ValueError("a record's length is wrong")
    return null, key, n, ids

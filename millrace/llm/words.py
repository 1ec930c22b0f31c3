"""Words, text chunks and hashes shared by the operators.

A word is a run of bytes other than space and 0x09-0x0D; ``bytes.split()`` cuts at exactly these.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "\\x20\\x09-\\x0D"

#: A space with white space on either side; Python's \s holds all white space that the tokenizers know.
_ODD_SPACE = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_DIGEST = xxhash.xxh3_64_digest


def words_column(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), "")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word."""
    return np.frombuffer(b"".join(map(_DIGEST, words)), ">u8").astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive words, in order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, step = np.zeros(n, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for i in range(size):
        out = out * step + hashes[i : i + n]
    return mix(out)


def chunks(text: str) -> list[str]:
    """Cut a text before every space that stands between two non-space characters.

    The tokenizers' pattern lets white space stand only at the start of a match, and what follows
    such a place never looks back, so encoding the chunks one by one gives the whole text's tokens.
    """
    parts = _CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")
    return [parts[0], *[" " + x for x in parts[1:]]]

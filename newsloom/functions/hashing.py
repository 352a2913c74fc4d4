"""64-bit SimHash and Hamming distance. A hash is a signed long holding the same 64 bits."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import WORD

SHINGLE = 4
# Characters handled at once; bounds the memory of a Python worker.
CHUNK_CHARS = 2_000_000
# Four characters of an alphabet up to this size fit one 63-bit key.
MAX_ALPHABET = 50_000
PAD = "\0"


def _tail(shingle: str) -> bytes:
    return hashlib.md5(shingle.encode()).digest()[8:]


def _shingle_hashes(joined: str, lengths: np.ndarray) -> np.ndarray:
    """Hashes of all shingles of the padded texts in ``joined``, each distinct one hashed once."""
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    alphabet = np.flatnonzero(np.bincount(codes))
    ends = np.cumsum(lengths)
    inside = np.ones(len(codes), dtype=bool)
    inside[(ends[:, None] - np.arange(1, SHINGLE)).ravel()] = False
    starts = np.flatnonzero(inside)
    if len(alphabet) > MAX_ALPHABET:
        tails = [_tail(joined[i : i + SHINGLE].rstrip(PAD)) for i in starts]
        return np.frombuffer(b"".join(tails), dtype=">u8").astype(np.uint64)
    small = np.zeros(alphabet[-1] + 1, dtype=np.int64)
    small[alphabet] = np.arange(len(alphabet))
    letters = small[codes]
    keys = np.zeros(len(starts), dtype=np.int64)
    for offset in range(SHINGLE):
        keys = keys * len(alphabet) + letters[starts + offset]
    which, distinct = pd.factorize(keys)
    spelled = np.empty((len(distinct), SHINGLE), dtype="<u4")
    for offset in reversed(range(SHINGLE)):
        distinct, letter = np.divmod(distinct, len(alphabet))
        spelled[:, offset] = alphabet[letter]
    text = spelled.tobytes().decode("utf-32-le")
    tails = [_tail(text[i : i + SHINGLE].rstrip(PAD)) for i in range(0, len(text), SHINGLE)]
    return np.frombuffer(b"".join(tails), dtype=">u8").astype(np.uint64)[which]


def _vote(texts: list[str]) -> np.ndarray:
    """Majority vote per bit over all overlapping shingles of each text."""
    padded = [t.ljust(SHINGLE, PAD) for t in texts]
    lengths = np.array([len(t) for t in padded])
    hashes = _shingle_hashes("".join(padded), lengths)
    counts = lengths - SHINGLE + 1
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    # Bits are counted in lanes of one word, as wide as the longest text needs.
    width = 16 if counts.max() < 1 << 16 else 32
    lane = np.uint64((1 << width) - 1)
    ones = np.uint64(sum(1 << i for i in range(0, 64, width)))
    result = np.zeros(len(texts), dtype=np.uint64)
    for shift in range(width):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & ones, first)
        for base in range(0, 64, width):
            votes = (sums >> np.uint64(base)) & lane
            won = votes.astype(np.int64) * 2 > counts
            result |= won.astype(np.uint64) << np.uint64(base + shift)
    return result.view(np.int64)


def _votes(words: pd.Series) -> pd.Series:
    out, chunk, size = [], [], 0
    for text in words:
        chunk.append(text)
        size += len(text)
        if size >= CHUNK_CHARS:
            out.append(_vote(chunk))
            chunk, size = [], 0
    if chunk:
        out.append(_vote(chunk))
    return pd.Series(np.concatenate(out) if out else np.empty(0, dtype=np.int64))


def simhash(text: Column) -> Column:
    """SimHash of the lower-cased word characters of ``text``, null counting as ``''``.

    An Arrow function inside the scan stage. The alternative in built-ins alone
    explodes every article into its shingles and needs a shuffle to add up the
    votes; this one leaves rows where they are.
    """
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{WORD[1:-1]}]+", "")
    return F.pandas_udf(_votes, T.LongType())(words)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))

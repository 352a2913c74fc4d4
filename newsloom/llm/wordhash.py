"""Words of texts as 64-bit numbers, and sliding hashes over them, for whole batches at a time."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Distinct words that a worker remembers before it starts anew.
REMEMBERED = 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Which bytes ``bytes.split()`` splits at.
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Bytes of a word that are hashed eight at a time; longer words are hashed one by one.
SHORT = 256


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = xxhash.xxh3_64_intdigest(word)
        return n


WORDS = WordHashes()


def hashes(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in one array, and where each document starts in it (one more at the end)."""
    if len(WORDS) > REMEMBERED:
        WORDS.clear()
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=starts[1:])
    return np.fromiter(map(WORDS.__getitem__, chain.from_iterable(docs)), np.uint64, starts[-1]), starts


def byte_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Like ``hashes`` (with other hashes), from an array of strings or bytes, null as empty, without an object for each word."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size, offsets = int(offsets[-1] - offsets[0]), offsets - offsets[0]
    # eight more, so that every byte begins a number of eight bytes
    raw = np.zeros(size + 8, np.uint8)
    if size:
        begin = int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset])
        raw[:size] = np.frombuffer(texts.buffers()[2], np.uint8)[begin : begin + size]
    # 1 in words; a word ends at white space and with its text
    within = ~SPACE[raw[:size]]
    cut = np.zeros(size + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= ~within[:-1] | ~within[1:]
    begins = np.flatnonzero(within & cut[:-1])
    lengths = np.flatnonzero(within & cut[1:]) + 1 - begins
    eights = np.ndarray(size + 1, "<u8", raw.data, strides=(1,))
    out = lengths.astype(np.uint64) * MIX
    live = np.flatnonzero(lengths <= SHORT)
    for done in range(0, SHORT, 8):
        live = live[lengths[live] > done]
        if not len(live):
            break
        left = np.minimum(lengths[live] - done, 8).astype(np.uint64)
        x = (out[live] ^ (eights[begins[live] + done] << (np.uint64(64) - left * np.uint64(8)))) * np.uint64(0xD6E8FEB86659FD93)
        out[live] = x ^ (x >> np.uint64(32))
    for i in np.flatnonzero(lengths > SHORT):
        out[i] = xxhash.xxh3_64_intdigest(raw[begins[i] : begins[i] + lengths[i]].tobytes())
    return out, np.searchsorted(begins, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every ``n`` words in a row, also of those that lie across two documents."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = total * MIX + words[i : len(words) - n + 1 + i]
    return mixed(total)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` values in a row."""
    if len(x) < n:
        return x[:0]
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def inside(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where ``n`` words in a row lie in one document, and the number of that document."""
    count = np.maximum(np.diff(starts) - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    ahead = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
    return np.arange(len(doc)) - ahead[doc] + starts[doc], doc

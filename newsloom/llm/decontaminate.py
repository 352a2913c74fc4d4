"""Benchmark items inside documents: q-gram lemma filter, then banded alignment.

Texts are lower-cased (A-Z) and runs of white space become one space. An item of ``n`` code points is found in
a document if some stretch of it is at most ``k = n * EDITS`` edits away (rounded down). Such a stretch keeps
``n + 1 - Q - k * Q`` of the item's q-grams at least, on diagonals (place in the document less place in the
item) that lie within ``k`` of each other. So shared q-grams are counted in bands of diagonals of twice the
width ``k + 1`` that overlap by half; a band with that many different q-grams of the item is aligned inside
the band, and kept if the distance is within ``k``. Nothing within the budget is missed.

For short items ``k`` is lowered until the lemma asks for one q-gram at least; items of fewer than ``SHORTEST``
code points match by chance and are never looked for. Null and empty texts match nothing, repeated rows
repeat their matches, empty tables give none; extra columns are ignored by ``matches`` and kept by
``decontaminated``. Of several places of an item in one document the one with the fewest edits counts, the
first of equals.

Benchmarks are sent to the documents in parts of at most ``PART`` code points and one item, each part taking
one pass over the documents, so what a task holds does not grow with them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.columns import batches, filtered, texts

Q, EDITS, SHORTEST = 10, 0.08, 20
PART = 2_000_000
#: Code points that a task looks at together.
CHUNK = 1_500_000
BITS = 22
FACTOR = 0x9E3779B97F4A7C15
SPACE = re.compile(rb"[\x20\x09-\x0D]+")
MATCHES = "doc_id long, item_id long, place int, edits int, similarity double"


def normal(text: bytes) -> np.ndarray:
    return np.frombuffer(SPACE.sub(b" ", text.lower()).strip().decode(errors="replace").encode("utf-32-le"), np.uint32)


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of every ``Q`` code points in a row, by doubling."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    width, whole, done, total = 1, codes.astype(np.uint64), 0, None
    size = len(codes) - Q + 1
    while True:
        if Q & width:
            part = whole[done : done + size]
            total = part if total is None else total * np.uint64(pow(FACTOR, width, 2**64)) + part
            done += width
        if width * 2 > Q:
            break
        whole = whole[:-width] * np.uint64(pow(FACTOR, width, 2**64)) + whole[width:]
        width *= 2
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def budget(n: int) -> int:
    return max(0, min(int(n * EDITS), (n - Q) // Q))


class Benchmark:
    """The items of one part with their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]]):
        found = [(i, normal(t)) for i, t in items]
        self.items = [(i, c) for i, c in found if len(c) >= SHORTEST]
        sizes = [len(c) - Q + 1 for _, c in self.items]
        hashed = np.concatenate([grams(c) for _, c in self.items] or [np.empty(0, np.uint64)])
        order = np.argsort(hashed, kind="stable")
        self.hashes = hashed[order]
        self.item = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.place = np.concatenate([np.arange(n) for n in sizes] or [np.empty(0, np.int64)])[order]
        self.edits = np.array([budget(len(c)) for _, c in self.items], np.int64)
        self.needed = np.array([len(c) + 1 - Q - budget(len(c)) * Q for _, c in self.items], np.int64)
        self.sieve = np.zeros(1 << BITS, bool)
        self.sieve[self.hashes >> np.uint64(64 - BITS)] = True

    def search(self, docs: list[bytes]) -> list[tuple[int, int, int, int]]:
        """Matches as number of the document, number of the item, place, edits."""
        found, group, size = [], [], 0
        for n, text in enumerate(docs):
            group.append((n, normal(text)))
            size += len(group[-1][1])
            if size > CHUNK:
                found += self.search_group(group)
                group, size = [], 0
        return found + self.search_group(group)

    def search_group(self, group: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int]]:
        group = [(n, c) for n, c in group if len(c) >= Q]
        if not group or not len(self.hashes):
            return []
        codes = np.concatenate([c for _, c in group])
        starts = np.cumsum([0] + [len(c) for _, c in group])
        hashed = grams(codes)
        at = np.flatnonzero(self.sieve[hashed >> np.uint64(64 - BITS)])
        low, high = np.searchsorted(self.hashes, hashed[at], "left"), np.searchsorted(self.hashes, hashed[at], "right")
        at, low, times = at[high > low], low[high > low], (high - low)[high > low]
        if not len(at):
            return []
        entry = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(at, times)
        doc = np.searchsorted(starts, at, "right") - 1
        crosses = at + Q > starts[doc + 1]
        entry, at, doc = entry[~crosses], at[~crosses], doc[~crosses]
        item, place = self.item[entry], self.place[entry]
        diagonal = at - starts[doc] - place + (1 << 30)
        width = self.edits[item] + 1
        band = diagonal // width
        found: dict[tuple[int, int], tuple[int, int]] = {}
        key = np.concatenate([np.stack([doc, item, band - lower, place]) for lower in (0, 1)], axis=1)
        key = np.unique(key, axis=1) if key.shape[1] < 2 else unique_columns(key)
        heads = np.flatnonzero(np.concatenate([[True], (key[:3, 1:] != key[:3, :-1]).any(axis=0)])) if key.shape[1] else np.empty(0, np.int64)
        counts = np.diff(np.append(heads, key.shape[1]))
        for h in heads[counts >= self.needed[key[1, heads]]]:
            d, i, b = (int(x) for x in key[:3, h])
            w = int(self.edits[i]) + 1
            edits, place = aligned(self.items[i][1], group[d][1], b * w - (1 << 30), 2 * w)
            if edits <= self.edits[i]:
                best = found.get((d, i))
                if best is None or (edits, place) < best:
                    found[d, i] = edits, place
        return [(group[d][0], i, place, edits) for (d, i), (edits, place) in sorted(found.items())]


def unique_columns(key: np.ndarray) -> np.ndarray:
    key = key[:, np.lexsort(key[::-1])]
    return key[:, np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])]


def aligned(item: np.ndarray, text: np.ndarray, lowest: int, width: int) -> tuple[int, int]:
    """The least edits of the item against any stretch within the band, and where that stretch ends less the
    item's length. ``lowest`` is the band's first diagonal."""
    d = np.arange(width)
    far = len(item) + width
    row = np.where((lowest + d >= 0) & (lowest + d <= len(text)), 0, far)
    padded = np.full(len(item) + width, -1, np.int64)
    begin, end = max(0, lowest), min(len(text), lowest + len(item) + width)
    if end > begin:
        padded[begin - lowest : end - lowest] = text[begin:end]
    for i, c in enumerate(item):
        step = row + (padded[i : i + width] != c)
        step[(lowest + i + d < 0) | (lowest + i + d >= len(text))] = far
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - d) + d
    best = int(row.argmin())
    return int(row[best]), lowest + best


def parts(items: DataFrame) -> list[list[tuple[int, bytes]]]:
    """The items in parts of bounded size; one part at a time is fetched and used."""
    rows = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // PART + 1
    return [[(r.item_id, r.text.encode()) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p).collect()] for p in range(n)]


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item found in it."""
    out = None
    for part in parts(items):
        benchmark = Benchmark(part)

        def find(batch: pa.RecordBatch, benchmark: Benchmark = benchmark) -> dict | None:
            found = benchmark.search(texts(batch))
            ids = batch.column(0).to_pylist()
            return {
                "doc_id": [ids[n] for n, _, _, _ in found],
                "item_id": [benchmark.items[i][0] for _, i, _, _ in found],
                "place": [p for _, _, p, _ in found],
                "edits": [e for _, _, _, e in found],
                "similarity": [1 - e / len(benchmark.items[i][1]) for _, i, _, e in found],
            }

        one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches(find, MATCHES), MATCHES)
        out = one if out is None else out.unionByName(one)
    return out


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    for part in parts(items):
        benchmark = Benchmark(part)

        def choose(batch: pa.RecordBatch, benchmark: Benchmark = benchmark) -> pa.Array:
            hit = {n for n, _, _, _ in benchmark.search(texts(batch))}
            return pa.array([n not in hit for n in range(batch.num_rows)], pa.bool_())

        docs = filtered(docs, choose)
    return docs

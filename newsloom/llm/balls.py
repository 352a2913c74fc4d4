"""SimHash near copies by meet-in-the-middle ball hashing.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 values (seed 42, unsigned) of the
text's groups of ``SHINGLE`` words, repeats included (A-Z lower-cased, joined by one space; a shorter text has its whole
sequence as one group, a text without words the fingerprint zero).

1. Equal fingerprints become one node, so a crowd of copies is one row from here on.
2. Every node emits all fingerprints within half the radius of its own: at radius 2 itself and 64 with one bit turned. Two
   nodes within the radius have a point half-way between them, so they meet there; two that meet are
   within the radius, since neither is further than half of it away.
3. Nodes are shuffled on these points. A point has only as many fingerprints around it as its ball holds (65), whatever the
   documents, so no key is hot. At each point the least node is linked with every other one; that joins the same
   nodes as all pairs would. Links are made distinct, since two nodes meet at several points, and verified.
4. Components over the links; each takes the least ``doc_id`` of its nodes' documents.

Null and empty texts have fingerprint zero and are linked like any other. Rows without id link like others, never name a
component, and have a null one if no row that they reach has an id. Rows that repeat an id are documents of their own:
each has the component of its own text. An empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.columns import batches, saved, texts
from newsloom.llm.links import components
from newsloom.llm.longtext import word_chunks

SHINGLE, SEED, RADIUS, BITS = 3, 42, 2, 64
#: Four counters of 16 bits share a word while votes are counted; parts of a text are too short to overflow them.
LANE = 16
ONES = np.uint64(sum(1 << i for i in range(0, BITS, LANE)))
FULL = np.uint64((1 << LANE) - 1)


def votes(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """How many values of each part (its first place in ``firsts``) have each bit set, at most 65,535."""
    out = np.empty((len(firsts), BITS), np.int64)
    for shift in range(LANE):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & ONES, firsts)
        for base in range(0, BITS, LANE):
            out[:, base + shift] = (sums >> np.uint64(base)) & FULL
    return out


def simhashes(found: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of every text, as signed 64-bit numbers."""
    parts, owners = [], []
    for doc, text in enumerate(found):
        for words in word_chunks(text.lower(), shingle - 1):
            if words:
                groups = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
                parts.append([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in groups])
                owners.append(doc)
    set_in, of = np.zeros((len(found), BITS), np.int64), np.zeros(len(found), np.int64)
    if parts:
        sizes = np.array([len(p) for p in parts])
        hashes = np.fromiter((h for p in parts for h in p), np.uint64, sizes.sum())
        np.add.at(set_in, owners, votes(hashes, np.cumsum(sizes) - sizes))
        np.add.at(of, owners, sizes)
    won = (2 * set_in > of[:, None]).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(won, axis=1).view(np.int64)


def fingerprint(batch: pa.RecordBatch, shingle: int) -> dict:
    return {"doc_id": batch.column(1), "fp": simhashes(texts(batch), shingle)}


def ball(fp: Column, half: int) -> Column:
    """All fingerprints at most ``half`` bits away, as an array."""
    masks = [sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(BITS), n)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    return F.transform(F.array(*map(F.lit, signed)), lambda m: fp.bitwiseXOR(m))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a``, ``b``: links that join the distinct fingerprints ``fp`` within ``radius`` bits, an even number."""
    if radius % 2:
        raise ValueError("the radius must be even, so that all that meet are within it")
    points = nodes.select("fp", F.explode(ball(F.col("fp"), radius // 2)).alias("point"))
    met = points.withColumn("a", F.min("fp").over(Window.partitionBy("point"))).where("a < fp")
    pairs = met.select("a", F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_fingerprints(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of every row."""
    schema = "doc_id long, fp long"
    docs = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    marked = saved(docs.mapInArrow(batches(partial(fingerprint, shingle=shingle), schema), schema))
    nodes = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    state = components(saved(links(nodes, radius))).select(F.col("doc_id").alias("fp"), "comp")
    placed = saved(nodes.join(state, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"), "least"))
    named = saved(placed.groupBy("comp").agg(F.min("least").alias("component_id")))
    of = saved(placed.select("fp", "comp").join(named, "comp").select("fp", "component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(of, "fp").select("doc_id", text, "component_id")

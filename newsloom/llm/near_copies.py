"""Near copies: MinHash bands, sequential Bayesian pruning, exact verification, components.

A document's set holds its distinct groups of ``shingle`` words (A-Z lower-cased), as 64-bit hashes; a shorter text
has its whole sequence as one. Documents whose sets have a Jaccard similarity of at least 80 % are linked.

1. Every text gets 128 MinHash values of 16 bits; four in a row are a band and fit one long. Each distinct set is
   one node from here on, numbered by the first row that has it.
2. Each band value shared by several nodes has a hub, the least of them. Pairs with the hub are
   candidates. Sets whose sizes differ by more than a fifth cannot be similar enough; the others are compared ``BATCH``
   values at a time: with a uniform prior, ``m`` of ``n`` equal values leave similarity at least t with probability
   P(Bin(n + 1, t) <= m); a pair is dropped as soon as that is under ``MISS``. Pairs that come through are
   verified on the full sets.
3. Band values whose members are not all in one component yet are searched in full: members meet in blocks of
   about ``BLOCK`` nodes and ``MOST_SHINGLES`` shingles (so no crowd fills a task), and pairs of different components are pruned the same
   way, each under the first band value that it shares. What comes through is not listed as pairs: a node carries its likely
   partners as one array, each block gets the full sets of the nodes involved once, and verifies there, skipping pairs that
   the block has joined meanwhile. It gives fewer links than it has nodes, and the same components as all pairs would.
4. Components take the least id of their rows.

A pair at similarity 0.8 shares no band with probability 5e-8.

Null and empty texts have an empty set and no links. Rows without id link with nothing, have a null component
and are kept. Rows that repeat an id are documents of their own: each has the component of its own text, so one id can be in two
components, and every component keeps the rows of its least id. An empty table gives an empty one; extra columns are ignored by
``near_copies`` and kept by ``without_near_copies``.
"""

from __future__ import annotations

from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.columns import batches, saved, texts
from newsloom.llm.links import components
from newsloom.llm.wordhash import hashes, inside, rolling

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
BATCH, MISS = 16, 1e-4
BLOCK = 1_500
#: Shingles hashed together.
CHUNK = 4_096
#: Shingles of the members of a block, on average at most.
MOST_SHINGLES = 2_000_000
#: Bits of a sieve at most.
SIEVE = 1 << 27

_random = np.random.default_rng(20240131)
MULTIPLY = _random.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 2**63, VALUES, dtype=np.uint64)


def least_equal() -> np.ndarray:
    """For every batch, how many of the values so far must be equal for a pair to go on."""
    t = PERCENT / 100
    out = []
    for n in range(BATCH, VALUES + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= MISS:
                break
            m += 1
        out.append(m)
    return np.array(out)


NEEDED = least_equal()


def shingle_sets(found: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct hashes of every ``shingle`` words in a row, for every text."""
    docs = [t.lower().split() for t in found]
    words, starts = hashes(docs)
    at, _ = inside(starts, shingle)
    rolled = rolling(words, shingle)[at] if len(at) else np.empty(0, np.uint64)
    ends = np.cumsum(np.maximum(np.diff(starts) - shingle + 1, 0))
    out = []
    for i, doc in enumerate(docs):
        if len(doc) >= shingle:
            out.append(np.unique(rolled[ends[i] - (len(doc) - shingle + 1) : ends[i]]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(doc))] if doc else [], np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), CHUNK):
        least = np.minimum(least, (shingles[None, i : i + CHUNK] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1))
    return (least >> np.uint64(48)).astype(np.uint16)


def keys(sets: list[np.ndarray]) -> list[bytes | None]:
    return [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]


def sign(batch: pa.RecordBatch, shingle: int) -> dict:
    sets = shingle_sets(texts(batch), shingle)
    return {
        "row": batch.column(1),
        "doc_id": batch.column(2),
        "text_key": batch.column(3),
        "n_shingles": [len(s) for s in sets],
        "set_key": keys(sets),
        "bands": [signature(s).view(np.int64) if len(s) else None for s in sets],
    }


SIGNED = "row long, doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>"
PAIR = "a long, b long"


def surviving(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two blocks of signatures come through the sequential test."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step, needed in enumerate(NEEDED):
        part = slice(step * BATCH, (step + 1) * BATCH)
        equal = equal + (a[alive, part] == b[alive, part]).sum(axis=1)
        on = equal >= needed
        alive, equal = alive[on], equal[on]
    return alive


def values_of(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64).reshape(-1, BANDS).view(np.uint16)


def comparable(a, b):
    """Whether sets of these sizes can be similar enough; for arrays and columns."""
    return (100 * a >= PERCENT * b) & (100 * b >= PERCENT * a)


def prune(batch: pa.RecordBatch) -> dict:
    alive = pa.array(surviving(values_of(batch.column(2)), values_of(batch.column(3))))
    return {"a": batch.column(0).take(alive), "b": batch.column(1).take(alive)}


PARTNERS = "band int, value long, i int, j int, node long, comp long, partners array<long>"


def search_blocks(group: pa.Table) -> pa.Table:
    """Nodes of a block, or of its two halves, with partners of other components that come through the test.

    Of every pair one side at least is outside the commonest component, so only nodes outside it look for
    partners. Each pair stands with one of its nodes; partners have a row of their own.
    """
    ids, parts, sizes = (group.column(c).to_numpy() for c in ("node", "comp", "n_shingles"))
    left = group.column("is_left").to_numpy(zero_copy_only=False)
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    values, band = bands.view(np.uint16), group.column("band")[0].as_py()
    same = bool(group.column("same")[0].as_py())
    kinds, counts = np.unique(parts, return_counts=True)
    outside = parts != kinds[counts.argmax()]
    everyone = np.arange(len(ids))
    sides = (everyone, everyone) if same else (np.flatnonzero(left), np.flatnonzero(~left))
    found: dict[int, np.ndarray] = {}
    for i in np.flatnonzero(outside):
        others = sides[1] if same or left[i] else sides[0]
        # of two nodes outside, the first one looks
        rest = others[(parts[others] != parts[i]) & (~outside[others] | (others > i)) & comparable(sizes[others], sizes[i])]
        # a pair is looked at once, under the first band value that it shares
        rest = rest[(bands[rest] == bands[i]).argmax(axis=1) == band]
        if len(rest):
            hit = rest[surviving(np.broadcast_to(values[i], (len(rest), VALUES)), values[rest])]
            if len(hit):
                found[i] = hit
    involved = sorted(set(found).union(*found.values()))
    at = np.array(involved, np.int64)
    same_for_all = {c: pa.repeat(group.column(c)[0], len(at)) for c in ("band", "value", "i", "j")}
    partners = pa.array([ids[found[i]] if i in found else [] for i in involved], pa.list_(pa.int64()))
    return pa.table(same_for_all | {"node": ids[at], "comp": parts[at], "partners": partners})


def link_block(group: pa.Table) -> pa.Table:
    """Links that join the components of the nodes of a block wherever one of their likely pairs is similar enough."""
    ids, comps = group.column("node").to_numpy(), group.column("comp").to_numpy()
    shingles = group.column("shingles").combine_chunks()
    sizes = np.diff(shingles.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    _, codes = np.unique(shingles.flatten().to_numpy(), return_inverse=True)
    partners = group.column("partners").to_pylist()
    order = np.argsort(ids)
    top = {c: c for c in comps.tolist()}

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    marks = np.zeros(len(codes), bool)
    links = []
    for i, named in enumerate(partners):
        if not named:
            continue
        own = codes[starts[i] : starts[i] + sizes[i]]
        marks[own] = True
        at = order[np.searchsorted(ids, named, sorter=order)]
        while len(at):
            mine = find(int(comps[i]))
            at = at[[find(c) != mine for c in comps[at].tolist()]]
            # as many as fit a piece, one at least
            some = at[: max(1, int(np.searchsorted(np.cumsum(sizes[at]), CHUNK * 64)))]
            at = at[len(some) :]
            if not len(some):
                break
            ends = np.cumsum(sizes[some])
            spots = np.arange(ends[-1]) + np.repeat(starts[some] - (ends - sizes[some]), sizes[some])
            shared = np.add.reduceat(marks[codes[spots]].astype(np.int64), ends - sizes[some])
            for k in some[100 * shared >= PERCENT * (sizes[i] + sizes[some] - shared)]:
                x, y = find(int(comps[i])), find(int(comps[k]))
                if x != y:
                    top[max(x, y)] = min(x, y)
                    links.append((ids[i], ids[k]))
        marks[own] = False
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table({"a": a, "b": b})


def sieve(ids: DataFrame) -> tuple[np.ndarray, int]:
    """Bits that are set for all of ``ids`` (one column ``doc_id``) and few others: at most ``SIEVE`` bits, whatever the input."""
    bits = 1 << 15
    n = ids.count()
    while bits < min(SIEVE, 16 * n):
        bits *= 2
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    block = F.floor(spot / (1 << 15)).cast("int").alias("block")
    rows = ids.groupBy(block).agg(F.bitmap_construct_agg(spot % (1 << 15)).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r.block << 12 : (r.block + 1) << 12] = np.frombuffer(bytes(r.bits), np.uint8)
    return out, bits


def full_sets(nodes: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``node`` and ``shingles`` for every one of ``nodes``, built again from the documents.

    A sieve of bounded size keeps most other documents from leaving their task; the join settles the rest.
    """
    needed = saved(reps.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "set_key"))
    marks, bits = sieve(needed.select("doc_id").distinct())

    def rebuild(batch: pa.RecordBatch) -> dict | None:
        spot = batch.column(2).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(marks[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
        if not len(at):
            return None
        sets = shingle_sets(texts(batch.take(pa.array(at))), shingle)
        ends = np.cumsum([0] + [len(s) for s in sets])
        values = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
        return {"doc_id": batch.column(1).take(pa.array(at)), "set_key": keys(sets), "shingles": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))}

    schema = "doc_id long, set_key binary, shingles array<long>"
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("spot")
    built = docs.where("doc_id is not null").select("text", "doc_id", spot).mapInArrow(batches(rebuild, schema), schema)
    # rows that repeat id and text build the same set
    return saved(built.join(needed, ["doc_id", "set_key"]).select("node", "shingles").dropDuplicates(["node"]))


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    sets = full_sets(nodes, reps, docs, shingle)
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * shared >= PERCENT * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def searched(members: DataFrame, reps: DataFrame, state: DataFrame) -> DataFrame:
    """``PARTNERS`` of the band values that hold several components."""
    placed = members.join(state, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_values = saved(placed.groupBy("band", "value").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("band", "value"))
    left = placed.join(open_values, ["band", "value"]).join(reps.select("node", "n_shingles", "bands"), "node")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / MOST_SHINGLES)).cast("int")
    dealt = (
        left.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("node"), blocks).cast("int")})
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp", "n_shingles", "bands", (F.col("own") <= F.col("other")).alias("is_left"), (F.col("own") == F.col("other")).alias("same"))
    )
    # a block alone holds no row of the others, so ``same`` is one value in a group
    return dealt.groupBy("band", "value", "i", "j").applyInArrow(search_blocks, PARTNERS)


def components_of_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """``row``, ``doc_id``, ``text_key``, ``n_shingles`` and ``component_id`` of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.select("text", F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"))
    signed = saved(rows.mapInArrow(batches(partial(sign, shingle=shingle), SIGNED), SIGNED))
    whole = signed.where("doc_id is not null and set_key is not null")
    groups = whole.groupBy("set_key").agg(F.min("row").alias("node"), F.max("row").alias("last"))
    # written first, so that a set with a large share of the rows can be split in the join
    repeated = saved(groups.where("node < last").select("set_key", "node"))
    copies = saved(whole.select("row", "set_key").join(repeated, "set_key").where("row <> node").select("row", "node"))
    reps = saved(whole.join(copies.select("row"), "row", "left_anti").select(F.col("row").alias("node"), "doc_id", "n_shingles", "set_key", "bands"))

    by_value = reps.select("node", "n_shingles", F.posexplode("bands").alias("band", "value"))
    crowds = by_value.groupBy("band", "value").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    members = saved(by_value.drop("n_shingles").join(saved(crowds.where("hub < last").drop("last")), ["band", "value"]))
    of = lambda side: reps.select(F.col("node").alias(side), F.col("bands").alias(f"of_{side}"), F.col("n_shingles").alias(f"n_{side}"))
    pairs = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    sized = pairs.join(of("b"), "b").join(of("a"), "a").where(comparable(F.col("n_a"), F.col("n_b")))
    likely = saved(sized.select("a", "b", "of_a", "of_b").mapInArrow(batches(prune, PAIR), PAIR))
    links = saved(verified(likely, reps, docs, shingle))
    state = components(links).withColumnRenamed("doc_id", "node")

    # band values that still hold several components
    found = saved(searched(members, reps, state))
    sets = full_sets(found, reps, docs, shingle)
    involved = found.join(sets, "node").groupBy("band", "value", "i", "j").applyInArrow(link_block, PAIR)
    state = components(links.unionByName(saved(involved))).withColumnRenamed("doc_id", "node")

    node = F.when(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull(), F.coalesce("node", "row")).alias("node")
    placed = signed.drop("bands").join(copies, "row", "left").select("row", "doc_id", "text_key", "n_shingles", node)
    placed = saved(placed.join(state, "node", "left").withColumn("comp", F.coalesce("comp", "node")).drop("node"))
    least = saved(placed.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")))
    return placed.join(least, "comp", "left").select("row", "doc_id", "text_key", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def is_kept() -> Column:
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))


def near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row."""
    return components_of_rows(docs, shingle).select("doc_id", "n_shingles", "component_id", is_kept().alias("kept"))


def without_near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents that are the first of their component, with all their columns."""
    # by id and text, since rows that repeat an id may be in different components
    gone = components_of_rows(docs, shingle).where(~is_kept()).select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_text")).distinct()
    same = (F.col("doc_id").cast("long") == F.col("_gone")) & (F.xxhash64("text") == F.col("_text"))
    # these ids grow with the documents, so they are not sent to all tasks even where they are still few
    return docs.join(gone.hint("merge"), same, "left_anti")

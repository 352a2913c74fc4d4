"""Importance resampling towards a target: hashed word runs, log-likelihood gains, Gumbel draws.

A text's bytes go through one table of 256 entries that lower-cases A-Z and blanks every ASCII byte that is neither a letter
nor a digit; ``bytes.split`` yields the words. Features are all runs of 1 to ``LONGEST`` words, and a feature's bucket is the crc32
of its bytes (words joined by one space) modulo ``BUCKETS``: the crc32 of a longer run goes on from the shorter one's.

1. Counters add up the buckets of all documents and of all target texts, task by task, then in Spark.
2. A bucket's gain is ``floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS))))``; the table of ``BUCKETS`` whole
   numbers goes to all tasks.
3. Every document gets the sum of its features' gains and a Gumbel variable drawn from its id by SHA-256, so that the highest
   sums are a sample without replacement in proportion to the weights, the same on every run.
4. Documents with at least ``LEAST`` words are ordered in ranges of their scores, each numbered by its own task and
   moved on by the sizes of the ranges before it (one number a task comes to the driver). No task sees all rows.

Null and empty texts have no features and weight 0. A null id draws like an empty one and comes after all others at a tie.
Rows that repeat an id have the same draw; at equal scores those with more features come first. Empty tables on either
side are fine: without target texts ``t = T = 0``. Extra columns are ignored by ``ranked`` and kept by ``drawn``.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.columns import batches, filtered, pieces, saved, texts
from newsloom.llm.longtext import word_chunks
from newsloom.llm.neighbours import constant

LONGEST, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024
TABLE = bytes(b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if b >= 128 or chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def features(text: bytes, longest: int) -> tuple[Counter, int, int]:
    """How often each crc32 occurs among a text's features, the number of features, and of words."""
    found, n_features, n_words, old = Counter(), 0, 0, 0
    for words in word_chunks(text.translate(TABLE), longest - 1):
        # runs that end in the words carried over were counted with the part before
        new = words[old:]
        n_words += len(new)
        for word, n in Counter(new).items():
            found[crc32(word)] += n
        n_features += len(new)
        ends = list(map(crc32, words)) if longest > 1 else []
        for length in range(2, longest + 1):
            ends = [crc32(word, crc32(b" ", seed)) for seed, word in zip(ends, words[length - 1 :])]
            fresh = ends[max(0, old - length + 1) :]
            found.update(fresh)
            n_features += len(fresh)
        old = min(len(words), longest - 1)
    return found, n_features, n_words


def counting(longest: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that adds up a task's buckets."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in found:
            for piece in pieces(batch):
                both = Counter()
                for text in texts(piece):
                    for hashed, n in features(text, longest)[0].items():
                        both[hashed % buckets] += n
                for bucket, n in both.items():
                    total[bucket] += n
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bucket", "n"])

    return run


def bucket_counts(rows: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts of ``rows`` fall into each bucket; ``buckets`` rows at most come to the driver."""
    counted = rows.select("text").mapInArrow(counting(longest, buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> list[int]:
    """Whole thousandths of the log-likelihood that a feature of each bucket speaks for the target."""
    buckets, of_raw, of_target = len(raw), int(raw.sum()), int(target.sum())
    return [math.floor(1000 * math.log((int(t) + 1) * (of_raw + buckets) / ((int(s) + 1) * (of_target + buckets)))) for s, t in zip(raw, target)]


def gumbel(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel variable that depends on the id alone, rounded down."""
    named = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(named.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_features long, n_words long, weight long, score long"


def scoring(table: list[int], longest: int, seed: int) -> Callable[[pa.RecordBatch], dict]:
    def score(batch: pa.RecordBatch) -> dict:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        found = [features(t, longest) for t in texts(batch)]
        weights = [sum(table[h % len(table)] * n for h, n in counts.items()) for counts, _, _ in found]
        return {
            "doc_id": ids,
            "n_features": [f[1] for f in found],
            "n_words": [f[2] for f in found],
            "weight": weights,
            "score": [w + gumbel(i, seed) for w, i in zip(weights, ids.to_pylist())],
        }

    return score


def in_order(scored: DataFrame) -> DataFrame:
    """``scored`` with ``part``, the number of its range of the order, and ``pos``, its place there from 1."""
    # the last key parts rows that are equal in all others, so that no crowd of them fills a range
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.asc("_row")]

    def number(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in found:
            places = np.arange(done + 1, done + batch.num_rows + 1)
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.full(len(places), part, np.int32)), pa.array(places)], names=[*batch.schema.names[:-1], "part", "pos"])

    rows = scored.withColumn("_row", F.monotonically_increasing_id())
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{SCORED}, part int, pos long")


def scores(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_features``, ``n_words``, ``weight`` and ``score`` of every row."""
    table = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    ids = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    return ids.mapInArrow(batches(scoring(table, longest, seed), SCORED), SCORED)


def ranked(docs: DataFrame, target: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row; rows that are not drawn have no rank."""
    scored = saved(scores(docs, target, longest))
    placed = saved(in_order(scored.where(F.col("n_words") >= least)))
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = np.cumsum([0] + [sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)]).tolist()
    drawn = percent * before[-1] // 100
    place = F.get(constant(before, "long"), F.col("part")) + F.col("pos")
    out = placed.select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))
    rest = scored.where(F.col("n_words") < least).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return out.unionByName(rest)


def drawn(docs: DataFrame, target: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that the sample takes, with all their columns.

    Rows that equal the last one taken in id, score and number of features all come.
    """
    table = gains(bucket_counts(docs, longest, BUCKETS), bucket_counts(target, longest, BUCKETS))
    score = scoring(table, longest, SEED)
    ids = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    pool = saved(ids.mapInArrow(batches(score, SCORED), SCORED)).where(F.col("n_words") >= least)
    placed = saved(in_order(pool))
    sizes = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    left = percent * sum(n for _, n in sizes) // 100
    if not left:
        return docs.limit(0)
    for part, n in sizes:
        if left <= n:
            break
        left -= n
    last = placed.where((F.col("part") == part) & (F.col("pos") == left)).first()
    key = lambda score, doc_id, n: (-score, doc_id is None, doc_id or 0, -n)
    limit = key(last.score, last.doc_id, last.n_features)

    def choose(batch: pa.RecordBatch) -> pa.Array:
        found = score(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).field("doc_id").cast(pa.int64())], names=["text", "doc_id"]))
        rows = zip(found["score"], found["doc_id"].to_pylist(), found["n_features"], found["n_words"])
        return pa.array([w >= least and key(s, i, n) <= limit for s, i, n, w in rows], pa.bool_())

    return filtered(docs, choose)


def resampling_sql(docs: str, target: str, least: int = LEAST, percent: int = PERCENT, buckets: int = BUCKETS, seed: int = SEED) -> str:
    """The ranking for single words, with crc32 bit by bit."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    byte = "('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::bigint"
    eight = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"""
with doc_words as (select row_number() over () as rid, doc_id, {found} as words from {docs}),
used as (select rid, unnest(words) as word from doc_words),
wanted as (select unnest({found}) as word from {target}),
hashed as (
  select word, xor(list_reduce(list_concat([4294967295::bigint], [{byte} for i in range(1, octet_length(encode(word)) + 1)]), lambda c, b: {eight}), 4294967295) % {buckets} as bucket
  from (select distinct word from (select word from used union all select word from wanted))),
of_raw as (select bucket, count(*) as s from used join hashed using (word) group by bucket),
of_target as (select bucket, count(*) as t from wanted join hashed using (word) group by bucket),
gained as (
  select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from used) + {buckets}) / ((coalesce(s, 0) + 1)::double * ((select count(*) from wanted) + {buckets})))) as bigint) as gain
  from of_raw full join of_target using (bucket)),
weighed as (select rid, cast(sum(gain) as bigint) as weight from used join hashed using (word) join gained using (bucket) group by rid),
scored as (
  select rid, doc_id, len(words) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint + 0.5) / 4294967296))) as bigint) as score
  from doc_words left join weighed using (rid)),
placed as (
  select rid, row_number() over (order by score desc, doc_id nulls last, n_features desc) as place, count(*) over () as n
  from scored where n_features >= {least})
select doc_id, n_features, weight, score, case when place <= {percent} * n // 100 then place end as rank
from scored left join placed using (rid)
"""

"""Joins of 64-bit hashes by Hamming distance, exact, without comparing all pairs.

The hash is cut into ``t + m`` blocks. Two hashes at most ``t`` bits apart agree
on at least ``m`` blocks, so they meet under one of the keys that keep exactly
``m`` blocks (Manku, Jain, Das Sarma 2007). More blocks make more, but rarer keys.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.hashing import hamming
from newsloom.session import spread

BITS = 64
# Rows of one bucket that one task compares with another such chunk.
CHUNK_ROWS = 20_000


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def key_masks(t: int, kept_blocks: int) -> list[int]:
    """Bit masks of all ways to keep ``kept_blocks`` out of ``t + kept_blocks`` blocks."""
    blocks = t + kept_blocks
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(parts, kept_blocks)]


def blocks_to_keep(n: int, t: int) -> int:
    """How many blocks a key keeps, so that unrelated hashes seldom share one of ``n`` rows' keys."""
    for m in (1, 2):
        if n <= 2 ** (BITS * m / (t + m) + 1):
            return m
    return 3


def _keyed(df: DataFrame, hash_col: str, t: int, kept_blocks: int) -> DataFrame:
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("no"), F.col(hash_col).bitwiseAND(F.lit(mask)).alias("key"))
            for i, mask in enumerate(key_masks(t, kept_blocks))
        ]
    )
    return df.withColumn("_bucket", F.explode(keys)).select("*", "_bucket.*").drop("_bucket")


def _chunks(keyed: DataFrame, name: str, chunk_rows: int) -> DataFrame:
    """Buckets with more rows than a chunk, and into how many chunks they are cut."""
    counts = keyed.groupBy("no", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows)
    return counts.select("no", "key", F.ceil(F.col("n") / chunk_rows).cast("int").alias(name))


def near_pairs(
    left: DataFrame,
    right: DataFrame,
    t: int,
    n: int,
    condition: Column | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows of ``left`` beside rows of ``right`` whose hashes ``lh`` and ``rh`` are at most ``t`` apart.

    A pair may come once per key it shares: callers aggregate per ``lh`` straight
    away, and the aggregate's map side runs in the joining task, so pairs are
    neither shuffled nor stored. ``left`` and ``right`` hold distinct hashes, so
    copies of one text count once. ``n`` bounds the rows of either side; a bucket
    larger than ``chunk_rows`` is cut into chunks on both sides and joined chunk
    by chunk in separate tasks. ``left`` is a plain scan: few bytes make many pairs, so it is dealt out to all task slots.
    """
    left = spread(left)
    kept = blocks_to_keep(n, t)
    lk, rk = _keyed(left, "lh", t, kept), _keyed(right, "rh", t, kept)
    on = ["no", "key"]
    if n > chunk_rows:
        cuts = _chunks(lk, "l_cuts", chunk_rows).join(
            _chunks(rk, "r_cuts", chunk_rows), ["no", "key"], "full_outer"
        )
        l_cuts, r_cuts = F.coalesce("l_cuts", F.lit(1)), F.coalesce("r_cuts", F.lit(1))
        lk = (
            lk.join(cuts, ["no", "key"], "left")
            .withColumn("l_chunk", F.pmod(F.xxhash64("lh"), l_cuts).cast("int"))
            .withColumn("r_chunk", F.explode(F.sequence(F.lit(0), r_cuts - 1)))
            .drop("l_cuts", "r_cuts")
        )
        rk = (
            rk.join(cuts, ["no", "key"], "left")
            .withColumn("r_chunk", F.pmod(F.xxhash64("rh"), r_cuts).cast("int"))
            .withColumn("l_chunk", F.explode(F.sequence(F.lit(0), l_cuts - 1)))
            .drop("l_cuts", "r_cuts")
        )
        on = ["no", "key", "l_chunk", "r_chunk"]
    near = hamming(F.col("lh"), F.col("rh")) <= t
    if condition is not None:
        near = near & condition
    return lk.join(rk, on).where(near).drop(*on)

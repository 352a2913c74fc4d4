"""Approximate nearest-vector search by sign projections, as an option beside the exact one.

A vector's key in a table is the signs of its products with ``bits`` random directions. Two vectors at angle a agree in one sign
with probability ``1 - a / pi`` (Charikar 2002), so as many tables are made as let a pair at the ``likely``
cosine meet with probability ``recall``; better pairs meet more often. Pairs that meet are compared exactly, so a
result may lack a match and never has a wrong one. Directions come from a fixed seed: reruns agree.

Keys get more bits with more vectors, so that a key holds about ``KEY_ROWS`` vectors if they are spread evenly, as long as ``MOST_TABLES``
tables do: every vector is shuffled once a table, so more tables would move more than the exact join does. Keys with more
than a block's rows are cut into chunks on both sides, as in the exact join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.blocks import matrix

KEY_ROWS, LEAST_BITS, MOST_BITS, MOST_TABLES = 64, 4, 24, 32
SEED = 20240131


@dataclass(frozen=True)
class Lsh:
    """Wanted: pairs with a cosine of ``likely`` (by default the search's own least score) are found with probability ``recall``."""

    likely: float | None = None
    recall: float = 0.95


def plan(n: int, likely: float, recall: float) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` vectors.

    Fewer bits than the vectors would allow, if else more than ``MOST_TABLES`` tables were needed; never less recall.
    """
    same = 1 - math.acos(max(-1.0, min(1.0, likely))) / math.pi
    if same >= 1:
        return LEAST_BITS, 1
    bits = max(LEAST_BITS, min(MOST_BITS, round(math.log2(max(1, n / KEY_ROWS)))))
    while True:
        miss = math.log1p(-(same**bits))
        tables = math.ceil(math.log(1 - recall) / miss) if miss < 0 else MOST_TABLES + 1
        if tables <= MOST_TABLES or bits == 1:
            return bits, max(1, tables)
        bits -= 1


def with_keys(df: DataFrame, bits: int, tables: int) -> DataFrame:
    """``df`` once for every table: ``table_no`` and ``key``."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]

    def run(batches):
        weights, directions = (1 << np.arange(bits)).astype(np.int64), None
        for batch in batches:
            rows = matrix(batch.column("embedding"))
            if directions is None and len(rows):
                directions = np.random.default_rng(SEED).normal(size=(rows.shape[1], tables * bits))
            signs = (rows @ directions > 0).reshape(len(rows), tables, bits) if len(rows) else np.zeros((0, tables, bits), bool)
            keys = (signs * weights).sum(axis=2)
            yield batch.append_column("keys", pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64())))

    keyed = df.mapInArrow(run, ", ".join([*fields, "keys array<bigint>"]))
    return keyed.select(*df.columns, F.posexplode("keys").alias("table_no", "key"))


def meeting(queries: DataFrame, stored: DataFrame, n: int, likely: float, recall: float, block_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the columns by which pairs meet in blocks, and these columns' names."""
    bits, tables = plan(n, likely, recall)
    on = ["table_no", "key"]
    left, right = with_keys(queries, bits, tables), with_keys(stored, bits, tables)

    def crowded(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
        return counts.select(*on, F.ceil(F.col("n") / block_rows).cast("int").alias(name))

    cuts = crowded(left, "q_cuts").join(crowded(right, "s_cuts"), on, "full_outer")

    def chunked(df: DataFrame, own: str, other: str) -> DataFrame:
        count = lambda side: F.coalesce(f"{side}_cuts", F.lit(1))
        cut = df.join(cuts, on, "left").withColumn(f"{own}_chunk", F.pmod(F.xxhash64("id"), count(own)).cast("int"))
        return cut.withColumn(f"{other}_chunk", F.explode(F.sequence(F.lit(0), count(other) - 1))).drop("q_cuts", "s_cuts")

    return chunked(left, "q", "s"), chunked(right, "s", "q"), [*on, "q_chunk", "s_chunk"]

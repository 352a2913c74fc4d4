"""Labelled training rows: which documents may teach, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column | str, n: int) -> Column:
    """``crc32`` of the id's digits modulo ``n``; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % n


def held_out(n: int, rest: int) -> Column:
    """Whether the row must not teach. A row without id is never held out; as it has no label, it never teaches."""
    return F.coalesce(remainder("doc_id", n) == rest, F.lit(False))


def label_sample(labels: DataFrame, label: str, n: int, rest: int, rows: int) -> DataFrame:
    """``doc_id``, ``label`` and ``weight`` of at most ``rows`` labelled ids of each class, those with the least hash.

    Held-out ids and null labels are left out; an id with several labels has the largest. The weight is the number of
    ids of the class for each one taken: 1 where all are taken, so that weighted sums have the true class shares at every size.
    """
    known = labels.where(~held_out(n, rest) & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("label"))
    order = F.xxhash64(F.lit(11), "doc_id")
    totals = {r.label: r["count"] for r in one.groupBy("label").count().collect()}

    def taken(of: int) -> DataFrame:
        return one.where(F.col("label") == of).orderBy(order).limit(rows).withColumn("weight", F.lit(max(1.0, totals.get(of, 0) / rows)))

    return taken(1).unionByName(taken(0))

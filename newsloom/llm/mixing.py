"""Mixing sources to target weights by nested hash thresholds.

Every document has a hash of its id. A source that shall give ``f`` times its size gives each document
``floor(f)`` times, and once more those whose hash lies under the source's threshold. The threshold is found
by histograms: words are summed by source and leading hash bits, the running sums of the at most ``BUCKETS``
rows of a source show the bucket in which the budget is used up, and only the documents of that one bucket are
summed again by the next bits. After ``LEVELS`` rounds a bucket holds one id; it is taken if that brings the
source nearer to its target. Nothing is sorted by hash, and a source of any size is only ever seen as its
partial sums.

Targets: sources in code point order, null last, get the weights ``WEIGHTS`` in turn. They share ``share`` times
all words by weight; no source gets more than ``most`` times its own words, and what is cut off is shared again
by weight until no source is above. The level ``t`` at which the sum of ``min(weight * t, most * size)`` is the
budget follows from one running sum over the sources (one row each).

Null texts have size 0 and are taken 0 words. Null ids hash as one id; rows that repeat an id share its hash, so
they are taken together. An empty table gives an empty one. Extra columns are ignored by ``mix`` and kept by
``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.columns import WORD, saved

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Bits of the hash that a histogram tells apart, and how many histograms follow each other.
BITS, LEVELS = 12, 5
BUCKETS = 1 << BITS


def hash_of(doc_id: Column) -> Column:
    """60 bits from the MD5 of the id's digits."""
    digits = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digits, 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        hash_of(F.col("doc_id")).alias("hash"),
    )


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of every source; ``sizes`` has ``source`` and ``size``."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    # in the order in which sources reach their cap, the level is fixed by those not yet capped
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (share * F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    capped = sources.withColumn("level", level).withColumn("cap", most * F.col("source_size"))
    # the first source whose cap is above its share at its level is not capped, nor are those behind it; its level is theirs,
    # the greatest from there on
    free = F.col("weight") * F.col("level") <= F.col("cap")
    final = F.max(F.when(free, F.col("level"))).over(whole)
    return capped.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * final, F.col("cap"))).cast("double").alias("target"))


def prefix(level: int) -> Column:
    """The hash bits that histograms up to ``level`` tell apart."""
    return F.shiftright("hash", 60 - BITS * (level + 1))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``times`` and ``below``: documents under that hash count once more."""
    part = F.col("target") / F.col("source_size")
    times = F.when(F.col("source_size") > 0, F.floor(part + 1e-12)).otherwise(0).cast("long")
    state = targets.withColumn("times", times).withColumn("left", F.col("target") - F.col("times") * F.col("source_size")).withColumn("bucket", F.lit(0).cast("long"))
    for level in range(LEVELS):
        # only documents of the bucket in which the budget ends are summed again
        near = sizes.join(state.select(F.col("source").alias("s"), "bucket"), F.col("s").eqNullSafe(F.col("source")) & ((F.col("bucket") == prefix(level - 1)) if level else F.lit(True)))
        histogram = near.groupBy("source", prefix(level).alias("b")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
        histogram = histogram.withColumn("upto", running)
        found = histogram.join(state.select(F.col("source").alias("s"), "left"), F.col("s").eqNullSafe(F.col("source")))
        last = level == LEVELS - 1
        # the last bucket goes to the nearer side of the budget
        within = F.col("upto") - (F.col("words") / 2 if last else F.lit(0)) <= F.col("left")
        edge = found.groupBy("source").agg(
            F.coalesce(F.min(F.when(~within, F.col("b"))), F.max("b") + 1).alias("next"),
            F.coalesce(F.sum(F.when(within, F.col("words"))), F.lit(0)).alias("used"),
        )
        state = saved(
            state.join(edge.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source")), "left").select(
                "source", "source_size", "target", "times",
                (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
                F.coalesce(F.col("next"), F.shiftleft("bucket", BITS)).alias("bucket"),
            )
        )
    return state.select("source", "source_size", "target", "times", F.col("bucket").alias("below"))


def repeats(state_hash: Column) -> Column:
    """How often the mix takes a document, from its source's row."""
    return F.col("times") + (state_hash < F.col("below")).cast("long")


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and the words ``taken`` of every document."""
    sizes = saved(measured(docs))
    state = thresholds(sizes, source_targets(sizes, share, most)).withColumnRenamed("source", "s")
    found = sizes.join(state, F.col("s").eqNullSafe(F.col("source")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats(F.col("hash"))).alias("taken"))


def mixed(docs: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: the documents as often as it takes them, with ``copy`` (1, 2, ...) if that name is free."""
    sizes = saved(measured(docs))
    state = thresholds(sizes, source_targets(sizes, share, most)).select(F.col("source").alias("_source"), "times", "below")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col("source").alias("_key"), hash_of(F.col("doc_id")).alias("_hash"))
    taken = rows.join(state, F.col("_source").eqNullSafe(F.col("_key"))).withColumn("_taken", repeats(F.col("_hash"))).where("_taken > 0")
    copies = taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_taken")).alias("_copy"))
    extra = [] if "copy" in docs.columns else [F.col("_copy").alias("copy")]
    return copies.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], *extra)


#: DuckDB SQL for ``mix`` over ``{docs}``; histograms are replaced by one running sum over the hashes.
MIX_SQL = r"""
with recursive d as (
  select cast(doc_id as bigint) doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15) as bigint) hash
  from {docs}
), s as (
  select *, [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double weight
  from (select source, sum(size)::bigint source_size from d group by source)
), l as (
  select *, 2.0::double * source_size cap,
    (1.5::double * sum(source_size) over () - 2.0::double * coalesce(sum(source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level
  from s
), t as (
  select source, source_size, least(cap, coalesce(weight * max(case when weight * level <= cap then level end) over (), cap)) target from l
), n as (
  select *, case when source_size > 0 then floor(target / source_size + 1e-12) else 0 end times from t
), h as (
  select source, hash, sum(size) words from d group by source, hash
), r as (
  select h.*, sum(words) over (partition by h.source order by hash) upto, n.target - n.times * n.source_size budget
  from h join n on h.source is not distinct from n.source
), e as (
  select source, min(case when not (upto - words / 2.0 <= budget) then hash end) edge from r group by source
)
select d.doc_id, d.size::bigint size, n.source_size::bigint source_size, n.target,
  (d.size * (n.times + case when e.edge is null or d.hash < e.edge then 1 else 0 end))::bigint taken
from d join n on d.source is not distinct from n.source join e on d.source is not distinct from e.source
"""

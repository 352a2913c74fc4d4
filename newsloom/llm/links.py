"""Components of a table of links, without fetching any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.columns import saved


def components(links: DataFrame) -> DataFrame:
    """``doc_id`` and ``comp``, the least id reachable, for every id in ``links`` (longs ``a`` and ``b``)."""
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = saved(both.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("m")).select("doc_id", F.least("doc_id", "m").alias("comp")))
    while True:
        near = both.join(state.select(F.col("doc_id").alias("b"), F.col("comp").alias("of_b")), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("of_b").alias("m"))
        hooked = state.join(near, "doc_id").select("doc_id", F.col("comp").alias("was"), F.least("comp", "m").alias("next"))
        top = state.select(F.col("doc_id").alias("next"), F.col("comp").alias("top"))
        fresh = saved(hooked.join(top, "next").select("doc_id", "was", F.least("next", "top").alias("comp")))
        changed = fresh.where("comp <> was").limit(1).count()
        state = fresh.drop("was")
        if not changed:
            return state

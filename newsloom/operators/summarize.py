"""Texts about groups of articles: a model function, or extracts that need no model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import WORD
from newsloom.operators.rollup import top_per_cluster

TextFn = Callable[[pd.Series], pd.Series]
MAX_TITLES = 15
# The headings of a briefing.
HEADINGS = ["1. Key developments", "2. Notable entities involved", "3. Potential implications"]


def _safe(fn: TextFn) -> TextFn:
    """A model that fails leaves empty texts, only where it fails: a failed batch is tried row by row."""

    def run(batch: pd.Series) -> pd.Series:
        try:
            return fn(batch).fillna("").str.strip()
        except Exception:  # noqa: BLE001
            if len(batch) <= 1:
                return pd.Series([""] * len(batch), index=batch.index)
            return pd.concat([run(batch.iloc[i : i + 1]) for i in range(len(batch))]).reset_index(drop=True)

    return run


def titles_per_cluster(members: DataFrame, n: int = MAX_TITLES) -> DataFrame:
    """The newest ``n`` titles of each cluster, with ``position``."""
    return top_per_cluster(members, n).select("cluster_id", "position", "title")


def summarize_clusters(members: DataFrame, fn: TextFn | None = None) -> DataFrame:
    """``(cluster_id, summary)`` from the newest 15 titles of each cluster.

    ``fn`` maps a batch of title lists (one per line) to summaries. Without it, the
    three titles whose words the others share most, in that order.
    """
    titles = titles_per_cluster(members)
    if fn is not None:
        listed = titles.groupBy("cluster_id").agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("position", "title"))), lambda t: t["title"]), "\n"
            ).alias("titles")
        )
        return listed.select("cluster_id", F.pandas_udf(_safe(fn), "string")("titles").alias("summary"))
    words = F.array_distinct(
        F.filter(F.split(F.lower("title"), f"[^{WORD[1:-1]}]+"), lambda w: w != "")
    )
    spoken = titles.select("cluster_id", "position", F.explode(words).alias("word"))
    shared = spoken.groupBy("cluster_id", "word").agg(F.count("*").alias("titles_with"))
    weight = (
        spoken.join(shared, ["cluster_id", "word"])
        .groupBy("cluster_id", "position")
        .agg(F.avg("titles_with").alias("weight"))
    )
    scored = titles.join(weight, ["cluster_id", "position"], "left").withColumn(
        "weight", F.coalesce("weight", F.lit(0.0))
    )
    w = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("weight", 9)), "position")
    best = scored.withColumn("place", F.row_number().over(w)).where("place <= 3")
    parts = F.sort_array(F.collect_list(F.struct("place", "title")))
    return best.groupBy("cluster_id").agg(
        F.array_join(F.transform(parts, lambda p: p["title"]), " ").alias("summary")
    )


def article_block() -> Column:
    return F.concat(
        F.lit("Title: "), "title", F.lit("\nSource: "), "source_feed", F.lit("\nSummary: "), "summary"
    )


def briefing_context(found: DataFrame) -> DataFrame:
    """``(query_id, context)``: the found articles as text blocks in rank order.

    ``found`` has a bounded number of ranked articles per query.
    """
    parts = F.sort_array(F.collect_list(F.struct("rank", article_block().alias("block"))))
    return found.groupBy("query_id").agg(
        F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("context")
    )


def briefing_text(found: DataFrame, entities: DataFrame | None = None, fn: TextFn | None = None) -> DataFrame:
    """``(query_id, briefing)``.

    ``fn`` maps a batch of ``topic`` and article blocks to texts. Without it, three
    headed sections: titles by rank, the entities named in most of the articles, the newest title.
    """
    if fn is not None:
        topics = found.select("query_id", "topic").distinct()
        asked = briefing_context(found).join(topics, "query_id")
        text = F.concat(F.lit("Topic: "), "topic", F.lit("\n\n"), "context")
        return asked.select("query_id", F.pandas_udf(_safe(fn), "string")(text).alias("briefing"))
    ranked = F.sort_array(F.collect_list(F.struct("rank", "title")))
    newest = F.struct(F.coalesce(-F.unix_micros("published_at"), F.lit(2**63 - 1)), F.col("id"))
    told = found.groupBy("query_id").agg(
        F.array_join(F.transform(ranked, lambda p: p["title"]), "; ").alias("developments"),
        F.min_by("title", newest).alias("latest"),
    )
    if entities is None:
        told = told.withColumn("named", F.lit(""))
    else:
        mentions = (
            found.select("query_id", F.col("id").alias("article_id"))
            .join(entities.select("article_id", F.lower("text").alias("name")), "article_id")
            .groupBy("query_id", "name")
            .agg(F.countDistinct("article_id").alias("n"))
        )
        w = Window.partitionBy("query_id").orderBy(F.desc("n"), "name")
        top = mentions.withColumn("place", F.row_number().over(w)).where("place <= 5")
        names = F.sort_array(F.collect_list(F.struct("place", "name")))
        named = top.groupBy("query_id").agg(
            F.array_join(F.transform(names, lambda p: p["name"]), ", ").alias("named")
        )
        told = told.join(named, "query_id", "left").withColumn("named", F.coalesce("named", F.lit("")))
    sections = [F.concat(F.lit(h + "\n"), c) for h, c in zip(HEADINGS, ("developments", "named", "latest"))]
    return told.select("query_id", F.concat_ws("\n", *sections).alias("briefing"))

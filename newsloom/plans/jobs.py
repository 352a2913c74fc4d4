"""The two maintenance jobs, on tables given and returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from newsloom.config import Settings
from newsloom.operators.cluster import build_clusters, cluster_stories
from newsloom.operators.merge import assign_clusters, upsert_clusters
from newsloom.operators.reads import within
from newsloom.operators.retention import apply_retention
from newsloom.operators.summarize import TextFn, summarize_clusters
from newsloom.session import cut_lineage
from newsloom.tables import NewsTables


def new_stories(
    tables: NewsTables, as_of: Column, settings: Settings = Settings(), summarize: TextFn | None = None
) -> tuple[DataFrame, DataFrame]:
    """Assignments and cluster rows for the recent articles without a cluster. The cluster
    rows come first when both are stored, so no assignment points nowhere."""
    assigned = cut_lineage(
        cluster_stories(
            tables.articles,
            tables.vectors,
            tables.article_clusters,
            as_of,
            settings.cluster_window_hours,
            settings.min_cluster_size,
        )
    )
    # all that was assigned is of the window
    recent = within(tables.articles, as_of, settings.cluster_window_hours)
    members = recent.join(assigned.withColumnRenamed("article_id", "id"), "id")
    built = build_clusters(assigned, recent, summarize_clusters(members, summarize))
    return assigned, built


def run_cluster_job(
    tables: NewsTables, as_of: Column, settings: Settings = Settings(), summarize: TextFn | None = None
) -> NewsTables:
    assigned, built = new_stories(tables, as_of, settings, summarize)
    return tables.with_(
        clusters=upsert_clusters(tables.clusters, built, as_of),
        article_clusters=assign_clusters(tables.article_clusters, assigned),
    )


def run_retention_job(tables: NewsTables, as_of: Column, settings: Settings = Settings()) -> NewsTables:
    return apply_retention(tables, as_of, settings.retention_days)[0]

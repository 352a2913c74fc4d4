"""Closed days of the store in one piece: few large files, and vectors in cells around pivots."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.config import Settings
from newsloom.functions.dates import since, utc_day
from newsloom.operators.stored_cells import CELL_VECTORS, StoredCells, stored_cells
from newsloom.session import cut_lineage, passing_tables
from newsloom.streaming.ingest import instant
from newsloom.tables import BY_DAY, PIVOTS, SCHEMAS, WHOLE_DAY, conform, move_if_new, read_table, whole_days


def _keep_cells(spark: SparkSession, root: str, cells: StoredCells) -> None:
    """A new version beside the others; they are small, and all have the same pivots."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pivots")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    n = len(fs.listStatus(path)) if fs.exists(path) else 0
    spark.createDataFrame(cells.rows(), PIVOTS).coalesce(1).write.parquet(f"{root}/pivots/version={n}")


def _remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _batches(spark: SparkSession, root: str, name: str) -> dict[str, list[str]]:
    """The directories of runs below each day, without the whole day's own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/ingest_date=*/batch=*")
    found: dict[str, list[str]] = {}
    for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []:
        if status.getPath().getName() != f"batch={WHOLE_DAY}":
            found.setdefault(status.getPath().getParent().getName().removeprefix("ingest_date="), []).append(status.getPath().toString())
    return found


def compact_stored(
    spark: SparkSession, root: str, as_of: datetime, settings: Settings = Settings(), cell_vectors: int = CELL_VECTORS
) -> list[str]:
    """Rewrite days to which no job adds any more: neither the stream nor the clustering window, nor a day behind both.
    Returns the days that were rewritten in any table.

    A day is written aside and renamed, so readers see either the runs or the whole day, and from then on the runs do not count; they
    are removed last. A job that was cut short is simply run again. Vectors of closed days lie in cells around
    pivots that the first closed day fixes; how far a cell reaches is stored before the vectors that need it. One such job at a
    time may run on a store.
    """
    hours = max(settings.cluster_window_hours, settings.simhash_window_hours) + 24
    cutoff = str(spark.range(1).select(utc_day(since(instant(as_of), hours))).first()[0])
    done = set()
    for name in BY_DAY:
        whole = set(whole_days(spark, root, name))
        for day, runs in sorted(_batches(spark, root, name).items()):
            if day >= cutoff:
                continue
            if day not in whole:
                rows = conform(read_table(spark, root, name).where(F.col("ingest_date") == day), SCHEMAS[name])
                with passing_tables(spark):
                    _write_day(spark, root, name, day, rows, cell_vectors)
                done.add(day)
            for run in runs:
                _remove(spark, run)
    return sorted(done)


def _write_day(spark: SparkSession, root: str, name: str, day: str, rows: DataFrame, cell_vectors: int) -> None:
    aside = f"{root}/{name}/_aside-{uuid.uuid4().hex}"
    if name == "vectors":
        known = rows.where("embedding is not null")
        cells = stored_cells(spark, root) or (None if known.isEmpty() else StoredCells.chosen(known, cell_vectors))
        if cells is None:
            return
        dealt = cut_lineage(cells.dealt(known))
        _keep_cells(spark, root, cells.widened(dealt))
        # a cell may hold most of a day: Spark splits large ones
        dealt.drop("reach").hint("rebalance", "cell").write.partitionBy("cell").parquet(aside)
    else:
        rows.hint("rebalance").write.parquet(aside)
    move_if_new(spark, aside, f"{root}/{name}/ingest_date={day}/batch={WHOLE_DAY}")

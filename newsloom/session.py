"""Session helpers: lineage cuts on shared storage and size checks before a broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def require_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts.

    A cluster names a shared one in ``spark.checkpoint.dir``. Only a local
    session without the setting gets a folder of its own, because executors on
    other machines could not read it back.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="newsloom-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


#: Spark removes the shuffle files of a query as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: For each ``passing_tables`` around the work, innermost last: paths of the tables that it has to remove.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Removes every table that ``cut_lineage`` writes inside, whether the work succeeds or not.

    For jobs that store their results before they end: nothing made inside may be read afterwards, except what
    ``cut_lineage`` wrote to outlast it.
    """
    paths: list[str] = []
    token = _written.set((*_written.get(), paths))
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame, outlasting: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back: a lost executor costs no replay of earlier rounds.

    Unlike a checkpoint, a written table is computed once, columnar, compressed and read in pieces of a good size. What was
    shuffled to make it is of no more use, so its files go at once. ``outlasting`` the innermost ``passing_tables`` it is
    removed by the next one around it, if there is one: the result of a step whose own tables are of no more use.
    """
    spark = df.sparkSession
    path = f"{require_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    scopes = _written.get()[: -1 if outlasting else None]
    if scopes:
        scopes[-1].append(path)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def collect_if_small(df: DataFrame, max_rows: int) -> list[Row] | None:
    """All rows if there are at most ``max_rows``, else None. Never fetches more than that plus one."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def send_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(scan: DataFrame) -> DataFrame:
    """A scan over all task slots, if its file comes in fewer pieces than there are slots.

    For costly per-row work on a small file that Spark cannot split. Large inputs
    already have enough partitions and pass through without a shuffle. Takes plain
    scans only: counting the partitions of a plan with shuffles would run them.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots) if scan.rdd.getNumPartitions() < slots else scan

"""Schemas of the stored tables and their Parquet layout."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(spec: str) -> T.StructType:
    """A schema from ``name type, ...``; unlike the DDL parser it needs no session."""
    pairs = [column.split() for column in spec.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FEEDS = _struct(
    "id string, name string, url string, region string, category string, "
    "etag string, last_modified string, enabled boolean"
)
ARTICLES = _struct(
    "id string, title string, summary string, content string, source_url string, "
    "source_feed string, author string, region string, category string, "
    "published_at timestamp, ingested_at timestamp, simhash bigint"
)
ENTITIES = _struct("id string, article_id string, text string, label string")
CLUSTERS = _struct(
    "id string, label string, summary string, article_count bigint, "
    "created_at timestamp, updated_at timestamp"
)
ARTICLE_CLUSTERS = _struct("article_id string, cluster_id string")
VECTORS = _struct(
    "article_id string, embedding array<float>, source_feed string, region string, "
    "published_at timestamp"
)
INGESTION_LOG = _struct(
    "source string, started_at timestamp, finished_at timestamp, "
    "articles_fetched bigint, articles_stored bigint, error string"
)

PIVOTS = _struct("cell int, embedding array<float>, reach double")

SCHEMAS = {
    "feeds": FEEDS,
    "articles": ARTICLES,
    "entities": ENTITIES,
    "clusters": CLUSTERS,
    "article_clusters": ARTICLE_CLUSTERS,
    "vectors": VECTORS,
    "ingestion_log": INGESTION_LOG,
}


@dataclass(frozen=True)
class NewsTables:
    """The seven tables a job reads or returns. Assignments of articles to
    clusters are a table of their own, so no job rewrites ``articles`` for them."""

    feeds: DataFrame
    articles: DataFrame
    entities: DataFrame
    clusters: DataFrame
    article_clusters: DataFrame
    vectors: DataFrame
    ingestion_log: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> NewsTables:
        return cls(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})

    def with_(self, **changes: DataFrame) -> NewsTables:
        return replace(self, **changes)

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(self)]

    def articles_with_cluster(self) -> DataFrame:
        """``articles`` plus the nullable ``cluster_id``."""
        assigned = self.article_clusters.select(F.col("article_id").alias("id"), "cluster_id")
        return self.articles.join(assigned, "id", "left")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, cast to its types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


# What hangs on an article is laid out by its ingest day: windows read few directories, and
# retention drops whole ones. Below the day, each run has a directory of its own, so that
# a repeated run replaces its output. Feeds and clusters are rewritten whole, as versions.
BY_DAY = ("articles", "vectors", "entities", "article_clusters")
LAYOUT = {
    **{name: (("ingest_date", T.DateType()), ("batch", T.LongType())) for name in BY_DAY},
    "feeds": (("version", T.LongType()),),
    "clusters": (("version", T.LongType()),),
    "ingestion_log": (("batch", T.LongType()),),
}
# vectors of closed days lie in cells besides (``streaming/compact.py``)
LAYOUT["vectors"] += (("cell", T.IntegerType()),)
# The batch that holds a closed day as a whole, and the cell of vectors that have none yet.
WHOLE_DAY, NO_CELL = -1, -1


def write_part(df: DataFrame, root: str, name: str, **keys: Column) -> None:
    """Add ``df`` to a stored table, replacing the directories named by its partition keys."""
    layout = [key for key, _ in LAYOUT[name]]
    data = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]]
    keys = {"cell": F.lit(NO_CELL)} | keys
    extra = [keys[key].cast(kind).alias(key) if key in keys else F.col(key).cast(kind).alias(key) for key, kind in LAYOUT[name]]
    out = df.select(*data, *extra)
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*layout)
        .parquet(f"{root}/{name}")
    )


#: Versions of a table that stay, the last one included; readers may still hold the one before.
KEPT_VERSIONS = 3


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """The versions in a table's folder, from the names of its directories alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [s.getPath().getName() for s in found]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def last_version(spark: SparkSession, root: str, name: str) -> int:
    return max(versions(spark, root, name), default=-1)


class VersionMoved(RuntimeError):
    """Another job wrote a version since this one read the table."""


def move_if_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder, unless the target exists: of several jobs that try, one succeeds."""
    fs = spark._jvm.org.apache.hadoop.fs
    source, target = fs.Path(source), fs.Path(target)
    no_overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    no_overwrite[0] = fs.Options.Rename.NONE
    context = fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, no_overwrite)
        return True
    except Py4JJavaError as error:
        if not context.util().exists(target):
            raise
        source.getFileSystem(spark._jsc.hadoopConfiguration()).delete(source, True)
        if "FileAlreadyExists" not in str(error.java_exception) and "not empty" not in str(error.java_exception):
            raise
        return False


def write_version(df: DataFrame, root: str, name: str, seen: int) -> None:
    """Add the version after ``seen``, the one that ``df`` was derived from. Clocks play no part.

    It is written aside and then renamed, so readers see it whole, and of two jobs that saw the same version one
    raises. Older versions than ``KEPT_VERSIONS`` are removed.
    """
    spark = df.sparkSession
    moved = VersionMoved(f"{name}: version {seen} was read, but there is a later one")
    if last_version(spark, root, name) != seen:
        raise moved
    aside = f"{root}/{name}/_aside-{uuid.uuid4().hex}"
    conform(df, SCHEMAS[name]).write.parquet(aside)
    if not move_if_new(spark, aside, f"{root}/{name}/version={seen + 1}"):
        raise moved
    for old in versions(spark, root, name)[:-KEPT_VERSIONS]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/version={old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_version(spark: SparkSession, root: str, name: str, version: int) -> DataFrame:
    """One version of a table; none of its rows if it is not there any more."""
    schema = T.StructType([*SCHEMAS[name].fields, *[T.StructField(k, t) for k, t in LAYOUT[name]]])
    return spark.read.schema(schema).parquet(f"{root}/{name}").where(F.col("version") == version).drop("version")


def init_tables(spark: SparkSession, root: str, feeds: DataFrame) -> None:
    """An empty store with the given feed list."""
    for name, schema in SCHEMAS.items():
        stored = T.StructType([*schema.fields, *[T.StructField(k, t) for k, t in LAYOUT[name]]])
        keys = [k for k, _ in LAYOUT[name]]
        spark.createDataFrame([], stored).write.mode("errorifexists").partitionBy(*keys).parquet(f"{root}/{name}")
    write_part(feeds, root, "feeds", version=F.lit(0))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its partition columns; of ``feeds`` and ``clusters`` the last version."""
    schema = T.StructType([*SCHEMAS[name].fields, *[T.StructField(k, t) for k, t in LAYOUT[name]]])
    df = spark.read.schema(schema).parquet(f"{root}/{name}")
    if "version" in df.columns:
        return df.where(F.col("version") == last_version(spark, root, name)).drop("version")
    if name in BY_DAY and (whole := whole_days(spark, root, name)):
        # what a closed day was made from may still be there, and does not count
        df = df.where((F.col("batch") == WHOLE_DAY) | ~F.col("ingest_date").isin(whole))
    return df


def whole_days(spark: SparkSession, root: str, name: str) -> list[str]:
    """The days of a table that lie in one piece, from the names of directories alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/ingest_date=*/batch={WHOLE_DAY}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(s.getPath().getParent().getName().removeprefix("ingest_date=") for s in found)


def read_tables(spark: SparkSession, root: str) -> NewsTables:
    return NewsTables(**{name: read_table(spark, root, name) for name in SCHEMAS})

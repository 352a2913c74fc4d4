"""Small helpers that the operators share: batches of bytes, tables, saved intermediate results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from newsloom.session import cut_lineage

#: A word; matches what ``bytes.split()`` yields on UTF-8.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column | str) -> Column:
    return F.translate(text, UPPER, LOWER)


#: A table written to the shared folder and read back.
saved = cut_lineage


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8, null as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]


#: Bytes of text that a worker takes apart at a time: words as objects need some twenty times as much.
PIECE = 2_000_000


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``PIECE`` bytes of text, one row at least."""
    at = batch.schema.get_field_index(column)
    if at < 0 or not batch.num_rows:
        yield batch
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def batches(fn: Callable[[pa.RecordBatch], dict | None], schema: str | StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function from one that turns a slice of a batch into named columns."""
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def column(values, kind: pa.DataType) -> pa.Array:
        return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for piece in pieces(batch):
                columns = fn(piece)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([column(columns[f.name], f.type) for f in arrow], schema=arrow)

    return run


def keeping(choose: Callable[[pa.RecordBatch], pa.Array]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that passes on the second column's rows for which ``choose`` says true."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for piece in pieces(batch):
                yield piece.filter(choose(piece)).select([1])

    return run


def filtered(docs: DataFrame, choose: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts ``choose`` keeps."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = docs.select("text", row).mapInArrow(keeping(choose), StructType([StructField("row", docs.schema)]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

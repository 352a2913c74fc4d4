"""Stored vectors in cells around fixed pivots, so that a search lists only the directories that can hold a match."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.blocks import unit
from newsloom.operators.similarity import route, vectors_only, with_cell
from newsloom.tables import NO_CELL, PIVOTS

#: Stored vectors in a cell on average when the pivots are chosen, cells at most.
CELL_VECTORS, MOST_CELLS = 4096, 1024


@dataclass(frozen=True)
class StoredCells:
    """Pivots (unit rows, numbered like the cells) and how far the farthest vector of each cell is from its pivot (-1: it has none)."""

    pivots: np.ndarray
    reach: np.ndarray

    @classmethod
    def read(cls, table: DataFrame) -> StoredCells | None:
        """From the stored pivots, ``MOST_CELLS`` rows at most; None before there are any."""
        rows = table.orderBy("cell").collect()
        if not rows:
            return None
        return cls(unit(np.array([r["embedding"] for r in rows], np.float64)), np.array([r["reach"] for r in rows]))

    @classmethod
    def chosen(cls, vectors: DataFrame, cell_vectors: int = CELL_VECTORS) -> StoredCells:
        """Around vectors picked by a hash of their id."""
        rows = vectors_only(vectors, "article_id")
        wanted = max(1, min(MOST_CELLS, rows.count() // cell_vectors))
        found = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
        return cls(unit(np.array([r["embedding"] for r in found], np.float64)), np.full(len(found), -1.0))

    def rows(self) -> list[tuple]:
        return [(i, [float(x) for x in p], float(r)) for i, (p, r) in enumerate(zip(self.pivots, self.reach))]

    def dealt(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` with ``cell`` and ``reach``, the distance to its pivot."""
        return with_cell(vectors, self.pivots)

    def widened(self, dealt: DataFrame) -> StoredCells:
        """With room for more vectors."""
        reach = self.reach.copy()
        for r in dealt.groupBy("cell").agg(F.max("reach").alias("reach")).collect():
            reach[r["cell"]] = max(reach[r["cell"]], r["reach"])
        return StoredCells(self.pivots, reach)

    def visited(self, vectors: DataFrame, queries: DataFrame, min_score: float) -> DataFrame:
        """``vectors`` without the cells in which no query (article_id, embedding) can have a match of ``min_score``.

        The numbers of the cells come to the driver, so the scan lists those directories only, and the vectors without cell.
        """
        asked = vectors_only(queries, "article_id")
        cells = route(asked, self.pivots, self.reach, min_score).select("cell").distinct().collect()
        return vectors.where(F.col("cell").isin(sorted({NO_CELL, *(r["cell"] for r in cells)})))


def stored_cells(spark: SparkSession, root: str) -> StoredCells | None:
    """The cells of the store's vectors; None before the first closed day."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pivots")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    last = max(int(s.getPath().getName().removeprefix("version=")) for s in fs.listStatus(path) if s.getPath().getName().startswith("version="))
    return StoredCells.read(spark.read.schema(PIVOTS).parquet(f"{root}/pivots/version={last}"))

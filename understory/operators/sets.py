"""Set operations on tables, boxes and coverage cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concatenated(tables: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL; the columns must be the same in the same order."""
    first, *rest = tables
    for t in rest:
        if t.columns != first.columns:
            raise ValueError("tables differ in columns")
        first = first.unionByName(t)
    return first


def identifiers(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def box_intersection(boxes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Common box of each group; null where it is empty."""
    got = boxes.groupBy(*keys).agg(F.max("x0").alias("x0"), F.max("y0").alias("y0"), F.min("x1").alias("x1"), F.min("y1").alias("y1"))
    ok = (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    return got.select(*keys, *[F.when(ok, F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def box_union(boxes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def covered_cells(boxes: DataFrame, step: float, keys: Sequence[str] = ()) -> DataFrame:
    """Lattice cells (i, j) that lie wholly inside one box of the group."""
    cells = lambda lo, hi: F.when(F.floor(F.col(hi) / step) > F.ceil(F.col(lo) / step), F.sequence(F.ceil(F.col(lo) / step), F.floor(F.col(hi) / step) - 1))
    got = boxes.select(*keys, cells("x0", "x1").alias("ii"), cells("y0", "y1").alias("jj"))
    return got.withColumn("i", F.explode("ii")).withColumn("j", F.explode("jj")).select(*keys, "i", "j").distinct()


def co_covered_tiles(boxes: DataFrame, key: str, groups: int, step: float, side: int) -> DataFrame:
    """Tiles of ``side`` x ``side`` cells whose every cell is covered in all groups."""
    cells = covered_cells(boxes, step, [key]).groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") == groups)
    tiles = cells.groupBy(F.floor(F.col("i") / side).alias("ti"), F.floor(F.col("j") / side).alias("tj")).agg(F.count("*").alias("n"))
    return tiles.where(F.col("n") == side * side).select("ti", "tj")

"""Scans in a global order without one task for all rows: range pieces with what their borders carry over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows that one piece can hold: places are the low bits of an id.
_BITS = 33


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in range pieces, with ``_piece`` and the ``_place`` in it; written once, so that later passes agree.

    Nulls come first. Rows that tie follow a hash of all their columns, so the order is the same in every run.
    """
    spark = df.sparkSession
    tie = F.xxhash64(*(F.col(f"`{c}`").cast("string") if kind.startswith(("map", "variant")) else F.col(f"`{c}`") for c, kind in df.dtypes))
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_tie", tie).repartitionByRange(pieces, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    path = shared_folder(spark, "ordered")
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    return rows.withColumns({"_piece": F.shiftright("_id", _BITS).cast("int"), "_place": F.col("_id").bitwiseAND((1 << _BITS) - 1)}).drop("_id")


def _sizes(rows: DataFrame) -> list[tuple[int, int]]:
    """Pieces that have rows and how many: a number for each task."""
    return sorted((r["_piece"], r["count"]) for r in rows.groupBy("_piece").count().collect())


def numbered(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """``df`` with each row's number from 0 in the order: the rows of the pieces before, and its place."""
    return _numbered(ranged(df, order), name).drop("_piece", "_place")


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    before, total = [], 0
    for piece, n in _sizes(rows):
        before.append((piece, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "_at int, _before long")
    return rows.join(F.broadcast(offsets), F.col("_piece") == F.col("_at")).withColumn(name, F.col("_before") + F.col("_place")).drop("_at", "_before")


def with_previous(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """``df`` with ``previous``, a struct of the columns of the row before; null for the first row."""
    return _previous(ranged(df, order), columns).drop("_piece", "_place")


def _previous(rows: DataFrame, columns: list[str]) -> DataFrame:
    # Within a piece the row before; the first of a piece takes the last of the nearest piece before that has any.
    mine = F.struct(*columns)
    inside = F.lag(mine).over(Window.partitionBy("_piece").orderBy("_place"))
    pieces = [piece for piece, _ in _sizes(rows)]
    pairs = rows.sparkSession.createDataFrame(list(zip(pieces[1:], pieces[:-1], strict=True)), "_after int, _from int")
    last = rows.groupBy("_piece").agg(F.max_by(mine, "_place").alias("_carried")).withColumnRenamed("_piece", "_from")
    carried = F.broadcast(pairs.join(last, "_from").drop("_from"))  # a row for each piece
    rows = rows.withColumn("_inside", inside).join(carried, F.col("_piece") == F.col("_after"), "left")
    return rows.withColumn("previous", F.when(F.col("_place") == 0, F.col("_carried")).otherwise(F.col("_inside"))).drop("_inside", "_carried", "_after")


def border_flags(df: DataFrame, order: list[str], group: str) -> DataFrame:
    """``df`` with its row number ``idx`` and whether the group differs from the row's before; the first row is no border."""
    rows = _previous(_numbered(ranged(df, order), "idx"), [group])
    changed = F.col("previous").isNotNull() & ~F.col(f"previous.{group}").eqNullSafe(F.col(group))
    return rows.withColumn("border", changed).drop("previous", "_piece", "_place")


def mean_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Rank from 1 of every different value within its group, the mean of those that ties share: ``by..., value, rank``."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    rows = ranged(counts, [*by, value])
    # Rows before a value are those before its piece and those before it in the piece, less those before its group.
    within = F.sum("_n").over(Window.partitionBy("_piece").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    sums = sorted((r["_piece"], r["n"]) for r in rows.groupBy("_piece").agg(F.sum("_n").alias("n")).collect())  # a number for each task
    before, total = [], 0
    for piece, n in sums:
        before.append((piece, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "_at int, _before long")
    rows = rows.withColumn("_sum", F.coalesce(within, F.lit(0))).join(F.broadcast(offsets), F.col("_piece") == F.col("_at"))
    rows = rows.withColumn("_first", F.col("_sum") + F.col("_before"))
    start = rows.groupBy(*by).agg(F.min("_first").alias("_start"))
    return rows.join(start, by).select(*by, value, (F.col("_first") - F.col("_start") + (F.col("_n") + 1) / 2).alias("rank"))

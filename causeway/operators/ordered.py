"""Ordered computations over groups of any size.

A window over a group runs in one task, so a group with a third of all rows would
not fit. These helpers cut each group into consecutive blocks, compute inside the
blocks, and carry one small summary per block across the group. Blocks must follow
the order: block(a) < block(b) implies a comes before b.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from causeway.session import Scratch

# Arrival numbers per block: small enough to sort in one task, even when all belong to one group.
ARRIVAL_BLOCK = 1 << 24

_BLOCK, _KEY = "__block", "__key_struct"


def arrival_block(arrival: Column, width: int = ARRIVAL_BLOCK) -> Column:
    return F.floor(arrival / F.lit(width))


RANGE = "__range"


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], scratch: Scratch) -> DataFrame:
    """``df`` sorted into ranges of (keys, order), with the number of its range as ``__range``.

    Ranges hold about the same number of rows, so a group of any size, also one whose rows all lie
    close together, spans as many ranges as it needs. The table is written, as the
    bounds are sampled and must not be drawn twice.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.cut(df.repartitionByRange(parts, *keys, *order).withColumn(RANGE, F.spark_partition_id()))


def _carried(df: DataFrame, keys: Sequence[str], summaries: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """``df`` with, per row, the carry of all earlier blocks of its group.

    The keys are joined as one struct, which equals another also where a key is null, so the
    window that follows works on the join's partitions.
    """
    per_block = df.groupBy(_KEY, _BLOCK).agg(*[column.alias(name) for name, column in summaries.items()])
    earlier = Window.partitionBy(_KEY).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carries = per_block.select(_KEY, _BLOCK, *[column.over(earlier).alias(name) for name, column in carry.items()])
    return df.join(carries, [_KEY, _BLOCK])


def _blocked(df: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    if _KEY in df.columns:  # kept by the step before, with the partitions that go with them
        return df
    return df.withColumn(_BLOCK, block).withColumn(_KEY, F.struct(*keys))


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str) -> DataFrame:
    """Add the 1-based position of each row in its group; ``order`` must be a total order."""
    blocked = _blocked(df, keys, block)
    carried = _carried(blocked, keys, {"__n": F.count(F.lit(1))}, {"__before": F.sum("__n")})
    inside = Window.partitionBy(_KEY, _BLOCK).orderBy(*order)
    position = F.row_number().over(inside) + F.coalesce("__before", F.lit(0))
    return carried.withColumn(name, position.cast("bigint")).drop(_BLOCK, _KEY, "__before")


def with_earlier_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column,
                     name: str, keep_blocks: bool = False) -> DataFrame:
    """Add the maximum of ``value`` over the strictly earlier rows of the group.

    With ``keep_blocks`` a step over the same groups and blocks may follow without another shuffle.
    """
    blocked = _blocked(df, keys, block).withColumn("__v", value)
    carried = _carried(blocked, keys, {"__top": F.max("__v")}, {"__before": F.max("__top")})
    inside = Window.partitionBy(_KEY, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.greatest(F.max("__v").over(inside), F.col("__before"))
    return carried.withColumn(name, top).drop("__v", "__before", *(() if keep_blocks else (_BLOCK, _KEY)))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column,
                  name: str) -> DataFrame:
    """Add ``value`` of the row just before; ``value`` must not be null."""
    blocked = _blocked(df, keys, block).withColumn("__v", value)
    last = F.max_by("__v", F.struct(*order))
    carried = _carried(blocked, keys, {"__last": last}, {"__before": F.last("__last")})
    inside = Window.partitionBy(_KEY, _BLOCK).orderBy(*order)
    previous = F.coalesce(F.lag("__v").over(inside), F.col("__before"))
    return carried.withColumn(name, previous).drop(_BLOCK, _KEY, "__v", "__before")

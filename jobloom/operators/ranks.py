"""Places and running sums over rows in order, without a window that holds all rows, or all of a group, in one task.

Rows are range-partitioned by group and order, and sorted and written where they are. What partitions need to know of those
before them is one row for each partition and group that meets it; only these are summed in order. So a group of any size
is spread over as many tasks as it has ranges, and a task holds a range at most.

Rows that are equal in group and order stay in one range: give enough columns to tell them apart where many may be equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.sources.shared import materialize

_PART, _AT = "_part", "_at"


def _ranged(rows: DataFrame, keys: Sequence[Column], partitions: int | None) -> DataFrame:
    """rows in order with the number of their range and their place in it, written."""
    spread = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    place = F.monotonically_increasing_id()
    return materialize(spread.sortWithinPartitions(*keys).withColumns({_PART: F.shiftright(place, 33), _AT: place.bitwiseAND((1 << 33) - 1)}), "ranges")


def _totals_before(spans: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """spans, a row for each range and group, with each name's total over the group's earlier ranges in its place."""
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumns({n: F.coalesce(F.sum(n).over(earlier), F.lit(0).cast("bigint")) for n in names})


def _joined(rows: DataFrame, spans: DataFrame, group: Sequence[str]) -> DataFrame:
    """rows with what spans says of their range and group; a null is a group, too."""
    names = {g: f"_of_{i}" for i, g in enumerate(group)}
    own = spans.withColumnsRenamed({**names, _PART: "_span"})
    same = F.col(_PART) == F.col("_span")
    for g, renamed in names.items():
        same &= F.col(g).eqNullSafe(F.col(renamed))
    return rows.join(own, same).drop("_span", *names.values())


def ranked(rows: DataFrame, order: Sequence[Column], group: Sequence[str] = (), name: str = "place", partitions: int | None = None) -> DataFrame:
    """rows with their place, from 0, in the order given, within their group if there is one."""
    written = _ranged(rows, [*map(F.col, group), *order], partitions)
    spans = written.groupBy(_PART, *group).agg(F.min(_AT).alias("_first"), F.count("*").alias("_before"))
    placed = _joined(written, _totals_before(spans, group, ["_before"]), group)
    return placed.withColumn(name, F.col(_AT) - F.col("_first") + F.col("_before")).drop(_PART, _AT, "_first", "_before")


def running(rows: DataFrame, value: str, order: Sequence[Column], group: Sequence[str] = (), name: str = "start", partitions: int | None = None) -> DataFrame:
    """rows with the sum of a whole-number column over the rows before them in the order given, within their group if there is one."""
    written = _ranged(rows, [*map(F.col, group), *order], partitions)
    spans = written.groupBy(_PART, *group).agg(F.sum(value).cast("bigint").alias("_before"))
    here = Window.partitionBy(_PART, *group).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    inside = written.withColumn("_inside", F.coalesce(F.sum(value).over(here), F.lit(0)).cast("bigint"))
    placed = _joined(inside, _totals_before(spans, group, ["_before"]), group)
    return placed.withColumn(name, F.col("_inside") + F.col("_before")).drop(_PART, _AT, "_inside", "_before")

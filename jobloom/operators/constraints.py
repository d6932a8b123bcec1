"""Constraints of the tables as queries that return the rows in breach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.schemas import CHECKS, FOREIGN_KEYS, NOT_NULL, UNIQUE


def duplicate_keys(table: DataFrame, key: str) -> DataFrame:
    """Values that occur more than once; nulls may repeat."""
    return table.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Rows whose parent is not there; a null has none and needs none."""
    keys = parent.select(F.col("id").alias("_parent"))
    return child.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")


def cascade(child: DataFrame, column: str, deleted: DataFrame) -> DataFrame:
    """What is left of child when the parents in deleted (id) go."""
    return child.join(deleted.select(F.col("id").alias("_gone")), F.col(column) == F.col("_gone"), "left_anti")


def check_violations(table: DataFrame, name: str) -> DataFrame:
    """id and the first rule in breach: null where it may not be, a value out of its list, seconds for milliseconds."""
    out = None
    for column in NOT_NULL.get(name, ()):
        says = F.lit(f"{column} is null")
        out = F.when(F.col(column).isNull(), says) if out is None else out.when(F.col(column).isNull(), says)
    for column, values in CHECKS.get(name, {}).items():
        out = out.when(F.col(column).isNotNull() & ~F.col(column).isin(*values), f"{column} is out of range")
    if name == "listings":
        out = out.when(F.col("expires_at") < 10_000_000_000, "expires_at is in seconds")
    return table.select("id", out.alias("breach")).filter("breach IS NOT NULL")


def validate(name: str, table: DataFrame, parents: dict[str, DataFrame]) -> None:
    """Raises ValueError at the first constraint of a table that is in breach."""
    faults = {"check": check_violations(table, name)}
    faults |= {f"unique {k}": duplicate_keys(table, k) for k in UNIQUE[name]}
    if name in FOREIGN_KEYS:
        column, parent = FOREIGN_KEYS[name]
        if parent in parents:
            faults[f"foreign key {column}"] = orphans(table, column, parents[parent])
    for rule, rows in faults.items():
        found = rows.limit(3).collect()
        if found:
            raise ValueError(f"{name} breaks {rule}: {found}")

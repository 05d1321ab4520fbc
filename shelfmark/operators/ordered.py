"""Running totals and neighbours over ordered groups of any size.

A plain window sends a whole group to one task.  Here the rows are range partitioned by
(group, order), so a group that holds a third of the table spans many tasks; each task works
on its slice and the slices are chained by one small row per (group, slice).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.operators.stable import stored


def one_row(*parts: DataFrame) -> DataFrame:
    """The columns of several one-row tables side by side."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def _sliced(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """Range partitioned rows with their slice number stored, so that every reader sees the
    same slices."""
    keys = [F.col(g) for g in groups] + order
    return stored(df.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()))


def running_total(df: DataFrame, groups: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the group up to and including the row."""
    rows = _sliced(df.withColumn("_value", value), groups, order)
    local = F.sum("_value").over(
        W.partitionBy(*groups, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    )
    per_slice = rows.groupBy(*groups, "_slice").agg(F.sum("_value").alias("_slice_sum"))
    # One row per (group, slice): at most as many rows per group as there are partitions.
    before = F.sum("_slice_sum").over(
        W.partitionBy(*groups).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    )
    carried = per_slice.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_slice").alias("_s"),
        F.coalesce(before, F.lit(0)).alias("_before"),
    )
    same = F.col("_slice") == F.col("_s")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        rows.withColumn("_local", local)
        .join(carried, same, "left")
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_value", "_slice", "_local", "_before", "_s", *[f"_g{i}" for i in range(len(groups))])
    )


def row_numbers(df: DataFrame, groups: list[str], order: list[Column], out: str) -> DataFrame:
    return running_total(df, groups, order, F.lit(1), out)


def with_previous(df: DataFrame, groups: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Adds ``prev_<c>`` for each column: its value on the row before, NULL on the first."""
    rows = _sliced(df.withColumn("_row", F.struct(*columns)), groups, order)
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    local = F.lag("_row").over(W.partitionBy(*groups, "_slice").orderBy(*order))
    last = rows.groupBy(*groups, "_slice").agg(F.max_by("_row", key).alias("_last"))
    carried = last.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_slice").alias("_s"),
        F.lag("_last").over(W.partitionBy(*groups).orderBy("_slice")).alias("_carry"),
    )
    same = F.col("_slice") == F.col("_s")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = rows.withColumn("_lag", local).join(carried, same, "left")
    prev = F.coalesce(F.col("_lag"), F.col("_carry"))
    return joined.withColumns({f"prev_{c}": prev[c] for c in columns}).drop(
        "_row", "_lag", "_carry", "_slice", "_s", *[f"_g{i}" for i in range(len(groups))]
    )

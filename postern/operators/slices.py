"""Running values along an order whose groups may be very large.

A window over a hot key sorts the whole key in one task. Here rows are cut into
slices by a caller-given, order-preserving slice number; the running value inside
a slice comes from a window per (key, slice), and what earlier slices contribute
from a window over one aggregated row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _carry(df: DataFrame, keys: list[str], slice_: str, aggregate: Column, running) -> DataFrame:
    totals = df.groupBy(*keys, slice_).agg(aggregate.alias("_t"))
    before = W.partitionBy(*keys).orderBy(slice_).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*keys, slice_, running("_t").over(before).alias("_carry"))


def _with_carry(inside: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what earlier slices contribute; a NULL key or slice is a group like any other."""
    renamed = carry.select(*[F.col(k).alias(f"_c{n}") for n, k in enumerate(keys)], "_carry")
    cond = F.lit(True)
    for n, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_c{n}"))
    return inside.join(renamed, cond).drop(*[f"_c{n}" for n in range(len(keys))])


def sliced_row_number(df: DataFrame, keys: list[str], slice_: Column, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 1 per key; ``slice_`` must not decrease along ``order``."""
    rows = df.withColumn("_slice", slice_)
    carry = _carry(rows, keys, "_slice", F.count("*"), F.sum)
    inside = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order)))
    joined = _with_carry(inside, carry, [*keys, "_slice"])
    return joined.withColumn(name, (F.col("_n") + F.coalesce("_carry", F.lit(0))).cast("bigint")).drop("_slice", "_n", "_carry")


def sliced_running_max(df: DataFrame, keys: list[str], slice_: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """Maximum of ``value`` over all earlier rows of the key (NULL on the first)."""
    rows = df.withColumn("_slice", slice_)
    carry = _carry(rows, keys, "_slice", F.max(value), F.max)
    before = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("_m", F.max(value).over(before))
    joined = _with_carry(inside, carry, [*keys, "_slice"])
    return joined.withColumn(name, F.greatest("_m", "_carry")).drop("_slice", "_m", "_carry")


def sliced_running_sum(df: DataFrame, keys: list[str], slice_: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the key, 0 on the first."""
    rows = df.withColumns({"_slice": slice_, "_v": value})
    carry = _carry(rows, keys, "_slice", F.sum("_v"), F.sum)
    before = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("_s", F.sum("_v").over(before))
    joined = _with_carry(inside, carry, [*keys, "_slice"])
    return joined.withColumn(name, (F.coalesce("_s", F.lit(0)) + F.coalesce("_carry", F.lit(0))).cast("bigint")).drop("_slice", "_v", "_s", "_carry")

"""Exact order statistics of raw columns, without a group ever landing in one task.

``percentile`` keeps every distinct value of a group in one buffer and a window keeps every row of it in one task;
both fail on a raw column of which one group holds a third. Here a column is first reduced to (group, value, n), then
range partitioned by (group, value), so that a large group spreads over many tasks and equal values stay in one row.
Running totals are the running total inside a partition plus the totals of the partitions before it. Quantiles do this
for the few values near them only.

The partition number becomes data and has to survive a lost executor, hence the checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygauge.functions.scalars import number
from daygauge.session import durable


def unpivot(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), name: str = "name") -> DataFrame:
    """Numeric columns to long form (by..., name, value), null and unparseable values kept as NULL."""
    numbers = df.select(*by, *[number(c).alias(c) for c in columns])
    return numbers.unpivot([F.col(c) for c in by], [F.col(c) for c in columns], name, "value")


def placed_values(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """A table with one row per (by, value), range partitioned, with the partition number as data."""
    return durable(values.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))


def value_counts(df: DataFrame, by: Sequence[str], value: str = "value", extra: Sequence[str] = ()) -> DataFrame:
    """Rows per (by, extra, value), placed by (by, value)."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, *extra, value).agg(F.count("*").alias("n"))
    return placed_values(counted, by, value)


def running_totals(placed: DataFrame, by: Sequence[str], value: str, totals: Sequence[str],
                   carry: Sequence[str] = ()) -> DataFrame:
    """``<c>_before`` and ``<c>_total`` for each count column c of a placed table with one row per (by, value)."""
    by = list(by)
    per_part = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in totals])
    # One row per group and range partition: its length is the number of partitions, not of values.
    across = Window.partitionBy(*by).orderBy("_part")
    offsets = per_part.select(
        *by, "_part",
        *[F.coalesce(F.sum(f"_{c}").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{c}_off")
          for c in totals],
        *[F.sum(f"_{c}").over(Window.partitionBy(*by)).alias(f"{c}_total") for c in totals])
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select(*by, "_part", value, *totals, *carry,
                          *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_{c}_in") for c in totals])
    return local.join(offsets, [*by, "_part"]).select(
        *by, value, *totals, *carry,
        *[(F.col(f"_{c}_off") + F.col(f"_{c}_in")).alias(f"{c}_before") for c in totals],
        *[f"{c}_total" for c in totals])


def quantiles_from(positions: DataFrame, by: Sequence[str], probs: Sequence[float], names: Sequence[str],
                   value: str = "value") -> DataFrame:
    """Linearly interpolated quantiles, one row per group."""
    def at(k: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col(value)))

    aggs = []
    for p, name in zip(probs, names, strict=True):
        h = (F.col("n_total") - 1) * F.lit(float(p))
        aggs += [at(F.floor(h)).alias(f"_lo_{name}"), at(F.ceil(h)).alias(f"_hi_{name}"),
                 F.max(h - F.floor(h)).alias(f"_w_{name}")]
    wide = positions.groupBy(*by).agg(*aggs)
    return wide.select(*by, *[
        (F.col(f"_lo_{n}") + F.col(f"_w_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in names])


def checked_small(table: DataFrame, limit: int = 10_000) -> DataFrame:
    """A per-group table evaluated once: a literal, broadcast table if it has at most ``limit`` short rows, else a written
    one for a shuffle join, whose skewed side the adaptive planner splits."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        return durable(table)
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


def quantile_brackets(rows: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], extra: Sequence[Column] = (),
                      accuracy: int = 1_000) -> DataFrame:
    """Per group the count (``_n``), an interval (``_lo[i]``, ``_hi[i]``) that should hold quantile i, and extra aggregates.

    The sketch errs by a rank of 1/accuracy; the interval is taken four times as wide.
    """
    margin = 4 / accuracy
    ends = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    sketch = rows.groupBy(*by).agg(F.count(value).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"),
                                   F.percentile_approx(value, ends, accuracy).alias("_e"), *extra)
    lo = F.array(*[F.col("_min") if p <= margin else F.col("_e")[i] for i, p in enumerate(probs)])
    hi = F.array(*[F.col("_max") if p >= 1 - margin else F.col("_e")[len(probs) + i] for i, p in enumerate(probs)])
    others = [c for c in sketch.columns if c not in (*by, "_n", "_min", "_max", "_e")]
    return checked_small(sketch.select(*by, "_n", lo.alias("_lo"), hi.alias("_hi"), *others))


def quantiles_within(rows: DataFrame, brackets: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                     names: Sequence[str]) -> DataFrame:
    """Exact interpolated quantiles, given brackets.

    One more pass keeps the values inside an interval, a few in a thousand, and only counts those between intervals;
    just these counts are ordered. Should an interval have missed its quantile, all values are ordered instead.
    """
    by, every = list(by), range(len(probs))
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")).join(
        brackets.select(*by, "_n", "_lo", "_hi"), by)
    # The number of intervals left behind rises with the value; within it, what lies before the next interval comes first.
    zone = reduce(lambda a, b: a + b, [(F.col("_v") > F.col("_hi")[i]).cast("int") for i in every])
    inside = reduce(lambda a, b: a | b, [F.col("_v").between(F.col("_lo")[i], F.col("_hi")[i]) for i in every])
    place = F.struct(zone.alias("zone"), F.when(inside, F.col("_v")).alias("v"))
    counted = known.select(*by, "_n", place.alias("_at")).groupBy(*by, "_n", "_at").agg(F.count("*").alias("n"))
    places = running_totals(placed_values(counted, by, "_at"), by, "_at", ["n"], carry=["_n"])

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col("_at.v")))

    aggs = []
    for p, name in zip(probs, names, strict=True):
        h = (F.col("_n") - 1) * F.lit(float(p))
        aggs.append((at(F.floor(h)) + F.max(h - F.floor(h)) * (at(F.ceil(h)) - at(F.floor(h)))).alias(name))
    wide = checked_small(places.groupBy(*by).agg(*aggs))
    if wide.where(" or ".join(f"`{n}` is null" for n in names)).isEmpty():
        return wide
    return quantiles_from(running_totals(value_counts(rows, by, value), by, value, ["n"]), by, probs, names, value)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str]) -> DataFrame:
    """Exact interpolated quantiles of a raw column per group."""
    return quantiles_within(df, quantile_brackets(df, by, value, probs), by, value, probs, names)


def numbered(df: DataFrame, order: Sequence[Column | str], out: str = "position") -> DataFrame:
    """Global 0-based row number in the given order, with no single-task window.

    The order must be total (or its ties interchangeable). The input must be small enough to write once.
    """
    placed = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_in", local).join(offsets, "_part").withColumn(
        out, F.col("_off") + F.col("_in")).drop("_part", "_in", "_off")

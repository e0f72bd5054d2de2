"""Writing results: keyed upsert, fixed-order CSV, JSON reports, long metric tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daygauge.functions.scalars import finite_or_null
from daygauge.operators.daily import keys
from daygauge.session import durable


def keep_last(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in the given order. As an aggregation a key repeated many times shrinks before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*rows.columns)


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Existing rows replaced by the last new row of their key, new keys added.

    Dropping covered keys, uniting and removing repeats is one aggregation over the union, new rows ranked above old.
    """
    tagged = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(tagged, key, ["_new", *order]).drop("_new")


def not_covered(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Existing rows whose key the new batch does not bring."""
    return existing.join(new.select(*key), list(key), "left_anti")


def upsert_months(spark: SparkSession, path: str, new: DataFrame, key: Sequence[str], order: Sequence[str], *,
                  timestamp: str = "timestamp") -> None:
    """Upsert into a parquet table partitioned by month; months the batch does not touch are not written.

    If the timestamp is part of the key, other months are not read either. Else a key may move to another month, so the
    keys (no other column) of all months are read to find where the batch's keys are stored; a month that loses its last
    row goes.

    The merged months are written beside the table and renamed to its pending commit in one step, then swapped in by partition. A
    job lost before the rename leaves the table as it was, one lost after it is finished by ``recover_months``, which the next
    upsert calls; ``read_months`` gives the new table from the rename on. One writer at a time.
    """
    recover_months(spark, path)
    batch = durable(new.withColumn("month", F.date_format(timestamp, "yyyy-MM")))
    months = _months(batch)
    try:
        old = spark.read.parquet(path)
        old = old.withColumn("month", F.col("month").cast("string"))
        if timestamp not in key:
            left, right = old.select(*key, "month").alias("l"), batch.select(*key).distinct().alias("r")
            same = reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key])
            months |= _months(left.join(right, same, "left_semi"))
        merged = upsert(old.where(_within(months)), batch, key, order)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        merged = keep_last(batch, key, order)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    merged.write.parquet(staged + "/rows")
    spark.createDataFrame([(m,) for m in months], "month string").coalesce(1).write.parquet(staged + "/months")
    files, place = _place(spark, staged)
    if not files.rename(place, _place(spark, _pending(path))[1]):
        raise OSError(f"could not commit {staged}")
    recover_months(spark, path)


def recover_months(spark: SparkSession, path: str) -> None:
    """Swap in the pending commit of a table, if it has one. Doing so twice, or after half of it was done, gives the same."""
    pending = _pending(path)
    files, place = _place(spark, pending)
    if not files.exists(place):
        return
    rows, months = spark.read.parquet(pending + "/rows"), _months(spark.read.parquet(pending + "/months"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    for month in months - _months(rows):
        _remove(spark, f"{path}/month={'__HIVE_DEFAULT_PARTITION__' if month is None else month}")
    _remove(spark, pending)


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last commit: months whose swap was cut off come from the pending commit."""
    pending = _pending(path)
    files, place = _place(spark, pending)
    rows = months = None
    if files.exists(place):
        rows, months = spark.read.parquet(pending + "/rows"), _months(spark.read.parquet(pending + "/months"))
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if rows is None or error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return rows
    table = table.withColumn("month", F.col("month").cast("string"))
    return table if rows is None else table.where(~_within(months)).unionByName(rows, allowMissingColumns=True)


def _months(rows: DataFrame) -> set[str | None]:
    return {r[0] for r in rows.select("month").distinct().collect()}


def _within(months: set[str | None]) -> Column:
    named = F.coalesce(F.col("month").isin(*(m for m in months if m is not None)), F.lit(False))
    return named | F.col("month").isNull() if None in months else named


def _pending(path: str) -> str:
    return path.rstrip("/") + ".pending"


def _place(spark: SparkSession, path: str):
    """The file system that holds a path, and the path for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours on whatever file system holds it."""
    files, place = _place(spark, path)
    files.delete(place, True)


def fixed_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Projection to a fixed column order, absent columns as empty text."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit("").alias(c) for c in columns])


def write_monthly_csv(df: DataFrame, path: str, columns: Sequence[str], *, timestamp: str = "timestamp") -> None:
    out = fixed_order(df, columns).withColumns({"year": F.year(timestamp), "month": F.month(timestamp)})
    out.write.mode("overwrite").option("header", True).partitionBy("year", "month").csv(path)


def finite(df: DataFrame) -> DataFrame:
    """Every double column with NaN and infinity as NULL."""
    return df.withColumns({c: finite_or_null(c) for c, t in df.dtypes if t == "double"})


def write_report(report: DataFrame, path: str) -> None:
    """Nested audit rows as JSON lines."""
    finite(report).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def metric_rows(df: DataFrame, section: str, columns: Sequence[str], *, series=None) -> DataFrame:
    """A wide result as long rows (section, series, position, metric, value), in the order of the columns."""
    name = F.concat_ws("/", *keys(series)) if series else F.lit("")
    return df.select(F.lit(section).alias("section"), name.alias("series"), F.posexplode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("position", "_m")
    ).select("section", "series", "position", "_m.metric", "_m.value")


def model_comparison(metrics: DataFrame, names: Sequence[str] | None = None, missing: str = "--") -> DataFrame:
    """model x metric table from (model, metric, value) rows, four decimals, absent entries marked."""
    shown = F.coalesce(F.format_string("%.4f", F.first("value", ignorenulls=True)), F.lit(missing))
    text = F.when(F.first("value", ignorenulls=True).isNull(), F.lit(missing)).otherwise(shown)
    pivot = metrics.groupBy("model").pivot("metric", list(names) if names else None).agg(text)
    return pivot.fillna(missing)


def key_metrics(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One row of results as (position, metric, shown): whole numbers grouped, fractions with four decimals."""
    types = dict(df.dtypes)

    def shown(c: str):
        if types[c] in ("double", "float"):
            return F.format_number(c, 4)
        if types[c] in ("int", "bigint", "smallint", "tinyint"):
            return F.format_number(c, 0)
        return F.col(c).cast("string")

    return df.select(F.posexplode(F.array(*[F.struct(F.lit(label).alias("metric"), shown(c).alias("shown"))
                                            for c, label in columns.items()])).alias("position", "_m")).select(
        "position", "_m.metric", "_m.shown")


def rank_by_size(df: DataFrame, value: str, tie: str, *, series=None) -> DataFrame:
    w = Window.partitionBy(*keys(series)).orderBy(F.abs(value).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w))

"""Random forest on the feature table: MLlib fit, contiguous cross-validation, both kinds of importance."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygauge.functions.scalars import safe_divide
from daygauge.operators.daily import attach, keys
from daygauge.operators.order_stats import numbered
from daygauge.session import durable


def forest_rows(df: DataFrame, target: str, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    rows = df.dropna(subset=[target, *features])
    vector = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    return vector.select(*keep, F.col(target).cast("double").alias("label"), "features")


def _forest(trees: int, depth: int, leaf: int, seed: int) -> RandomForestRegressor:
    # Cached node numbers and more nodes a pass save jobs; the trees are the same.
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="all",
                                 cacheNodeIds=True, maxMemoryInMB=512, seed=seed, labelCol="label", featuresCol="features", predictionCol="prediction")


def fit_forest(rows: DataFrame, *, trees: int = 500, depth: int = 10, leaf: int = 5, seed: int = 42) -> RandomForestRegressionModel:
    return _forest(trees, depth, leaf, seed).fit(durable(rows))


def r2_of(label: str = "label", prediction: str = "prediction") -> Column:
    """1 - SSE/SST around the mean of the scored rows, as one aggregate."""
    err = F.col(label) - F.col(prediction)
    return 1 - safe_divide(F.avg(err * err), F.var_pop(label))


def train_scores(model: RandomForestRegressionModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).agg(F.count("*").alias("n"), r2_of().alias("r2"),
                                     F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae"))


def contiguous_folds(df: DataFrame, folds: int = 5, *, date: str = "date", series=None) -> DataFrame:
    """``fold`` 0..k-1 in date order without shuffling; the first n % k folds are one row longer."""
    w = Window.partitionBy(*keys(series)).orderBy(date)
    return df.withColumn("fold", F.ntile(folds).over(w) - 1)


def cross_validate(rows: DataFrame, *, folds: int = 5, trees: int = 500, depth: int = 10, leaf: int = 5, seed: int = 42,
                   parallelism: int = 1) -> DataFrame:
    """R squared per fold; ``rows`` carries a ``fold`` column. One fit per fold, each distributed by MLlib.

    The rows are written once, since every fit passes over them several times; ``parallelism`` fits run at a time, as
    short tables leave most cores idle.
    """
    rows = durable(rows)

    def score(k: int) -> DataFrame:
        model = _forest(trees, depth, leaf, seed).fit(rows.where(F.col("fold") != k))
        return model.transform(rows.where(F.col("fold") == k)).agg(F.lit(k).alias("fold"), r2_of().alias("r2"))

    with ThreadPoolExecutor(parallelism) as pool:
        return reduce(DataFrame.unionByName, pool.map(score, range(folds)))


def fold_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"))


def impurity_importance(model: RandomForestRegressionModel, features: Sequence[str], spark) -> DataFrame:
    """Importance per feature, summing to 1; as many rows as there are features."""
    values = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, importance double"
                                 ).orderBy(F.col("importance").desc(), "feature")


def top_features(importance: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` features of the greatest importance with their rank; ties go to the first name."""
    best = importance.orderBy(F.col("importance").desc(), "feature").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


def permutation_importance(model: RandomForestRegressionModel, df: DataFrame, target: str, features: Sequence[str], *,
                           order: Sequence[str], repeats: int = 10, seed: int = 42) -> DataFrame:
    """Drop in R squared when one feature is shuffled, mean and spread over repeats.

    The shuffle is a join: rows are numbered in ``order`` (a total order), and numbered again by a hash of that number
    and the repeat, which is a fixed random order. Row i then takes the feature of the row that holds place i there.
    Every repeat and feature is scored in one transform.
    """
    base = numbered(df.dropna(subset=[target, *features]).select(*order, F.col(target).cast("double").alias("label"),
                    *[F.col(f).cast("double").alias(f) for f in features]), order)
    base = base.drop(*[c for c in order if c not in features])
    # rows x repeats, placed at random within each repeat.
    draws = base.select("position", *features, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    draws = draws.withColumn("_key", F.xxhash64("position", F.lit(seed) + F.col("rep")))
    placed = numbered(draws.select("rep", "_key", "position", F.struct(*features).alias("_from")),
                      ["rep", "_key", "position"], out="_at").drop("position")
    size = base.agg(F.count("*").alias("_n"))
    placed = attach(placed, size, []).select("rep", (F.col("_at") - F.col("rep") * F.col("_n")).alias("position"), "_from")
    paired = base.join(placed, "position")
    variants = [F.struct(F.lit(f).alias("feature"), *[(F.col("_from")[g] if g == f else F.col(g)).alias(g) for g in features])
                for f in features]
    shuffled = paired.select("rep", "label", F.inline(F.array(*variants)))
    vector = VectorAssembler(inputCols=list(features), outputCol="features")
    scored = model.transform(vector.transform(shuffled)).groupBy("feature", "rep").agg(r2_of().alias("r2"))
    whole = model.transform(vector.transform(base)).agg(r2_of().alias("_base"))
    drops = attach(scored, whole, []).withColumn("drop", F.col("_base") - F.col("r2"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")
                                        ).orderBy(F.col("importance_mean").desc(), "feature")

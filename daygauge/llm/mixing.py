"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygauge.llm.common import doubtful_keys, free_name, numbered, partitions, query, table, written

#: A rate is split into equal parts up to this size, so that exp(-part) stays far from the smallest double.
PART_RATE = 16.0
#: Entries of a part's distribution function; beyond them it is 1 in double precision.
ENTRIES = 80
#: Up to so many sources (700 bytes each) their table is broadcast; beyond, a salted join.
BROADCAST_SOURCES = 10_000
SALTS = 16
OWN = ("copy", "copies", "shuffle_key")


def target_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, default_weight: float = 0.0, epoch: float = 1.0,
                 temperature: float = 0.5, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: code points, weight, and the mean repetition rate that gives it its share of ``epoch`` corpora.

    With ``weights`` a source not listed has ``default_weight``; without, a source weighs its size to the power ``temperature``
    (1 keeps the corpus as it is, 0 makes all sources equal). Null is a source of its own. A source without any text has rate 0.
    """
    sizes = written(docs.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.coalesce(F.length(text), F.lit(0)).cast("bigint")).alias("chars")), "source-sizes")
    if weights is None:
        weight = F.sqrt("chars") if temperature == 0.5 else F.pow(F.col("chars"), F.lit(float(temperature)))
    else:
        weight = F.lit(float(default_weight))
        if weights:
            given = F.array(*[F.struct(F.lit(name).cast("string").alias("_name"), F.lit(float(value)).alias("_weight")) for name, value in weights.items()])
            listed = docs.sparkSession.range(1).select(F.inline(given))
            sizes = sizes.join(listed, F.col("source").eqNullSafe(F.col("_name")), "left").drop("_name")
            weight = F.coalesce("_weight", weight)
    sized = sizes.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    chars, total = sized.agg(F.sum("chars"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(float(total or 1.0))
    rate = F.when(F.col("chars") > 0, share * F.lit(float(epoch) * (chars or 0)) / F.col("chars")).otherwise(0.0)
    return sized.select("source", "chars", "weight", rate.alias("rate"))


def occurrences(docs: DataFrame, key: str, text: str, source: str, column: str) -> DataFrame:
    """``docs`` with the number, from 0, that tells rows of one key and text apart: 0 in all rows where keys are whole and unique.

    Else rows that stand more than once are numbered in a written table, by range, so a group of any size spreads over tasks.
    """
    if not doubtful_keys(docs, key):
        return docs.withColumn(column, F.lit(0).cast("bigint"))
    hashed, k, h, row, first = (free_name(docs, name) for name in ("_mix_hash", "_mix_k", "_mix_h", "_mix_row", "_mix_first"))
    rows = docs.withColumn(hashed, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    groups = written(rows.groupBy(F.col(key).alias(k), F.col(hashed).alias(h)).agg(F.count("*").alias("n")).where("n > 1").select(k, h), "repeated-rows")
    same = F.col(key).eqNullSafe(F.col(k)) & (F.col(hashed) == F.col(h))
    single = rows.join(groups, same, "left_anti").withColumn(column, F.lit(0).cast("bigint"))
    placed = written(numbered(rows.join(groups, same, "left_semi"), [key, hashed, source], row), "numbered-rows")
    firsts = placed.groupBy(F.col(key).alias(k), F.col(hashed).alias(h)).agg(F.min(row).alias(first))
    again = placed.join(firsts, same).withColumn(column, F.col(row) - F.col(first)).drop(k, h, row, first)
    return single.unionByName(again).drop(hashed)


def _with_distribution(rates: DataFrame) -> DataFrame:
    """``rates`` with the number of parts of each rate and the distribution function of one part."""
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")
    part = F.col("rate") / F.col("_parts")
    begin = F.struct(F.exp(-part).alias("t"), F.array(F.exp(-part)).alias("c"))

    def grow(acc, k):
        term = acc["t"] * part / k
        return F.struct(term.alias("t"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + term)).alias("c"))

    return rates.withColumn("_parts", parts).withColumn(
        "_cdf", F.aggregate(F.sequence(F.lit(1), F.lit(ENTRIES - 1)), begin, grow, lambda acc: acc["c"]))


def _bits(*of: Column) -> Column:
    """52 bits of a hash, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *of).cast("binary")), 1, 13), 16, 10).cast("bigint")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, default_weight: float = 0.0, epoch: float = 1.0,
        temperature: float = 0.5, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every document as often as its Poisson draw says, in one global shuffle.

    A document's uniform number is a hash of seed, key and text, so its count is reproducible and needs no other row; the count is
    the inverse of the Poisson distribution whose mean is the rate of its source (``target_rates``), a rate above 16 as a sum of
    parts. Rows are exploded by their count and placed by range of ``shuffle_key``, a hash of seed, key, text and copy. Rows of one
    key and text are numbered, and the number goes into both hashes: they draw one by one and spread like others.

    Returns the columns of ``docs`` with ``copy`` (from 1), ``copies`` and ``shuffle_key``; columns of ``docs`` with these names
    are replaced. ``weights`` may name the null source. Null keys and texts hash as empty; an empty table gives no rows.
    """
    rates = written(_with_distribution(target_rates(docs, weights, default_weight, epoch, temperature, source, text))
                    .select("source", F.col("_parts").alias("parts"), F.col("_cdf").alias("cdf")), "rates")
    docs = docs.drop(*OWN)
    nth, name, parts, cdf, salt, own = (free_name(docs, n) for n in ("_mix_nth", "_mix_source", "_mix_parts", "_mix_cdf", "_mix_salt", "_mix_own"))
    columns = docs.columns
    docs = occurrences(docs, key, text, source, nth)
    rates = rates.toDF(name, parts, cdf)
    same = F.col(source).eqNullSafe(F.col(name))
    if rates.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn(own, F.pmod(F.xxhash64(key, text, nth), F.lit(SALTS)).cast("int")).join(salted, same & (F.col(own) == F.col(salt)))
    hashed = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    hashed = F.when(F.col(nth) == 0, hashed).otherwise(F.concat(hashed, F.lit("#"), F.col(nth).cast("string")))
    ident = F.coalesce(F.col(key).cast("string"), F.lit("")), hashed
    uniforms = F.transform(F.sequence(F.lit(1), F.col(parts)),
                           lambda j: _bits(F.lit(str(seed)), F.lit("draw"), *ident, j.cast("string")) / F.lit(float(1 << 52)))
    count = F.aggregate(uniforms, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    return (joined.withColumn("copies", count).where("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .withColumn("shuffle_key", _bits(F.lit(str(seed)), F.lit("place"), *ident, F.col("copy").cast("string")))
            .select(*columns, "copies", "copy", "shuffle_key")
            .repartitionByRange(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key", key, "copy"))


def mix_sql(documents: str = "documents", seed: int = 7) -> str:
    """DuckDB: the rows of ``mix`` with its defaults."""
    ident = "coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || CASE WHEN _nth > 0 THEN '#' || _nth::VARCHAR ELSE '' END"
    bits = lambda what, last: f"('0x' || substr(md5('{seed}:{what}:' || {ident} || ':' || {last}), 1, 13))::BIGINT"
    return f"""
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM {documents} GROUP BY source),
weighed AS (SELECT *, CASE WHEN chars > 0 THEN sqrt(chars) ELSE 0 END AS weight FROM sizes),
rates AS (SELECT source, CASE WHEN chars > 0 THEN weight / sum(weight) OVER () * sum(chars) OVER () / chars ELSE 0 END AS rate FROM weighed),
parted AS (SELECT source, rate, greatest(ceil(rate / {PART_RATE}), 1)::INT AS parts FROM rates),
cdf AS (
  SELECT source, k, sum(exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1.0)) OVER (PARTITION BY source ORDER BY k) AS c
  FROM parted, range(0, {ENTRIES}) AS ks(k)),
numbers AS (SELECT *, row_number() OVER () AS _row, row_number() OVER (PARTITION BY doc_id, coalesce(text, '') ORDER BY source NULLS FIRST) - 1 AS _nth FROM {documents}),
drawn AS (
  SELECT d._row, {bits("draw", "j::VARCHAR")} / {float(1 << 52)} AS u, d.source
  FROM numbers d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, p.parts + 1)) AS js(j)),
counted AS (
  SELECT _row, count(c.k)::INT AS copies FROM drawn d LEFT JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u GROUP BY _row),
copied AS (SELECT n.*, copies, unnest(range(1, copies + 1))::INT AS copy FROM numbers n JOIN counted USING (_row))
SELECT * EXCLUDE (_row, _nth), {bits("place", "copy::VARCHAR")} AS shuffle_key FROM copied"""


@query("op9_mixing", mix_sql())
def op9_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))

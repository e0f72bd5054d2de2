"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygauge.llm.common import constants, numbered, query, sql_bytes, sql_crc32, table

ROUNDS = 8
#: Two primes below 2**31: a round multiplies, reduces by one, multiplies, reduces by the other.
PRIMES = (2147483647, 2147483629)


def sides(rows: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid with at least ``rows`` cells."""
    a = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    return a, max(1, -(-max(rows, 1) // a))


def round_keys(seed: int) -> list[tuple[int, int, int, int]]:
    flat = constants(seed, 4 * ROUNDS)
    return [tuple(flat[4 * i:4 * i + 4]) for i in range(ROUNDS)]


def permuted(row: Column, rows: int, seed: int) -> Column:
    """The place of ``row`` (0 to rows - 1) in a shuffle of all rows.

    The grid of ``a`` times ``b`` cells exceeds ``rows`` by less than ``a``; a row that leaves the range walks its cycle on until
    it is back. A walk of at most sixteen steps ends but for one row in 2**64; if one did not, the job fails instead of giving a
    wrong place.
    """
    a, b = sides(rows)
    keys = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip("pqrsm", (*k, (a, b)[i % 2]), strict=True)])
                     for i, k in enumerate(round_keys(seed))])

    def turn(acc, k):
        mixed = ((acc["v"] + k["p"]) * k["q"] % F.lit(PRIMES[0]) * k["r"] + k["s"]) % F.lit(PRIMES[1])
        return F.struct(acc["v"].alias("u"), ((acc["u"] + mixed) % k["m"]).alias("v"))

    def once(x):
        start = F.struct(((x - x % F.lit(b)) / F.lit(b)).cast("bigint").alias("u"), (x % F.lit(b)).alias("v"))
        return F.aggregate(keys, start, turn, lambda acc: acc["u"] * F.lit(b).cast("bigint") + acc["v"])

    x = once(row.cast("bigint"))
    steps = min(a * b - rows, 16)
    if steps > 0:
        x = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda acc, _: F.when(acc < rows, acc).otherwise(once(acc)))
    return F.when(x < rows, x).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 20261, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard and its slot there, by the law ``rows``: shard sizes differ by one at most.

    A row's global number is its position by (key, CRC-32 of the text, size); the permutation of that number, divided by
    ``shards``, gives slot and shard, so both can be computed for any row number without data. Only key, size and checksum are
    shuffled. A null text has size 8 and the checksum of the empty text; a null key sorts first; rows that agree in all three
    are interchangeable; an empty table gives no rows. Other columns are ignored.

    ``grown_shard`` is null: by this law a shard more deals all rows anew.
    """
    bare = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = numbered(bare, ["doc_id", "text_crc32", "size"])
    total = rows.agg(F.count("*")).first()[0]
    place = permuted(F.col("row"), max(total, 1), seed)
    return (rows.withColumn("_place", place)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_place") % shards).cast("int").alias("shard"),
                    F.floor(F.col("_place") / shards).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def _sql(shards: int = 24, seed: int = 20261) -> str:
    def once(x: str, source: str) -> str:
        q = f"SELECT doc_id, size, text_crc32, {x} // b AS u, {x} % b AS v, n, a, b FROM {source}"
        for i, (p, k, r, s) in enumerate(round_keys(seed)):
            q = (f"SELECT doc_id, size, text_crc32, v AS u, (u + ((v + {p}) * {k} % {PRIMES[0]} * {r} + {s}) % {PRIMES[1]}) % {'ab'[i % 2]} AS v, "
                 f"n, a, b FROM ({q})")
        return f"SELECT doc_id, size, text_crc32, u * b + v AS x, n, a, b FROM ({q})"

    return f"""
WITH RECURSIVE bare AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {sql_crc32(sql_bytes("coalesce(text, '')"))} AS text_crc32 FROM documents),
total AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM bare),
rows AS (
  SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS r, n, a, ceil(n / a)::BIGINT AS b
  FROM bare, total),
walk AS ({once("r", "rows")} UNION ALL {once("x", "(SELECT * FROM walk WHERE x >= n)")})
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (x % {shards})::INT AS shard, (x // {shards})::BIGINT AS slot, NULL::INT AS grown_shard
FROM walk WHERE x < n"""


@query("op1_sharding", _sql())
def op1_sharding(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"))

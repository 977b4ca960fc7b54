"""Operator 9: shards by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bind, fresh, table, text_of

#: Fixed values of the round function: modulus, multipliers and the step between round keys.
MODULUS = 2147483648
MUL_1 = 1103515245
MUL_2 = 1664525
ROUND_STEP = 668265263
ROUNDS = 6
#: Hex digits of the key's md5 that name its bucket: 4096 buckets are numbered independently.
BUCKET_DIGITS = 3
#: Walking steps. The domain exceeds n by less than sqrt(n) + 1 points, so for n up to 4096 the bound is exact,
#: and beyond it 64 misses in a row have odds below 64 ** -64; a row that still missed would raise an error.
WALK = 64
N_SHARDS = 8
SEED = 20240229


def domain(n: int) -> tuple[int, int]:
    """Factors a, b with n <= a * b < n + a."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, max(1, -(-n // a))


def _mix(value: Column, key: int) -> Column:
    return bind(
        (value + F.lit(key)) % MODULUS * MUL_1 % MODULUS,
        lambda y: bind(y.bitwiseXOR(F.shiftright(y, 15)) * MUL_2 % MODULUS, lambda z: z.bitwiseXOR(F.shiftright(z, 13))),
    )


def _round(left: bool, size: int, key: int):
    """One half shifted by the mixed other half and the round's key. The function takes the state alone, as a second
    parameter would be given an array index."""

    def shifted(s: Column) -> Column:
        mine, other = ("l", "r") if left else ("r", "l")
        return F.struct(*(((s[mine] + _mix(s[other], key)) % size if c == mine else s[c]).alias(c) for c in "lr"))

    return shifted


def permute(p: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the Feistel network on [0, a * b): the halves, modulo a and b, take turns to be shifted."""
    state = F.struct(F.call_function("div", p, F.lit(b)).cast("long").alias("l"), (p % b).cast("long").alias("r"))
    for i in range(ROUNDS):
        state = bind(state, _round(i % 2 == 0, a if i % 2 == 0 else b, (seed + i * ROUND_STEP) % MODULUS))
    return bind(state, lambda s: s["l"] * b + s["r"])


def walked(p: Column, n: int, seed: int) -> Column:
    """Permutation of [0, n): points outside are sent through the network again until they fall inside."""
    a, b = domain(n)

    def again(x: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(WALK))
        out = F.aggregate(steps, x, lambda acc, _: F.when(acc < n, acc).otherwise(permute(acc, a, b, seed)))
        return F.when(x < n, x).otherwise(out)

    return bind(again(permute(p, a, b, seed)), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))


def feistel_shards(df: DataFrame, keys: list[str], n_shards: int, seed: int = SEED, row: str = "row", shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` with its global row number, shard and slot.

    Rows are numbered 0 to n - 1 by md5 bucket of ``keys``, then ``keys``: buckets are numbered in parallel and shifted
    by the rows of the buckets before, so no task sees more than a bucket. The number is permuted; shard is the
    permuted number modulo ``n_shards``, slot the quotient. Shards differ by one row at most and slots have no gap.
    Anyone who knows n can compute a row's place, and the same rows get the same places in every run. A null key
    counts as one value; rows with equal keys take their numbers in any order; an empty table stays empty. Columns of
    ``df`` named like the three results are replaced.
    """
    df = df.drop(row, shard, slot)
    bucket, before, rank = fresh(df, "bucket", "before", "rank")
    key = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in keys))
    df = df.withColumn(bucket, F.substring(F.md5(key), 1, BUCKET_DIGITS))
    counts = df.groupBy(bucket).agg(F.count("*").alias(rank))
    starts = counts.select(bucket, (F.sum(rank).over(Window.orderBy(bucket)) - F.col(rank)).alias(before))  # at most 16 ** BUCKET_DIGITS rows
    n = df.count()
    order = [F.col(c).asc_nulls_first() for c in keys]
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(bucket).orderBy(*order)).cast("long"))
    out = out.join(F.broadcast(starts), bucket).withColumn(row, F.col(before) + F.col(rank) - 1)
    place = fresh(out, "place")[0]
    out = out.withColumn(place, walked(F.col(row), n, seed))
    return out.withColumn(shard, (F.col(place) % n_shards).cast("int")).withColumn(slot, F.call_function("div", F.col(place), F.lit(n_shards)).cast("long")).drop(bucket, before, rank, place)


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text_of("text")) + 1).cast("long").alias("size"), F.crc32(text_of("text").cast("binary")).alias("text_crc32")
    )
    out = feistel_shards(docs, ["doc_id", "text_crc32"], N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with row, shard and slot; columns of these names are replaced, all others stay.

    Null texts count as any other; rows of one doc_id, or without one, take their places in any order, each a place of
    its own, so equal texts may part; no documents, no rows.
    """
    return feistel_shards(docs, ["doc_id"], N_SHARDS)


def _mix_sql(value: str, key: int) -> str:
    y = f"((({value}) + {key}) % {MODULUS} * {MUL_1} % {MODULUS})"
    z = f"(xor({y}, {y} >> 15) * {MUL_2} % {MODULUS})"
    return f"xor({z}, {z} >> 13)"


def _rounds_sql() -> str:
    """One pass of the network as nested selects over (r, p, n, a, b)."""
    sql = "SELECT id, p // b AS l, p % b AS r, n, a, b, step FROM walk WHERE p >= n OR step = 0"
    for i in range(ROUNDS):
        key = (SEED + i * ROUND_STEP) % MODULUS
        left, right = (f"(l + {_mix_sql('r', key)}) % a", "r") if i % 2 == 0 else ("l", f"(r + {_mix_sql('l', key)}) % b")
        sql = f"SELECT id, {left} AS l, {right} AS r, n, a, b, step FROM ({sql})"
    return f"SELECT id, l * b + r AS p, n, a, b, step + 1 AS step FROM ({sql})"


#: The row numbers, then passes of the network until a number falls inside; crc32 by its table of bytes.
OP9_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda acc, x: CASE WHEN acc % 2 = 1 THEN xor(3988292384, acc >> 1) ELSE acc >> 1 END) AS v FROM range(256) AS t(i))
), hexed AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), bytes AS (
  SELECT doc_id, len(h) // 2 + 1 AS size, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM hexed
), d AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda acc, x: xor(acc >> 8, tbl[xor(acc, x) % 256 + 1]))) AS text_crc32 FROM bytes, crc
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0)) || chr(31) || text_crc32), 1, {BUCKET_DIGITS}), doc_id NULLS FIRST, text_crc32) - 1 AS id, count(*) OVER () AS n FROM d
), sides AS (
  SELECT *, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM numbered
), walk AS (
  SELECT id, id AS p, n, a, (n + a - 1) // a AS b, 0 AS step FROM sides
  UNION ALL
  {_rounds_sql()}
), placed AS (
  SELECT id, p FROM walk WHERE p < n AND step > 0
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p % {N_SHARDS} AS INTEGER) AS shard, CAST(p // {N_SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, id AS "row"
FROM numbered JOIN placed USING (id)
"""

"""Sharding by a Feistel permutation with cycle walking over global row numbers. DataFrame functions only.

Law `rows`: shard counts differ by at most one.

1. Rows fall into buckets by a hash of their key and text; one aggregate counts the buckets, their running sums (in two
   levels) are the buckets' first numbers, and a row's number is that plus its rank by (doc_id, digests) in the bucket.
   So numbers depend on the rows alone, not on files, partitions or retries. The number of buckets follows the
   number of rows (`bucket_rows` each). Rows that agree in all of this and are more than `bucket_rows` are dealt over
   buckets of their own by their place in the table, and stored so (equal rows may swap their numbers, which as a set
   stay the same); so no task ranks more than a bounded share, however the keys are dealt.
2. A keyed Feistel network over Z_a x Z_b with a * b just above N permutes the numbers; values of N or more walk on
   along their cycle. With a = ceil(sqrt N) fewer than sqrt N + 1 values lie outside, so a walk of WALK steps that
   never returns has a chance below N^(-WALK/2), and none at all for N <= WALK^2; such a row would raise an error.
3. position = permuted number; shard = position mod shards, slot = position div shards: gapless, and computable for
   any row number without reading the others (`position_of`).

Rows: a null doc_id or text counts like any value (size of a null text: 8). Repeated rows get a number each. Columns of
docs named like a result column are replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running_starts, set_apart, stored, table

ROUNDS, WALK = 6, 40
#: The most rows of bucket numbers that are broadcast; more are joined.
BROADCAST = 1_000_000
BUCKETS_A_TASK = 16
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def position_of(number: Column, n: int, seed: int) -> Column:
    """The place of row `number` (0 to n - 1) in the shuffled order of n rows."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))

    def feistel(x: Column) -> Column:
        halves = F.struct((x % a).alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))
        if n >= 1 << 52:
            raise ValueError("more rows than a double counts exactly")

        def turn(h: Column, i: Column) -> Column:
            even = F.struct(
                ((h["l"] + F.pmod(F.xxhash64(h["r"], i, F.lit(seed)), F.lit(a))) % a).alias("l"), h["r"].alias("r")
            )
            odd = F.struct(
                h["l"].alias("l"), ((h["r"] + F.pmod(F.xxhash64(h["l"], i, F.lit(seed)), F.lit(b))) % b).alias("r")
            )
            return F.when(i % 2 == 0, even).otherwise(odd)

        rounds = F.array(*(F.lit(i) for i in range(ROUNDS)))
        return F.aggregate(rounds, halves, turn, lambda h: h["r"] * a + h["l"])

    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        feistel(number),
        lambda x, _: F.when(x < n, x).otherwise(feistel(x)),
    )
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))


def in_buckets(docs: DataFrame, buckets: int, bucket_rows: int) -> DataFrame:
    """docs (_digest) with `_bucket`; rows of a digest that more than bucket_rows share are dealt over further buckets."""
    plain = F.pmod("_digest", F.lit(buckets))
    equal = docs.groupBy("_digest").agg(F.count("*").alias("_n")).where(F.col("_n") > bucket_rows)
    hot = stored(equal.select("_digest", F.ceil(F.col("_n") / bucket_rows).cast("long").alias("_parts")))
    few = hot.count()  # at most n / bucket_rows
    if not few:
        return docs.withColumn("_bucket", plain)
    before = Window.orderBy("_digest").rowsBetween(Window.unboundedPreceding, -1)
    hot = stored(hot.withColumn("_from", F.lit(buckets) + F.coalesce(F.sum("_parts").over(before), F.lit(0))))
    hot = F.broadcast(hot) if few <= BROADCAST else hot
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts"))
    dealt = docs.join(hot, "_digest").withColumn("_bucket", F.col("_from") + place).drop("_from", "_parts")
    rest = docs.join(hot, "_digest", "left_anti").withColumn("_bucket", plain)
    return rest.unionByName(stored(dealt))  # stored: what is counted is what is ranked


def shard(
    docs: DataFrame,
    shards: int = 24,
    seed: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_rows: int = 5_000,
) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (null: the law is `rows`)."""
    docs = docs.drop(*RESULT)
    own = docs.columns
    docs, back = set_apart(docs)
    key, body = (F.col(f"`{docs.columns[own.index(c)]}`") for c in (id_col, text_col))
    text = F.coalesce(body, F.lit("")).cast("binary")
    docs = docs.withColumns({"size": F.octet_length(text).cast("long") + 8, "text_crc32": F.crc32(text)})
    docs = docs.withColumn("_digest", F.xxhash64(key, "text_crc32", "size", F.xxhash64(body)))
    n = docs.count()
    buckets = max(1, -(-n // bucket_rows))
    docs = in_buckets(docs, buckets, bucket_rows)
    # one row per bucket: n / bucket_rows rows, far below a broadcast's bound for any n
    counts = stored(running_starts(docs.groupBy("_bucket").agg(F.count("*").alias("_n")), "_bucket", "_n").drop("_n"))
    tasks = -(-buckets // BUCKETS_A_TASK)
    if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        docs = docs.repartition(tasks, "_bucket")  # the number of tasks follows the table
    within = Window.partitionBy("_bucket").orderBy(key, "_digest", "text_crc32", "size")
    ranked = docs.withColumn("_rank", F.row_number().over(within).cast("long") - 1)
    starts = F.broadcast(counts) if buckets <= BROADCAST else counts
    placed = ranked.join(starts, "_bucket").withColumn("_at", position_of(F.col("start") + F.col("_rank"), n, seed))
    return back(
        placed,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_at") % shards).cast("int").alias("shard"),
        F.floor(F.col("_at") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )

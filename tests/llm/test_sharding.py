import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import sharding as s

#: Besides the two that are read: a result column, and every working column.
WORKING = ("_rank", "_bucket", "_digest", "start", "_at", "_n", "_from", "_parts", "_place", "_block", "_head")
SCHEMA = "doc_id long, text string, shard string, " + ", ".join(f"{c} int" for c in WORKING)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000, 4097])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(s.position_of(F.col("id"), n, 6)).collect()]
    assert sorted(got) == list(range(n))
    if n >= 1000:
        assert sum(abs(a - b) for a, b in zip(got, range(n), strict=True)) > n * n / 4
        assert got != [r[0] for r in spark.range(n).select(s.position_of(F.col("id"), n, 7)).collect()]


def laws(rows, shards, n):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[k]) for k in range(shards)]
    assert sum(sizes) == n == len(rows) and max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_rows(spark):
    docs = [(k, f"text {k % 3}") for k in range(200)] + [(None, None)] * 20 + [(5, "same")] * 30 + [(300, ""), (301, "é" * 100_000)]
    frame = spark.createDataFrame([(*d, "clash", *range(len(WORKING))) for d in docs], SCHEMA)
    got = s.shard(frame, 24, bucket_rows=16).collect()
    laws(got, 24, len(docs))
    assert all(tuple(r[c] for c in WORKING) == tuple(range(len(WORKING))) for r in got)
    assert all(r["size"] == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    again = s.shard(frame.repartition(3), 24, bucket_rows=16).collect()  # numbers do not depend on partitions
    key = lambda r: (r.doc_id or -1, r.text or "", r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert s.shard(spark.createDataFrame([], SCHEMA)).collect() == []


def chained(*values):
    """The 64-bit hash of some values, each seeded by the one before; nulls are passed over."""
    h = 42
    for v, kind in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v if kind is None else struct.pack(kind, v), h)
    return h - 2**64 if h >= 2**63 else h


def brute(docs, shards, seed, bucket_rows):
    """(doc_id, text, shard, slot) by ranking and walking in plain Python."""
    rows = []
    for i, text in docs:
        raw = (text or "").encode()
        own = None if text is None else chained((raw, None))
        size, crc = len(raw) + 8, zlib.crc32(raw)
        rows.append((chained((i, "<q"), (crc, "<q"), (size, "<q"), (own if text is not None else 42, "<q")), i, text, crc, size))
    n, buckets = len(rows), -(-len(rows) // bucket_rows)
    rows.sort(key=lambda r: (r[0] % buckets, r[1] is not None, r[1] or 0, r[0], r[3], r[4]))
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def turned(x):
        left, right = x % a, x // a
        for k in range(s.ROUNDS):
            if k % 2 == 0:
                left = (left + chained((right, "<q"), (k, "<i"), (seed, "<i")) % a) % a
            else:
                right = (right + chained((left, "<q"), (k, "<i"), (seed, "<i")) % b) % b
        return right * a + left

    out = []
    for number, (_, i, text, _, _) in enumerate(rows):
        at = turned(number)
        while at >= n:
            at = turned(at)
        out.append((i, text, at % shards, at // shards))
    return out


def test_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(None, "no id"), (None, None), (7, None), (7, ""), (-3, "x"), (-3, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for options in ((24, 6, 5_000), (5, 1, 32)):
        got = [(r.doc_id, r.text, r["shard"], r["slot"]) for r in s.shard(frame, *options[:2], bucket_rows=options[2]).collect()]
        assert Counter(got) == Counter(brute(docs, *options))


def test_equal_rows_are_dealt(spark):
    frame = spark.createDataFrame([(1, "same")] * 5000 + [(2, "other")] * 50 + [(k, "t") for k in range(10, 300)], "doc_id long, text string")
    sizes = s.in_buckets(frame.withColumn("_digest", F.xxhash64("doc_id", "text")), 54, 100).groupBy("_bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 200 and len(sizes) > 80
    laws(s.shard(frame, 24, bucket_rows=100).collect(), 24, 5340)


def test_query(spark):
    got = s.op6_shard(spark, "/root/testdata/sf0.001").collect()
    laws(got, 24, 200)

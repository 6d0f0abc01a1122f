from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.common import filtered, parted, running_starts, set_apart
from quire.llm.minhash_dedup import remove_near_duplicates


def test_filtered_loses_nothing(spark, monkeypatch):
    left = spark.range(20_000).withColumnRenamed("id", "k").selectExpr("if(k % 1000 = 7, null, k) as k", "k as v")
    values = spark.range(0, 20_000, 50).union(spark.range(63, 64))
    want = {k for k in range(0, 20_000, 50)} | {63}
    for bits in (24, 8):  # with few bits the map is too full, and plain joins stand in
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        first, other = parted(left, "k", values)
        kept, rest = ({r.v for r in x.collect()} for x in (first, other))
        assert want <= kept and len(kept) < len(want) + 40
        assert not rest & kept and rest | kept == set(range(20_000))
    assert filtered(left, "k", values.limit(0)).count() == 0 and parted(left, "k", values.limit(0))[1].count() == 20_000


def test_set_apart(spark):
    frame = spark.createDataFrame([(1, "t", 2, 3, 4)], "doc_id long, text string, `a.b` int, _x int, `column 2` int")
    apart, back = set_apart(frame, "doc_id", "text")
    out = back(apart.withColumn("_x", F.lit("own")).withColumn("more", F.lit(5)), "more")
    assert out.columns == [*frame.columns, "more"] and tuple(out.first()) == (1, "t", 2, 3, 4, 5)


def test_running_starts(spark):
    frame = spark.range(0, 5000, 7).select(F.col("id").alias("k"), (F.col("id") % 11).alias("n"))
    got, total = {r.k: r.start for r in running_starts(frame, "k", "n", 64).collect()}, 0
    for k in range(0, 5000, 7):
        assert got[k] == total
        total += k % 11


def test_remove_near_duplicates(spark):
    text = " ".join(f"w{k}" for k in range(100))
    docs = [(5, text), (3, text + " end"), (4, "other"), (4, "other"), (None, text), (None, text), (6, None), (7, ""), (6, None)]
    # texts under one doc_id are documents each: unlike ones all stay, a near copy goes by itself
    docs += [(8, "one text"), (8, "a second text"), (9, "alone"), (9, text), (2, "a b c d e f"), (2, "A  b c d e f"), (2, "g h")]
    names = ("_own", "_key", "_word", "_bit", "_w", "_mask", "_stays", "kept", "raw", "node", "component", "digest", "column 2")
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    frame = spark.createDataFrame([(*d, *names) for d in docs], schema)
    out = remove_near_duplicates(frame)
    assert out.columns == frame.columns
    rows = out.collect()
    assert all(tuple(r)[2:] == names for r in rows)
    got = sorted((r.doc_id or -1, (r.text or "").lower().split()[:3]) for r in rows)
    assert got == [
        (-1, ["w0", "w1", "w2"]), (-1, ["w0", "w1", "w2"]), (2, ["a", "b", "c"]), (2, ["g", "h"]), (3, ["w0", "w1", "w2"]), (4, ["other"]),
        (6, []), (7, []), (8, ["a", "second", "text"]), (8, ["one", "text"]), (9, ["alone"]),
    ]

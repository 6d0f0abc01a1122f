from pyspark.sql import functions as F

from quire.functions.geometry import rect
from quire.plans import lifecycle as c
from quire.plans.standin import glyphs, pages, regions

SF = "/root/testdata/sf0.001"


def test_rotate_typed(spark):
    all_ = pages(spark, SF)
    typed = F.get(F.array(*map(F.lit, ("1", "1-2", "9-99", ",", "2,1,1"))), (F.col("doc_id") % 5).cast("int"))
    requests = all_.select("doc_id").distinct().select("doc_id", typed.alias("typed"), F.when(F.col("doc_id") % 7 == 0, 30).otherwise(90).alias("degrees"))
    done = c.rotate_typed(all_, requests)
    assert done.broken.count() == 0
    rules = {r.doc_id: r.error and r.error.rule for r in done.outcomes.collect()}
    assert len(rules) == requests.count()
    assert all(rules[k] == {2: "past-end", 3: "empty-item"}[k % 5] for k in rules if k % 5 in (2, 3))
    assert all(rules[k] == "degrees" for k in rules if k % 5 not in (2, 3) and k % 7 == 0)
    turned = {(r.doc_id, r.page_no): r.rotation for r in done.pages.collect()}
    for r in all_.collect():
        if rules[r.doc_id] is None:
            named = r.page_no == 1 or (r.page_no == 2 and r.doc_id % 5 in (1, 4))
            assert turned[r.doc_id, r.page_no] == (((r.rotation or 0) + 90) % 360 if named else r.rotation)
        else:
            assert (r.doc_id, r.page_no) not in turned


def test_redact(spark):
    all_ = glyphs(spark, SF).withColumn("stream_id", F.col("page_no")).cache()
    where = regions(spark, SF)
    ink = all_.where("doc_id % 5 = 0").select("doc_id", "page_no", "left", "bottom", "right", "top")
    uses = all_.select("doc_id", "stream_id").distinct().withColumn("uses", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1))
    mappings = all_.select("doc_id", "font", "code").distinct()
    keys = all_.select("doc_id", "page_no", F.col("font").alias("key")).distinct()
    done = c.redact(all_, ink, where, uses, mappings, keys, ("F1", "F2"))
    assert done.broken.count() == 0
    rules = {r.doc_id: r.error and r.error.rule for r in done.outcomes.collect()}
    assert set(rules.values()) == {None, "ink-in-region", "shared-stream"}
    kept = {r.doc_id for r in done.glyphs.select("doc_id").distinct().collect()}
    assert all(rules[k] is None for k in kept)
    cut = {r.doc_id: r for r in done.report.collect()}
    assert cut and all(rules[k] is None and r.n_cut > 0 and r.fonts_cut + r.fonts_kept > 0 for k, r in cut.items())
    before = {r.doc_id: r["count"] for r in all_.groupBy("doc_id").count().collect()}
    after = {r.doc_id: r["count"] for r in done.glyphs.groupBy("doc_id").count().collect()}
    assert all(before[k] - after.get(k, 0) >= r.n_cut for k, r in cut.items())


def test_nothing_left_of_a_region_in_the_open(spark):
    one = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 5.0, 5.0, "F1", 65, 0, 1), (1, 1, 1, 5.0, 0.0, 9.0, 5.0, "F1", 66, 0, 1)], "doc_id long, page_no long, glyph_ord long, left double, bottom double, right double, top double, font string, code long, op_ord long, stream_id long")
    where = spark.range(1).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(1).cast("bigint").alias("page_no"), rect(F.lit(0), F.lit(0), F.lit(5), F.lit(5)).alias("region"))
    done = c.redact(one, one.limit(0), where, spark.createDataFrame([(1, 1, 1)], "doc_id long, stream_id long, uses long"), one.select("doc_id", "font", "code"), one.select("doc_id", "page_no", F.lit("K").alias("key")), ("K",))
    assert [r.code for r in done.glyphs.collect()] == [66] == [r.code for r in done.mappings.collect()]  # touching is not meeting

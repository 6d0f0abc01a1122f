"""Verification: every result is read back and held against an explicit promise.

A promise is a table of what must be there. Each check returns rows of what is wrong; no rows is a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import outcome as o

#: The second reading's tolerance on page sizes, and how far a region shrinks, in points.
SIZE_TOLERANCE, SHRINK = 0.01, 0.05


def page_promise(pages: DataFrame) -> DataFrame:
    """Rows (doc_id, n_pages, rotations, digest): counts, rotations in page order, and a digest of the contents."""
    row = F.struct("page_no", F.coalesce("rotation", F.lit(0)).alias("r"), F.xxhash64("page_no", "body").alias("h"))
    listed = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("p"))
    return listed.select(
        "doc_id",
        F.size("p").cast("bigint").alias("n_pages"),
        F.transform("p", lambda x: x["r"]).alias("rotations"),
        F.xxhash64(F.transform("p", lambda x: x["h"])).alias("digest"),
    )


def broken_promises(promised: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (doc_id, error): a missing or extra document, a wrong count, then wrong rotations, then wrong contents."""
    p = promised.select("doc_id", *(F.col(c).alias(f"p_{c}") for c in ("n_pages", "rotations", "digest")))
    both = p.join(found, "doc_id", "full_outer")
    error = o.first_error(
        o.refused(F.col("p_n_pages").isNull() | F.col("n_pages").isNull(), "OutputRejected", "document"),
        o.refused(F.col("p_n_pages") != F.col("n_pages"), "OutputRejected", "page-count"),
        o.refused(F.col("p_rotations") != F.col("rotations"), "OutputRejected", "rotations"),
        o.refused(F.col("p_digest") != F.col("digest"), "OutputRejected", "contents"),
    )
    return both.select("doc_id", error.alias("error")).where("error is not null")


def region_not_cleared(glyphs: DataFrame, regions: DataFrame, mappings: DataFrame, keys: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Rows (doc_id, page_no, rule): a glyph left in a region, a cut font's mapping nothing draws, a key not allowed."""
    box = g.rect(*(F.col(s) for s in g.SIDES))
    left = glyphs.join(regions, ["doc_id", "page_no"]).where(g.intersects(box, F.col("region"))).select("doc_id", "page_no")
    drawn = glyphs.select("doc_id", "font", "code").distinct()
    undrawn = mappings.join(drawn, ["doc_id", "font", "code"], "left_anti").select("doc_id", F.lit(None).cast("bigint").alias("page_no"))
    extra = keys.where(~F.col("key").isin(*allowed)).select("doc_id", "page_no")
    return (
        left.distinct().withColumn("rule", F.lit("glyph-in-region"))
        .union(undrawn.distinct().withColumn("rule", F.lit("undrawn-mapping")))
        .union(extra.distinct().withColumn("rule", F.lit("key-not-allowed")))
    )


def second_reading(first: DataFrame, second: DataFrame, origins: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows (doc_id, page_no, rule) where an independent reader disagrees: pages, sizes, origins inside a region.

    first, second: rows (doc_id, page_no, width, height); origins: rows (doc_id, page_no, x, y) of the second reader.
    """
    a = first.select("doc_id", "page_no", F.col("width").alias("w"), F.col("height").alias("h"))
    both = a.join(second, ["doc_id", "page_no"], "full_outer")
    apart = (F.abs(F.col("w") - F.col("width")) > SIZE_TOLERANCE) | (F.abs(F.col("h") - F.col("height")) > SIZE_TOLERANCE)
    rule = F.when(F.col("w").isNull() | F.col("width").isNull(), "page-count").when(apart, "size")
    sizes = both.select("doc_id", "page_no", rule.alias("rule")).where("rule is not null")
    inner, x, y = F.col("region"), F.col("x"), F.col("y")
    inside = (x > inner["left"] + SHRINK) & (x < inner["right"] - SHRINK) & (y > inner["bottom"] + SHRINK) & (y < inner["top"] - SHRINK)
    text = origins.join(regions, ["doc_id", "page_no"]).where(inside).select("doc_id", "page_no").distinct()
    return sizes.union(text.withColumn("rule", F.lit("text-in-region")))


def unread_pages(expected: DataFrame, origins: DataFrame) -> DataFrame:
    """Rows (doc_id, page_no, rule): pages (doc_id, page_no) that hold text, of which the second reader finds none."""
    none = expected.select("doc_id", "page_no").distinct().join(origins, ["doc_id", "page_no"], "left_anti")
    return none.withColumn("rule", F.lit("no-text"))


def miscounted(examined: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows (doc_id, n_examined, n_cut) where a check has not looked at as many glyphs as were cut."""
    a = examined.groupBy("doc_id").agg(F.count("*").alias("n_examined"))
    both = a.join(cut.groupBy("doc_id").agg(F.count("*").alias("n_cut")), "doc_id", "full_outer").na.fill(0, ["n_examined", "n_cut"])
    return both.where("n_examined <> n_cut")


def broken_compression(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (doc_id, error): compression promises the same pages in strictly fewer bytes. Rows (doc_id, n_bytes, digest)."""
    both = before.select("doc_id", F.col("n_bytes").alias("_n"), F.col("digest").alias("_d")).join(after, "doc_id", "full_outer")
    error = o.first_error(
        o.refused(F.col("_n").isNull() | F.col("n_bytes").isNull(), "OutputRejected", "document"),
        o.refused(F.col("_d") != F.col("digest"), "OutputRejected", "contents"),
        o.refused(F.col("n_bytes") >= F.col("_n"), "OutputRejected", "not-smaller"),
    )
    return both.select("doc_id", error.alias("error")).where("error is not null")


def differences(expected: DataFrame, found: DataFrame, waivers: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows (key..., verdict): duplicate, missing, unexpected, different, waived, stale-waiver; equal rows are left out.

    Values compare null-safe. A waiver for a row that does not differ is stale, and an error of its own.
    """
    counts = found.groupBy(*key).agg(F.count("*").alias("n"), F.first(value).alias("_found"))
    want = expected.select(*key, F.col(value).alias("_want"), F.lit(True).alias("_e"))
    both = want.join(counts, key, "full_outer").join(waivers.select(*key, F.lit(True).alias("_w")), key, "full_outer")
    differs = ~F.col("_want").eqNullSafe(F.col("_found"))
    verdict = (
        F.when(F.col("n") > 1, "duplicate")
        .when(F.col("_e").isNull() & F.col("n").isNull(), "stale-waiver")
        .when(F.col("n").isNull(), "missing")
        .when(F.col("_e").isNull(), "unexpected")
        .when(differs & F.col("_w").isNotNull(), "waived")
        .when(differs, "different")
        .when(F.col("_w").isNotNull(), "stale-waiver")
    )
    return both.select(*key, verdict.alias("verdict")).where("verdict is not null")


def is_vacuous(expected: DataFrame, least: int) -> bool:
    """A comparison of fewer rows than promised proves nothing."""
    return expected.count() < least


def object_closure(before: DataFrame, after: DataFrame, edges: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows (doc_id, object, verdict): survivors as wanted are left out; trespassers, lost and open references stay.

    before, after, expected: rows (doc_id, object); edges: rows (doc_id, src, dst) of the output.
    """
    key = ["doc_id", "object"]
    lost = expected.join(after, key, "left_anti").withColumn("verdict", F.lit("lost"))
    trespass = after.join(before, key, "left_semi").join(expected, key, "left_anti").withColumn("verdict", F.lit("trespasser"))
    dst = edges.select("doc_id", F.col("dst").alias("object")).distinct()
    open_ = dst.join(after, key, "left_anti").withColumn("verdict", F.lit("open"))
    return lost.select(*key, "verdict").union(trespass.select(*key, "verdict")).union(open_.select(*key, "verdict"))


def audit(placements: DataFrame, observations: DataFrame) -> DataFrame:
    """placements (fixture, channel, expect) against observations (fixture, channel, before, after, refused).

    A needle must be seen before; afterwards it is refused, gone or present, as expected. Rows with `verdict`.
    """
    both = placements.join(observations, ["fixture", "channel"], "left")
    seen = F.when(F.col("refused"), "refused").when(F.col("after"), "present").otherwise("gone")
    verdict = (
        F.when(F.col("before").isNull(), "not-observed")
        .when(~F.col("before"), "never-there")
        .when(seen == F.col("expect"), "held")
        .otherwise(F.concat(F.lit("was-"), seen))
    )
    return both.select("fixture", "channel", "expect", verdict.alias("verdict"))


def rule_coverage(rules: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows (rule, verdict): rules that nothing probes, and probes of rules that do not exist."""
    both = rules.select("rule", F.lit(1).alias("_r")).join(seen.select("rule", F.lit(1).alias("_s")).distinct(), "rule", "full_outer")
    verdict = F.when(F.col("_s").isNull(), "not-probed").when(F.col("_r").isNull(), "unknown-rule")
    return both.select("rule", verdict.alias("verdict")).where("verdict is not null")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)

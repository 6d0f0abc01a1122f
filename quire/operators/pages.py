"""Operators on ordered page sequences.

Pages are rows (doc_id, page_no, rotation, body); page_no runs from 1 without holes and is the only order there is.
Requests are rows per document. Every operator returns a pair of DataFrames: pages of the documents that are
accepted, and one outcome row (doc_id, n_pages, error) per request. A refused document has no pages in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import outcome as o
from ..functions.geometry import pixels_at_dpi


def page_count(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))


def structure_check(pages: DataFrame, most_pages: int | None = None) -> DataFrame:
    """Rows (doc_id, n_pages, error): a page tree is sound if its numbers run from 1 without holes or repeats."""
    seen = pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"),
        F.countDistinct("page_no").alias("n"),
        F.min("page_no").alias("low"),
        F.max("page_no").alias("high"),
    )
    sound = (F.col("low") == 1) & (F.col("high") == F.col("n_pages")) & (F.col("n") == F.col("n_pages"))
    error = o.first_error(
        o.over("max_pages", "page_count", F.col("n_pages"), most_pages),
        o.refused(~F.coalesce(sound, F.lit(False)), "Malformed", "page-tree"),
    )
    return seen.select("doc_id", "n_pages", error.alias("error"))


def declared_rotation(rotation: Column) -> Column:
    """A declared rotation in 0 .. 359; undeclared is 0."""
    return F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(360))


def _accepted(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    return pages.join(outcomes.where("error is null").select("doc_id"), "doc_id", "left_semi")


def merge(pages: DataFrame, inputs: DataFrame, max_input_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """inputs: rows (out_id, input_ord, doc_id, n_bytes). Pages of the inputs follow one another in input_ord.

    The sizes' sum is checked first, then each input's page count; a failing input is named by its position. An input
    may be given more than once. Numbers come from per-input counts, so no task numbers a whole document twice over.
    """
    counts = page_count(pages)
    sized = inputs.join(counts, "doc_id", "left").withColumn("n", F.coalesce("n_pages", F.lit(0)))
    order = Window.partitionBy("out_id").orderBy("input_ord")
    placed = sized.withColumns(
        {
            "before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "position": F.row_number().over(order) - 1,
        }
    )
    totals = placed.groupBy("out_id").agg(
        F.sum("n_bytes").alias("bytes"),
        F.sum("n").alias("n_pages"),
        F.min(F.when(F.col("n") == 0, F.col("position"))).alias("bad"),
    )
    error = o.first_error(
        o.over("max_input_bytes", "input_size", F.col("bytes"), max_input_bytes),
        o.refused(F.col("bad").isNotNull(), "InputFailed", "no-pages", failed_input=F.col("bad")),
        o.over("max_pages", "page_count", F.col("n_pages")),
    )
    outcomes = totals.select(F.col("out_id").alias("doc_id"), "n_pages", error.alias("error"))
    good = placed.join(outcomes.where("error is null").select(F.col("doc_id").alias("out_id")), "out_id", "left_semi")
    merged = good.select("out_id", "doc_id", "before").join(pages, "doc_id")
    merged = merged.withColumn("page_no", F.col("before") + F.col("page_no")).drop("doc_id", "before")
    return merged.withColumnRenamed("out_id", "doc_id"), outcomes


def cuts_error(cuts: Column, n_pages: Column) -> Column:
    """Checked cut by cut, in their order: 0, then no increase, then not before the last page."""
    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.lit(None).cast("string").alias("rule"))

    def step(s: Column, c: Column) -> Column:
        rule = F.when(c < 1, "cut-zero").when(c <= s["last"], "cuts-not-increasing").when(c >= n_pages, "cut-past-end")
        return F.struct(c.alias("last"), F.coalesce(s["rule"], rule).alias("rule"))

    rule = F.aggregate(cuts, start, step)["rule"]
    return o.first_error(
        o.refused(F.coalesce(n_pages, F.lit(0)) == 0, "InvalidArgument", "no-pages"),
        o.refused(rule.isNotNull(), "InvalidArgument", rule),
    )


def split(pages: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: rows (doc_id, cuts: array<bigint>), the pages to cut after. The part number is a running sum of cuts.

    Result pages carry part (from 0) and page_no within the part.
    """
    known = requests.join(page_count(pages), "doc_id", "left")
    outcomes = known.select("doc_id", "n_pages", cuts_error(F.col("cuts"), F.col("n_pages")).alias("error"))
    good = known.join(outcomes.where("error is null").select("doc_id"), "doc_id", "left_semi").select("doc_id", "cuts")
    marks = good.select("doc_id", F.explode("cuts").alias("page_no"), F.lit(1).alias("cut"))
    marked = pages.join(good.select("doc_id"), "doc_id", "left_semi").join(marks, ["doc_id", "page_no"], "left")
    order = Window.partitionBy("doc_id").orderBy("page_no")
    part = F.coalesce(F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = marked.withColumn("part", part.cast("bigint")).drop("cut")
    within = Window.partitionBy("doc_id", "part").orderBy("page_no")
    return numbered.withColumn("page_no", F.row_number().over(within).cast("bigint")), outcomes


def split_every(pages: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """A cut after every n pages; arithmetic on page numbers, no window. n = 0 is refused."""
    counts = page_count(pages)
    error = o.refused(F.lit(n < 1), "InvalidArgument", "every-zero")
    outcomes = counts.select("doc_id", "n_pages", error.alias("error"))
    if n < 1:
        return pages.limit(0).withColumn("part", F.lit(0).cast("bigint")), outcomes
    part = F.floor((F.col("page_no") - 1) / n).cast("bigint")
    return pages.withColumns({"part": part, "page_no": F.col("page_no") - part * n}), outcomes


def parts(split_pages: DataFrame) -> DataFrame:
    """Rows (doc_id, part, first, n_pages): one per output document, for delivery part by part."""
    sizes = split_pages.groupBy("doc_id", "part").agg(F.count("*").alias("n_pages"))
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("first", F.coalesce(F.sum("n_pages").over(before), F.lit(0)) + 1)


def delivered_parts(parts_with_errors: DataFrame) -> DataFrame:
    """Splitting stops at the first failing part, after the parts before it went out. Adds `delivered`."""
    upto = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.coalesce(F.max(F.when(F.col("error").isNotNull(), 1)).over(upto), F.lit(0))
    return parts_with_errors.withColumn("delivered", failed == 0)


def delivered_renders(pages_with_errors: DataFrame) -> DataFrame:
    """Rendering goes on past a failing page. Adds `delivered`."""
    return pages_with_errors.withColumn("delivered", F.col("error").isNull())


def subset(pages: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: rows (doc_id, first, count), first from 0. An empty run or one past the end is refused."""
    known = requests.join(page_count(pages), "doc_id", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
    error = o.first_error(
        o.refused(F.col("count") < 1, "InvalidArgument", "empty-run"),
        o.refused((F.col("first") < 0) | (F.col("first") + F.col("count") > F.col("n_pages")), "InvalidArgument", "past-end"),
    )
    known = known.withColumn("error", error)
    good = known.where("error is null").select("doc_id", "first", "count")
    kept = pages.join(good, "doc_id").where("page_no > first and page_no <= first + count")
    return kept.withColumn("page_no", F.col("page_no") - F.col("first")).drop("first", "count"), known.select("doc_id", "n_pages", "error")


def rotate(pages: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: rows (doc_id, selected: array<bigint> from 1, degrees). A relative turn of the named pages.

    Checked in order: degrees a multiple of 90; pages named, each once, none before the first or past the end; a named
    page whose own rotation is no multiple of 90. Such a rotation on other pages is carried through.
    """
    odd = F.collect_set(F.when(F.col("rotation") % 90 != 0, F.col("page_no"))).alias("odd")
    known = requests.join(pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), odd), "doc_id", "left")
    s = F.col("selected")
    error = o.first_error(
        o.refused(F.col("degrees") % 90 != 0, "InvalidArgument", "degrees"),
        o.refused(F.coalesce(F.col("n_pages"), F.lit(0)) == 0, "InvalidArgument", "no-pages"),
        o.refused(F.size(s) == 0, "InvalidArgument", "none-named"),
        o.refused(F.exists(s, lambda p: p < 1), "InvalidArgument", "page-zero"),
        o.refused(F.exists(s, lambda p: p > F.col("n_pages")), "InvalidArgument", "past-end"),
        o.refused(F.size(F.array_distinct(s)) < F.size(s), "InvalidArgument", "named-twice"),
        o.refused(F.coalesce(F.arrays_overlap(s, F.col("odd")), F.lit(False)), "Malformed", "rotation-not-right"),
    )
    known = known.withColumn("error", error)
    good = known.where("error is null")
    named = good.select("doc_id", F.explode("selected").alias("page_no"), "degrees")
    turned = pages.join(good.select("doc_id"), "doc_id", "left_semi").join(named, ["doc_id", "page_no"], "left")
    rotation = F.when(F.col("degrees").isNotNull(), F.pmod(F.coalesce("rotation", F.lit(0)) + F.col("degrees"), F.lit(360)))
    return (
        turned.withColumn("rotation", F.coalesce(rotation, F.col("rotation")).cast("int")).drop("degrees"),
        known.select("doc_id", "n_pages", "error"),
    )


def reorder(pages: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: rows (doc_id, order: array<bigint>), a permutation of the pages from 1; the identity is allowed."""
    known = requests.join(page_count(pages), "doc_id", "left")
    order = F.col("order")
    error = o.first_error(
        o.refused(F.coalesce(F.col("n_pages"), F.lit(0)) == 0, "InvalidArgument", "no-pages"),
        o.refused(F.exists(order, lambda p: (p < 1) | (p > F.col("n_pages"))), "InvalidArgument", "past-end"),
        o.refused(F.size(F.array_distinct(order)) < F.size(order), "InvalidArgument", "named-twice"),
        o.refused(F.size(order) != F.col("n_pages"), "InvalidArgument", "not-every-page"),
    )
    known = known.withColumn("error", error)
    moves = known.where("error is null").select("doc_id", F.posexplode("order").alias("at", "page_no"))
    moved = pages.join(moves, ["doc_id", "page_no"])
    return moved.withColumn("page_no", F.col("at").cast("bigint") + 1).drop("at"), known.select("doc_id", "n_pages", "error")


def compress_choice(original_bytes: Column, produced_bytes: Column) -> Column:
    """Produced output is kept only if strictly smaller."""
    smaller = produced_bytes < original_bytes
    return F.struct(
        F.when(smaller, "Smaller").otherwise("NotSmaller").alias("outcome"),
        F.when(smaller, produced_bytes).otherwise(original_bytes).alias("kept_bytes"),
        smaller.alias("verified"),
    )


def flattened(pages: DataFrame, requests: DataFrame, dpi: int = 150) -> tuple[DataFrame, DataFrame]:
    """requests: rows (doc_id, page_no, width, height), a page and its displayed size in points. The page becomes a picture.

    Pages carry `picture` (width and height in pixels, null for the others); a picture has no text and rotation 0. A page past
    the end and a picture beyond the ceilings are refused.
    """
    wide, high = pixels_at_dpi(F.col("width"), dpi), pixels_at_dpi(F.col("height"), dpi)
    known = requests.withColumnRenamed("page_no", "_page").join(page_count(pages), "doc_id", "left")
    error = o.first_error(
        o.refused((F.col("_page") < 1) | (F.col("_page") > F.coalesce("n_pages", F.lit(0))), "InvalidArgument", "past-end"),
        o.flatten_gate(wide, high),
    )
    known = known.select("doc_id", "_page", "n_pages", F.struct(wide.alias("width"), high.alias("height")).alias("_picture"), error.alias("error"))
    good = known.where("error is null").select("doc_id", "_page", "_picture")
    hit = F.col("page_no") == F.col("_page")
    made = pages.join(good, "doc_id").withColumns(
        {
            "rotation": F.when(hit, 0).otherwise(F.col("rotation")),
            "body": F.when(~hit, F.col("body")),
            "picture": F.when(hit, F.col("_picture")),
        }
    )
    return made.drop("_page", "_picture"), known.select("doc_id", "n_pages", "error")


def drawn_annotations(annotations: DataFrame, requests: DataFrame) -> DataFrame:
    """Annotations (doc_id, ...) that a rendering draws: none, unless the request (doc_id, annotations) asks for them."""
    return annotations.join(requests.where("annotations").select("doc_id").distinct(), "doc_id", "left_semi")

"""Redaction on tables: what a region takes, what else must go with it, and what makes a page be refused.

Tables (FIXTURES.md): glyphs, ink and regions by (doc_id, page_no), operations by (doc_id, stream_id, op_ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions import outcome as o

PAGE = ["doc_id", "page_no"]


def box_of(side_columns: tuple[str, ...] = g.SIDES) -> Column:
    return g.rect(*(F.col(c) for c in side_columns))


def selected_glyphs(glyphs: DataFrame, regions: DataFrame) -> DataFrame:
    """glyphs whose box intersects a region of their page; regions: rows (doc_id, page_no, region: rect).

    A semi join: the page is the equi-join key, so the range predicate is checked only within a page; every glyph row stays
    as often as it is there, however many regions take it, and nothing is shuffled a second time to make it so.
    """
    there = regions.select(*(F.col(c).alias(f"_{c}") for c in PAGE), "region")
    hit = (F.col("doc_id") == F.col("_doc_id")) & (F.col("page_no") == F.col("_page_no")) & g.intersects(box_of(), F.col("region"))
    return glyphs.join(there, hit, "left_semi")


def ink_refusals(ink: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows (doc_id, page_no, error): any ink that reaches a region refuses the page; ink without a box reaches all."""
    box = F.when(F.col("left").isNotNull(), box_of())
    hit = ink.withColumn("_box", box).join(regions, PAGE).where(g.reaches(F.col("_box"), F.col("region")))
    return hit.select(*PAGE).distinct().withColumn("error", o.error("Unsupported", "ink-in-region"))


def cuts_by_operation(cut: DataFrame, shown: DataFrame) -> DataFrame:
    """Rows (doc_id, stream_id, op_ord, codes, error): each showing operation's cut codes, rewritten once.

    cut, shown: rows (doc_id, stream_id, op_ord, glyph_ord). A cut glyph that the operation does not show is refused.
    """
    key = ["doc_id", "stream_id", "op_ord"]
    wanted = cut.groupBy(*key).agg(F.array_sort(F.collect_set("glyph_ord")).alias("codes"))
    there = shown.groupBy(*key).agg(F.collect_set("glyph_ord").alias("_there"))
    known = wanted.join(there, key, "left")
    short = F.size(F.array_except("codes", F.coalesce("_there", F.array().cast("array<bigint>")))) > 0
    return known.select(*key, "codes", o.refused(short, "Internal", "cut-count").alias("error"))


def rewritten(items: DataFrame, cut: DataFrame, operations: DataFrame) -> DataFrame:
    """Rows (doc_id, stream_id, op_ord, content, error): each showing operation with a cut glyph as one TJ without it.

    items: what an operation shows, in the order of `item`: rows (doc_id, stream_id, op_ord, item, glyph_ord, code, move), a
    glyph with its code in hexadecimal and the adjustment that moves as far as it does, or a number of the array, glyph_ord
    null, as the move. cut: rows (doc_id, stream_id, op_ord, glyph_ord). operations: rows (doc_id, stream_id, op_ord, operator,
    word, char), the last two the spacings that a double quote sets. What ' and " do besides showing stands before the TJ.
    Content is null where refused.
    """
    key = ["doc_id", "stream_id", "op_ord"]
    gone = cut.select(*key, "glyph_ord").distinct().withColumn("_cut", F.lit(True))
    wanted = gone.groupBy(*key).agg(F.count("*").alias("_wanted"))
    marked = items.join(wanted.select(key), key, "left_semi").join(gone, [*key, "glyph_ord"], "left")
    kept = F.col("glyph_ord").isNotNull() & F.col("_cut").isNull()
    piece = F.struct("item", F.when(kept, F.concat(F.lit("<"), "code", F.lit(">"))).otherwise(F.col("move").cast("string")).alias("text"))
    shown = marked.groupBy(*key).agg(F.array_sort(F.collect_list(piece)).alias("_pieces"), F.count("_cut").alias("_found"))
    known = wanted.join(operations, key, "left").join(shown, key, "left")
    error = o.first_error(
        o.refused(~F.coalesce(F.col("operator").isin("Tj", "TJ", "'", '"'), F.lit(False)), "Malformed", "glyph-without-its-operation"),
        o.refused(F.coalesce("_found", F.lit(0)) < F.col("_wanted"), "Internal", "cut-count"),
    )
    spacing = F.concat_ws(" ", F.col("word").cast("string"), F.lit("Tw"), F.col("char").cast("string"), F.lit("Tc T* "))
    prefix = F.when(F.col("operator") == "'", "T* ").when(F.col("operator") == '"', spacing).otherwise("")
    array = F.replace(F.array_join(F.col("_pieces.text"), " "), F.lit("> <"), F.lit(""))  # neighbours that stay are one string
    content = F.when(F.col("error").isNull(), F.concat(prefix, F.lit("["), array, F.lit("] TJ")))
    return known.withColumn("error", error).select(*key, content.alias("content"), "error")


def marked_depth(operations: DataFrame) -> DataFrame:
    """operations with `depth`, the marked-content depth before each: BDC and BMC add one, EMC takes one, never below 0."""
    step = F.when(F.col("operator").isin("BDC", "BMC"), 1).when(F.col("operator") == "EMC", -1).otherwise(0)
    order = Window.partitionBy("doc_id", "stream_id").orderBy("op_ord")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    stepped = operations.withColumn("_sum", F.sum(step).over(upto))
    stepped = stepped.withColumn("_clamped", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
    return stepped.withColumn("depth", F.coalesce(F.last("_clamped").over(before), F.lit(0)).cast("bigint")).drop("_sum", "_clamped")


def marked_work(operations: DataFrame) -> DataFrame:
    return marked_depth(operations).groupBy("doc_id", "stream_id").agg(F.sum("depth").alias("work"))


def marked_spans(operations: DataFrame) -> DataFrame:
    """Rows (doc_id, stream_id, first, last): each BDC or BMC with the EMC that closes it, null if none does.

    At its own depth, an opening is closed by the next closing: one window over (depth, op_ord).
    """
    deep = marked_depth(operations).where(F.col("operator").isin("BDC", "BMC", "EMC"))
    level = F.when(F.col("operator") == "EMC", F.col("depth") - 1).otherwise(F.col("depth"))
    order = Window.partitionBy("doc_id", "stream_id", "_level").orderBy("op_ord")
    following = deep.withColumn("_level", level).where("_level >= 0").withColumn("last", F.lead("op_ord").over(order))
    return following.where("operator <> 'EMC'").select("doc_id", "stream_id", F.col("op_ord").alias("first"), "last")


def carried_text(spans: DataFrame, cut: DataFrame) -> DataFrame:
    """Marked-content spans (doc_id, stream_id, first, last) open at a cut operation: their spoken text must go."""
    at = cut.select("doc_id", "stream_id", "op_ord").distinct()
    inside = (F.col("op_ord") > F.col("first")) & (F.col("last").isNull() | (F.col("op_ord") < F.col("last")))
    return spans.join(at, ["doc_id", "stream_id"]).where(inside).select(spans.columns).distinct()


#: The keys of a marked-content property list that carry text.
CARRYING = ("ActualText", "Alt", "E")


def without_carried(properties: Column) -> Column:
    return F.map_filter(properties, lambda k, _: ~k.isin(*CARRYING))


def sharing_refusals(cut: DataFrame, uses: DataFrame) -> DataFrame:
    """Cut streams that are used more than once; uses: rows (doc_id, stream_id, uses). Rows (doc_id, stream_id, error)."""
    shared = uses.where("uses > 1").select("doc_id", "stream_id")
    hit = cut.select("doc_id", "stream_id").distinct().join(shared, ["doc_id", "stream_id"], "left_semi")
    return hit.withColumn("error", o.error("Unsupported", "shared-stream"))


def codes_still_drawn(glyphs: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows (doc_id, font, code) that some glyph outside the cut still draws."""
    rest = glyphs.join(cut.select(*PAGE, "glyph_ord"), [*PAGE, "glyph_ord"], "left_anti")
    return rest.select("doc_id", "font", "code").distinct()


def narrowed_fonts(mappings: DataFrame, drawn: DataFrame) -> DataFrame:
    """Font mappings (doc_id, font, code, ...) of codes still drawn; the others go."""
    return mappings.join(drawn, ["doc_id", "font", "code"], "left_semi")


def unknown_operators(operations: DataFrame, known: DataFrame) -> DataFrame:
    """Operations whose operator the table (operator, arity) lacks, or that have too few operands for it."""
    seen = operations.join(known, "operator", "left")
    error = o.first_error(
        o.refused(F.col("arity").isNull(), "Unsupported", "unknown-operator"),
        o.refused(F.col("n_operands") < F.col("arity"), "Malformed", "too-few-operands"),
    )
    return seen.withColumn("error", error).where("error is not null").drop("arity")


def shown_positions(codes: DataFrame) -> DataFrame:
    """codes (doc_id, stream_id, run, at, move) with `x`, the text position before each: a running sum of moves."""
    before = Window.partitionBy("doc_id", "stream_id", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return codes.withColumn("x", F.coalesce(F.sum("move").over(before), F.lit(0.0)))


def in_scope(uses: DataFrame, resources: DataFrame, names: list[str]) -> DataFrame:
    """uses (doc_id, page_no, form, *names) with what the names mean there: a form's own resources, else the page's.

    resources: rows (doc_id, page_no, form, *names, ...), form null for the page's. A form that has any resources of its own
    (rows with its name) never falls back to the page. Names that mean nothing there get an error. Form streams repeat on
    few pages and a use asks one scope, so each row meets one row of resources at most.
    """
    key = [*PAGE, "_scope"]
    own = resources.where("form is not null").select(*PAGE, "form").distinct().withColumn("_own", F.lit(True))
    asked = uses.join(own, [*PAGE, "form"], "left").withColumn("_scope", F.when(F.col("_own"), F.col("form")).otherwise("")).drop("_own")
    held = resources.withColumn("_scope", F.coalesce("form", F.lit(""))).drop("form").withColumn("_there", F.lit(True))
    found = asked.join(held, [*key, *names], "left")
    return found.withColumn("error", o.refused(F.col("_there").isNull(), "Unsupported", "unknown-resource")).drop("_scope", "_there")


def code_widths(codes: DataFrame, widths: DataFrame, standard: DataFrame) -> DataFrame:
    """codes (doc_id, font, base, code) with `width`: the font's own (doc_id, font, code, width), else the standard one.

    standard: a dimension table (base, code, width) that the caller has; a font without either gets an error.
    """
    known = codes.join(widths.withColumnRenamed("width", "_own"), ["doc_id", "font", "code"], "left")
    known = known.join(standard.withColumnRenamed("width", "_usual"), ["base", "code"], "left").withColumn("width", F.coalesce("_own", "_usual"))
    return known.withColumn("error", o.refused(F.col("width").isNull(), "Unsupported", "unknown-width")).drop("_own", "_usual")


def removed_annotations(annotations: DataFrame, regions: DataFrame) -> DataFrame:
    """Annotations (doc_id, page_no, annotation, left .. top) in a region; their dependants follow by trees.closure."""
    hit = annotations.join(regions, PAGE).where(g.intersects(box_of(), F.col("region")))
    return hit.select("doc_id", F.col("annotation").alias("node")).distinct()


def document_refusals(catalogs: DataFrame, objects: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows (doc_id, error): what lies outside a page but tells of it, and so refuses the whole document.

    catalogs: rows (doc_id, keys); objects: rows (doc_id, num, kind, keys, type, drops_null); marked: rows (doc_id, tag) of the
    marked content drawn. Judged in this order: an interactive form, or a field; a structure tree, or an element of one; a null
    value that a writer would drop; optional content of an object; optional content in marked content.
    """

    def any_of(condition: Column) -> Column:
        return F.max(F.when(condition, 1).otherwise(0))

    held = F.col("kind").isin("dictionary", "stream")
    facts = objects.groupBy("doc_id").agg(
        any_of(held & F.array_contains("keys", "FT")).alias("field"),
        any_of(held & F.col("type").isin("StructTreeRoot", "StructElem")).alias("element"),
        any_of(F.col("drops_null")).alias("null"),
        any_of(held & (F.array_contains("keys", "OC") | F.col("type").isin("OCG", "OCMD"))).alias("optional"),
    )
    shown = marked.groupBy("doc_id").agg(any_of(F.col("tag") == "OC").alias("shown"))
    known = catalogs.join(facts, "doc_id", "left").join(shown, "doc_id", "left")
    error = o.first_error(
        o.refused(F.array_contains("keys", "AcroForm") | (F.col("field") == 1), "Unsupported", "acroform-field"),
        o.refused(F.array_contains("keys", "StructTreeRoot") | (F.col("element") == 1), "Unsupported", "structure-tree"),
        o.refused(F.col("null") == 1, "Unsupported", "null-value"),
        o.refused(F.col("optional") == 1, "Unsupported", "optional-content"),
        o.refused(F.col("shown") == 1, "Unsupported", "optional-content-marked"),
    )
    return known.select("doc_id", error.alias("error")).where("error is not null")


#: Operators that show text, and that paint, inside a glyph procedure.
SHOWS, PAINTS = ("Tj", "TJ", "'", '"'), ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "sh", "Do", "EI")


def type_three(drawn: DataFrame, fonts: DataFrame, procedures: DataFrame) -> DataFrame:
    """Rows (doc_id, font, paints, error) of the drawn Type 3 fonts: procedures that show text are refused, others may paint.

    drawn: rows (doc_id, font); fonts: rows (doc_id, font, subtype); procedures: rows (doc_id, font, operator).
    """
    three = fonts.where("subtype = 'Type3'").join(drawn.select("doc_id", "font").distinct(), ["doc_id", "font"], "left_semi").select("doc_id", "font").distinct()
    used = procedures.groupBy("doc_id", "font").agg(
        F.max(F.col("operator").isin(*SHOWS)).alias("shows"), F.max(F.col("operator").isin(*PAINTS)).alias("paints")
    )
    error = o.refused(F.col("shows"), "Unsupported", "type3-shows-text")
    return three.join(used, ["doc_id", "font"], "left").select("doc_id", "font", F.coalesce("paints", F.lit(False)).alias("paints"), error.alias("error"))


def paint_disagreements(pixels: DataFrame, rectangles: DataFrame) -> DataFrame:
    """Rows (image, n): pixels (image, x, y, r, g, b) inside an image's rectangle (image, rect) that are not painted black."""
    inside = (F.col("x") >= F.col("rect.left")) & (F.col("x") < F.col("rect.right")) & (F.col("y") >= F.col("rect.top")) & (F.col("y") < F.col("rect.bottom"))
    bare = (F.col("r") != 0) | (F.col("g") != 0) | (F.col("b") != 0)
    return pixels.join(rectangles, "image").where(inside & bare).groupBy("image").agg(F.count("*").alias("n"))

"""Whole requests, from typed text or regions to a verified result."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import outcome as o
from ..functions.selection import page_selection
from ..operators import pages as p
from ..operators import redaction as r
from ..operators import verify as v


class Result(NamedTuple):
    pages: DataFrame
    outcomes: DataFrame  # (doc_id, error)
    broken: DataFrame  # (doc_id, error): what a second reading finds wrong; no rows is a pass


def rotate_typed(pages: DataFrame, requests: DataFrame) -> Result:
    """requests: rows (doc_id, typed, degrees). Parse the page list, turn the pages, and hold the result to its promise.

    The promise is computed from the input alone: the same documents and contents, with the turned rotations.
    """
    known = requests.join(p.page_count(pages), "doc_id", "left")
    parsed = known.withColumn("_a", page_selection(F.col("typed"), F.coalesce("n_pages", F.lit(0).cast("bigint"))))
    bad = parsed.where(~F.col("_a.ok")).select("doc_id", o.error("InvalidArgument", F.col("_a.problem")).alias("error"))
    good = parsed.where("_a.ok").select("doc_id", F.col("_a.pages").alias("selected"), "degrees")
    turned, outcomes = p.rotate(pages, good)
    accepted = outcomes.where("error is null").select("doc_id")
    named = good.join(accepted, "doc_id", "left_semi").select("doc_id", F.explode("selected").alias("page_no"), "degrees")
    promised = pages.join(accepted, "doc_id", "left_semi").join(named, ["doc_id", "page_no"], "left")
    turn = F.pmod(F.coalesce("rotation", F.lit(0)) + F.coalesce("degrees", F.lit(0)), F.lit(360))
    promised = promised.withColumn("rotation", F.when(F.col("degrees").isNotNull(), turn).otherwise(F.col("rotation")).cast("int"))
    broken = v.broken_promises(v.page_promise(promised.drop("degrees")), v.page_promise(turned))
    return Result(turned, outcomes.select("doc_id", "error").union(bad), broken)


class Redaction(NamedTuple):
    glyphs: DataFrame  # what stays, of accepted documents
    mappings: DataFrame  # font mappings that are still drawn
    outcomes: DataFrame  # (doc_id, error), one row per document with a region
    report: DataFrame  # (doc_id, n_cut, fonts_cut, fonts_kept)
    broken: DataFrame  # what the check of the result finds; no rows is a pass


def redact(glyphs: DataFrame, ink: DataFrame, regions: DataFrame, uses: DataFrame, mappings: DataFrame, keys: DataFrame, allowed: tuple[str, ...]) -> Redaction:
    """Take the glyphs in the regions, with what only they draw; refuse whole documents that cannot be cleared.

    Tables as in operators.redaction; glyphs carry stream_id; uses: rows (doc_id, stream_id, uses); mappings: rows
    (doc_id, font, code, ...); keys: rows (doc_id, page_no, key), of which only allowed ones stay.
    """
    cut = r.selected_glyphs(glyphs, regions)
    refusals = (
        r.ink_refusals(ink, regions).select("doc_id", F.lit(0).alias("_order"), "error")
        .union(r.sharing_refusals(cut, uses).select("doc_id", F.lit(1).alias("_order"), "error"))
    )
    first = refusals.groupBy("doc_id").agg(F.min_by("error", "_order").alias("error"))
    outcomes = regions.select("doc_id").distinct().join(first, "doc_id", "left")
    accepted = outcomes.where("error is null").select("doc_id")

    def of(df: DataFrame) -> DataFrame:
        return df.join(accepted, "doc_id", "left_semi")

    place = ["doc_id", "page_no", "glyph_ord"]
    gone = of(cut)
    kept = of(glyphs).join(gone.select(place).distinct(), place, "left_anti")
    touched = gone.select("doc_id", "font").distinct()
    drawn = kept.select("doc_id", "font", "code").distinct()
    others = of(mappings).join(touched, ["doc_id", "font"], "left_anti")
    narrowed = r.narrowed_fonts(of(mappings).join(touched, ["doc_id", "font"], "left_semi"), drawn).select(others.columns).union(others)
    left = kept.select("doc_id", "font").distinct().withColumn("_left", F.lit(True))
    fonts = touched.join(left, ["doc_id", "font"], "left").groupBy("doc_id").agg(
        F.count(F.when(F.col("_left").isNull(), 1)).alias("fonts_cut"), F.count("_left").alias("fonts_kept")
    )
    report = gone.groupBy("doc_id").agg(F.count("*").alias("n_cut")).join(fonts, "doc_id")
    checked = narrowed.join(touched, ["doc_id", "font"], "left_semi")
    stripped = of(keys).where(F.col("key").isin(*allowed))
    return Redaction(kept, narrowed, outcomes, report, v.region_not_cleared(kept, of(regions), checked, stripped, allowed))

"""Rectangles, affine matrices, page frames and regions as column expressions.

A rectangle is a struct (left, bottom, right, top); a matrix is a struct (a, b, c, d, e, f) acting on row vectors.
Comparisons with NaN are false, as in IEEE arithmetic, although Spark orders NaN above every number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .outcome import error, first_error, refused

SIDES = ("left", "bottom", "right", "top")


def rect(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    values = zip((left, bottom, right, top), SIDES, strict=True)
    return F.struct(*((x if isinstance(x, Column) else F.lit(x)).cast("double").alias(n) for x, n in values))


def _numbers(*rects: Column) -> Column:
    return reduce(lambda a, b: a & b, (~F.isnan(r[s]) for r in rects for s in SIDES))


def intersects(a: Column, b: Column) -> Column:
    """Strict on all four edges: rectangles that only touch do not intersect."""
    return _numbers(a, b) & (a["left"] < b["right"]) & (b["left"] < a["right"]) & (a["bottom"] < b["top"]) & (b["bottom"] < a["top"])


def contains(outer: Column, inner: Column) -> Column:
    """Edges included."""
    return (
        _numbers(outer, inner)
        & (outer["left"] <= inner["left"]) & (inner["right"] <= outer["right"])
        & (outer["bottom"] <= inner["bottom"]) & (inner["top"] <= outer["top"])
    )


def reaches(ink: Column, region: Column) -> Column:
    """Ink without an extent reaches everything."""
    return F.when(ink.isNull(), F.lit(True)).otherwise(intersects(ink, region))


def union(a: Column, b: Column) -> Column:
    return rect(
        F.least(a["left"], b["left"]), F.least(a["bottom"], b["bottom"]), F.greatest(a["right"], b["right"]), F.greatest(a["top"], b["top"])
    )


def grown(r: Column, by: Column) -> Column:
    return rect(r["left"] - by, r["bottom"] - by, r["right"] + by, r["top"] + by)


def matrix(a, b, c, d, e, f) -> Column:
    values = zip((a, b, c, d, e, f), "abcdef", strict=True)
    return F.struct(*((x if isinstance(x, Column) else F.lit(x)).cast("double").alias(n) for x, n in values))


def compose(m: Column, n: Column) -> Column:
    """First m, then n."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"],
        m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def apply(m: Column, x: Column, y: Column) -> Column:
    return F.struct((x * m["a"] + y * m["c"] + m["e"]).alias("x"), (x * m["b"] + y * m["d"] + m["f"]).alias("y"))


def transformed(r: Column, m: Column) -> Column:
    """The box of all four transformed corners."""
    corners = [apply(m, r[x], r[y]) for x in ("left", "right") for y in ("bottom", "top")]
    xs, ys = [c["x"] for c in corners], [c["y"] for c in corners]
    return rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def displayed_size(box: Column, rotate: Column) -> tuple[Column, Column]:
    w, h = box["right"] - box["left"], box["top"] - box["bottom"]
    turned = rotate.isin(90, 270)
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def region_error(left: Column, top: Column, width: Column, height: Column, box: Column, rotate: Column) -> Column:
    """Why a region cannot be placed on a page, or null."""
    w, h = box["right"] - box["left"], box["top"] - box["bottom"]
    all_finite = reduce(lambda a, b: a & b, map(finite, (left, top, width, height)))
    return first_error(
        refused(~rotate.isin(0, 90, 180, 270), "Malformed", "rotation"),
        refused(~all_finite | (width <= 0) | (height <= 0), "Malformed", "region-extent"),
        refused(~(finite(w) & finite(h) & (w > 0) & (h > 0)), "Malformed", "display-box"),
    )


def region_to_content(left: Column, top: Column, width: Column, height: Column, box: Column, rotate: Column) -> Column:
    """A region, measured from the display's top left, as a rectangle of the page's content space (user unit 1)."""
    dw, dh = displayed_size(box, rotate)
    cases = {
        0: (left, dh - top - height, left + width, dh - top),
        90: (top, left, top + height, left + width),
        180: (dw - left - width, top, dw - left, top + height),
        270: (dh - top - height, dw - left - width, dh - top, dw - left),
    }

    def pick(k: int) -> Column:
        return reduce(lambda c, r: c.when(rotate == r, cases[r][k]), (90, 180, 270), F.when(rotate == 0, cases[0][k]))

    return rect(pick(0) + box["left"], pick(1) + box["bottom"], pick(2) + box["left"], pick(3) + box["bottom"])


def crop_to_media(crop: Column, media: Column) -> Column:
    """The display box: the crop box, if any, clipped to the media box."""
    clipped = rect(
        F.greatest(crop["left"], media["left"]), F.greatest(crop["bottom"], media["bottom"]),
        F.least(crop["right"], media["right"]), F.least(crop["top"], media["top"]),
    )
    return F.when(crop.isNull(), media).otherwise(clipped)


def frame_error(crop: Column, crop_inherited: Column, media: Column, rotate: Column, rotate_inherited: Column, unit: Column) -> Column:
    """Why a page has no frame that every reader agrees on, or null. Checked in this order."""
    box = crop_to_media(crop, media)
    turn = F.coalesce(rotate, F.lit(0.0))
    return first_error(
        refused(crop.isNotNull() & crop_inherited, "Unsupported", "page-attribute-inherited"),
        refused(media.isNull(), "Malformed", "no-display-box"),
        refused((box["right"] <= box["left"]) | (box["top"] <= box["bottom"]), "Malformed", "unreadable-box"),
        refused(rotate.isNotNull() & rotate_inherited, "Unsupported", "page-attribute-inherited"),
        refused(turn != F.floor(turn), "Malformed", "rotate-not-whole"),
        refused(F.coalesce(unit, F.lit(1.0)) != 1.0, "Unsupported", "user-unit-not-one"),
    )


#: Dots per inch of a flattened page, points per inch, and the painted margin in pixels.
DPI, POINTS, MARGIN = 150, 72, 2


def pixels_at_dpi(points: Column, dpi: int = DPI) -> Column:
    """The smallest whole number of pixels that holds a side of so many points."""
    return F.ceil(points * dpi / POINTS).cast("bigint")


def paint_rectangle(corners: list[tuple[Column, Column]], width: Column, height: Column, margin: int = MARGIN) -> Column:
    """The box of device corners, outward to whole pixels, with a margin, clamped to the picture; null if empty."""
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]

    def clamped(x: Column, most: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0)), most).cast("bigint")

    r = F.struct(
        clamped(F.floor(F.least(*xs)) - margin, width).alias("left"),
        clamped(F.floor(F.least(*ys)) - margin, height).alias("top"),
        clamped(F.ceil(F.greatest(*xs)) + margin, width).alias("right"),
        clamped(F.ceil(F.greatest(*ys)) + margin, height).alias("bottom"),
    )
    return F.when((r["left"] < r["right"]) & (r["top"] < r["bottom"]), r)


def fit_into(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """The size in pixels of a page of so many points fitted into a box: aspect kept, at least 1, at most the box."""
    scale = F.least(box_width / width, box_height / height)

    def side(points: Column, most: Column) -> Column:
        return F.least(F.round(F.greatest(points * scale, F.lit(1.0))).cast("bigint"), most.cast("bigint"))

    usable = finite(width) & finite(height) & (width > 0) & (height > 0)
    return F.when(usable, F.struct(side(width, box_width).alias("width"), side(height, box_height).alias("height")))


def fit_error(width: Column, height: Column) -> Column:
    usable = finite(width) & finite(height) & (width > 0) & (height > 0)
    return F.when(~usable, error("Malformed", "page-size"))


def shown_width(code_width: Column, size: Column, char_space: Column, word_space: Column, h_scale: Column, is_space: Column) -> Column:
    """How far showing one code moves the text position; word space counts only for the one-byte code 32."""
    return (code_width * size + char_space + F.when(is_space, word_space).otherwise(0.0)) * h_scale


def adjusted(value: Column, size: Column, h_scale: Column) -> Column:
    """How far a number in a shown array moves the text position."""
    return -value / 1000 * size * h_scale


def glyph_box(advance: Column, font_box: Column, floor_box: Column, stroke: Column, drift: Column) -> Column:
    """A box that no drawing of the glyph leaves: advance, font and floor boxes, grown by stroke reach and drift."""
    return grown(union(union(advance, font_box), floor_box), stroke + drift)


def stroke_reach(line_width: Column, mitre: Column, mitred: Column) -> Column:
    """How far a stroke paints beyond its path: half the width, times the mitre limit where joins are mitred."""
    return F.abs(line_width) / 2 * F.when(mitred, F.greatest(mitre, F.lit(1.0))).otherwise(1.0)


#: Fixed value: the margin, in pixels, of the rectangle that a check derives for itself.
CHECK_MARGIN = 1


def check_rectangle(region: Column, display: tuple[Column, Column], size: tuple[Column, Column]) -> Column:
    """A region (left, top, width, height in points of the display) in pixels, by scaling alone; null if empty or not placeable."""
    across, down = size[0] / display[0], size[1] / display[1]
    right, bottom = region["left"] + region["width"], region["top"] + region["height"]
    corners = [(region["left"] * across, region["top"] * down), (right * across, bottom * down)]
    usable = finite(region["left"]) & finite(region["top"]) & finite(region["width"]) & finite(region["height"])
    return F.when(usable & (region["width"] > 0) & (region["height"] > 0), paint_rectangle(corners, *size, CHECK_MARGIN))

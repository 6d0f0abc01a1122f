"""The three typed page lists, as column expressions over (text, pages).

They differ on purpose. A selection is a set: overlaps merge, empty items and backward ranges are refused. A cut list
is a sequence: empty items are skipped, repeats and disorder are refused, and so is the last page. An order is a
permutation: backward ranges are fine, repeats are refused, and pages not named follow in their own order.

Each returns a struct (ok, problem, pages); ranges are checked before they are expanded. A problem is one of the
names below; the first item in the list that has one decides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest texts of a selection, and of cut and order lists.
SELECTION_CHARS, LIST_CHARS = 2_000, 20_000
WHITE = r"[\s\x{FEFF}]+"
EMPTY = "cast(array() as array<bigint>)"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{WHITE}|{WHITE}$", "")


def items(text: Column) -> Column:
    return F.transform(F.split(text, ",", -1), trimmed)


def number(digits: Column) -> Column:
    """A run of digits; beyond what a page number can be, a number past every end."""
    short = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.when(F.length(short) > 18, F.lit(10**18)).otherwise(short.cast("bigint"))


def _answer(problem: Column, pages: Column) -> Column:
    good = problem.isNull()
    return F.struct(good.alias("ok"), problem.alias("problem"), F.when(good, pages).alias("pages"))


def _first_problem(parsed: Column) -> Column:
    return F.get(F.filter(F.transform(parsed, lambda p: p["problem"]), lambda p: p.isNotNull()), F.lit(0))


def page_selection(text: Column, pages: Column) -> Column:
    """`1-3, 5` -> sorted distinct pages."""

    def one(part: Column) -> Column:
        bounds = F.transform(F.split(part, "-", -1), trimmed)
        good = F.forall(bounds, lambda b: b.rlike("^[0-9]{1,9}$"))
        low = F.when(good, F.get(bounds, F.lit(0)).cast("bigint"))
        high = F.when(good, F.element_at(bounds, -1).cast("bigint"))
        problem = (
            F.when(part == "", "empty-item")
            .when(F.size(bounds) > 2, "not-a-range")
            .when(~good, "not-a-number")
            .when(low < 1, "before-first")
            .when(low > pages, "past-end")
            .when(high < 1, "before-first")
            .when(high > pages, "past-end")
            .when(low > high, "backwards")
        )
        return F.struct(problem.alias("problem"), low.alias("low"), high.alias("high"))

    parsed = F.transform(items(trimmed(text)), one)
    problem = (
        F.when(F.length(text) > SELECTION_CHARS, "too-long")
        .when(trimmed(text) == "", "empty")
        .when(pages <= 0, "no-pages")
        .otherwise(_first_problem(parsed))
    )
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform(parsed, lambda p: F.sequence(p["low"], p["high"])))))
    return _answer(problem, F.when(problem.isNull(), listed))


def _ranges(text: Column, bad) -> Column:
    """Items that are not empty, as (problem, low, high)."""

    def one(part: Column) -> Column:
        good = part.rlike(r"^[0-9]+(\s*-\s*[0-9]+)?$")
        bounds = F.split(part, r"\s*-\s*", -1)
        low, high = F.when(good, number(F.get(bounds, F.lit(0)))), F.when(good, number(F.element_at(bounds, -1)))
        return F.struct(F.when(~good, "not-a-number").otherwise(bad(low, high)).alias("problem"), low.alias("low"), high.alias("high"))

    return F.transform(F.filter(items(text), lambda p: p != ""), one)


def cut_list(text: Column, pages: Column) -> Column:
    """`3, 7-9` -> the pages to cut after, strictly increasing, all before the last page."""

    def bad(low: Column, high: Column) -> Column:
        outside = F.when((low < 1) | (high < 1), "before-first").when((low >= pages) | (high >= pages), "past-end")
        return F.coalesce(outside, F.when(high < low, "backwards"))

    parsed = _ranges(text, bad)
    # of the items so far: the last cut, and the first problem; an item's own problem comes before its place in order
    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.lit(None).cast("string").alias("problem"))

    def step(s: Column, p: Column) -> Column:
        order = F.when(p["low"] == s["last"], "twice").when(p["low"] < s["last"], "out-of-order")
        return F.struct(p["high"].alias("last"), F.coalesce(s["problem"], p["problem"], order).alias("problem"))

    problem = (
        F.when(pages <= 0, "no-pages").when(F.length(text) > LIST_CHARS, "too-long").otherwise(F.aggregate(parsed, start, step)["problem"])
    )
    listed = F.flatten(F.transform(parsed, lambda p: F.sequence(p["low"], p["high"])))
    return _answer(problem, F.when(problem.isNull(), listed))


def order_list(text: Column, pages: Column) -> Column:
    """`3, 9-5` -> the whole new order: the named pages, then the others in their order."""

    def bad(low: Column, high: Column) -> Column:
        return F.when((low < 1) | (high < 1), "before-first").when((low > pages) | (high > pages), "past-end")

    parsed = _ranges(text, bad)
    own = _first_problem(parsed)
    # ranges expand only where every bound has been checked
    named = F.when(own.isNull() & (pages > 0), F.flatten(F.transform(parsed, lambda p: F.sequence(p["low"], p["high"]))))
    twice = F.when(F.size(F.array_distinct(named)) < F.size(named), "twice")
    problem = F.when(pages <= 0, "no-pages").when(F.length(text) > LIST_CHARS, "too-long").otherwise(F.coalesce(own, twice))
    every = F.when(pages > 0, F.sequence(F.lit(1).cast("bigint"), pages.cast("bigint")))
    return _answer(problem, F.when(problem.isNull(), F.concat(named, F.array_except(every, named))))


def is_unchanged(order: Column) -> Column:
    return F.forall(F.arrays_zip(order.alias("p"), F.sequence(F.lit(1), F.size(order)).alias("i")), lambda x: x["p"] == x["i"])


def parts_from(cuts: Column, pages: Column) -> Column:
    """Validated cuts -> the parts as structs (first, count)."""
    starts = F.concat(F.array(F.lit(1).cast("bigint")), F.transform(cuts, lambda c: c + 1))
    ends = F.concat(cuts, F.array(pages.cast("bigint")))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("first"), (e - s + 1).alias("count")))


def is_whole(parts: Column) -> Column:
    return F.size(parts) <= 1


def every_page_cuts(pages: Column) -> Column:
    """The list that cuts after every page, as typed text."""
    return F.when(pages >= 3, F.concat(F.lit("1-"), (pages - 1).cast("string"))).otherwise("1")

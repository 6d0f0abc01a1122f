"""Refusals as data: limits, stages and error structs.

An operator never fails the job for one document. It returns an error struct per document, null where all is well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default ceilings, the stages in order, the kinds of error.
LIMITS = {
    "max_input_bytes": 512 << 20,
    "max_memory_bytes": 1 << 30,
    "max_duration_ms": 60_000,
    "max_pages": 10_000,
    "max_pixels": 256 << 20,
}
STAGES = ("input_size", "size_estimate", "prescan", "page_count", "pixels", "measured", "deadline")
KINDS = (
    "Malformed", "Unsupported", "PasswordRequired", "LimitExceeded", "InvalidArgument", "Io", "Internal", "OutputRejected",
    "InputFailed",
)
ERROR = "struct<kind:string,rule:string,limit:string,stage:string,requested:bigint,allowed:bigint,failed_input:int>"


def error(kind: str, rule: str | None = None, *, limit=None, stage=None, requested=None, allowed=None, failed_input=None) -> Column:
    """An error struct; values may be Columns."""

    def value(x, t: str) -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast(t)

    return F.struct(
        F.lit(kind).alias("kind"),
        value(rule, "string").alias("rule"),
        value(limit, "string").alias("limit"),
        value(stage, "string").alias("stage"),
        value(requested, "bigint").alias("requested"),
        value(allowed, "bigint").alias("allowed"),
        value(failed_input, "int").alias("failed_input"),
    )


def refused(condition: Column, *args, **kwargs) -> Column:
    """The error struct where the condition holds, else null. An unknown condition is no refusal."""
    return F.when(condition, error(*args, **kwargs)).otherwise(F.lit(None).cast(ERROR))


def over(limit: str, stage: str, requested: Column, allowed: Column | int | None = None) -> Column:
    """A limit refuses if and only if more is requested than allowed."""
    allowed = F.lit(LIMITS[limit]) if allowed is None else allowed if isinstance(allowed, Column) else F.lit(allowed)
    return refused(requested > allowed, "LimitExceeded", limit=limit, stage=stage, requested=requested, allowed=allowed)


def first_error(*checks: Column) -> Column:
    """The first check that refused, in the order given."""
    return reduce(lambda a, b: F.coalesce(a, b), checks)


def flat(error_column: str = "error") -> list[Column]:
    """ok, kind, rule, limit, stage, requested, allowed, failed_input of an error struct, for plain tables."""
    e = F.col(error_column)
    names = ("kind", "rule", "limit", "stage", "requested", "allowed", "failed_input")
    return [e.isNull().alias("ok"), *(e[n].alias(n) for n in names)]


#: Fixed values of the size estimate.
BASE_OVERHEAD, MEASURED_MARGIN, XREF_ENTRY_BYTES = 16 << 20, 64 << 20, 64
MOST = 2**63 - 1


def saturating_sum(*xs: Column) -> Column:
    """A sum of non-negative BIGINTs that stays at the largest BIGINT instead of overflowing."""
    return reduce(lambda a, b: F.when(a > F.lit(MOST) - b, F.lit(MOST)).otherwise(a + b), xs)


def estimated_open_bytes(size: Column) -> Column:
    return saturating_sum(size, F.floor(size / 4).cast("bigint"), F.lit(BASE_OVERHEAD))


def open_gate(size: Column, xref_entries: Column, largest_stream: Column, entry_past_end: Column, limits: dict | None = None) -> Column:
    """The checks before a document is opened: input size, estimate, then what the pre-scan declared."""
    allowed = LIMITS | (limits or {})
    return first_error(
        over("max_input_bytes", "input_size", size, allowed["max_input_bytes"]),
        over("max_memory_bytes", "size_estimate", estimated_open_bytes(size), allowed["max_memory_bytes"]),
        refused(largest_stream > size, "Malformed", "stream-longer-than-file"),
        refused(entry_past_end, "Malformed", "entry-past-end"),
        over("max_memory_bytes", "prescan", xref_entries * XREF_ENTRY_BYTES, allowed["max_memory_bytes"]),
    )


def measured_gate(at_open: Column, now: Column, allowed: int | None = None) -> Column:
    """Growth beyond the ceiling and a noise margin refuses, and reports the growth against the ceiling."""
    most = allowed or LIMITS["max_memory_bytes"]
    grown = F.greatest(now - at_open, F.lit(0))
    return refused(
        grown > most + MEASURED_MARGIN, "LimitExceeded", limit="max_memory_bytes", stage="measured", requested=grown, allowed=most
    )


def pixel_gate(width: Column, height: Column, most: int | None = None) -> Column:
    return first_error(
        refused((width < 1) | (height < 1), "InvalidArgument", "empty-raster"),
        over("max_pixels", "pixels", width.cast("bigint") * height.cast("bigint"), most),
    )


#: Fixed value: the most pixels of a flattened page.
MOST_FLATTEN_PIXELS = 89_478_485


def flatten_gate(width: Column, height: Column, most: int | None = None) -> Column:
    pixels = width.cast("bigint") * height.cast("bigint")
    return first_error(pixel_gate(width, height, most), over("max_pixels", "pixels", pixels, MOST_FLATTEN_PIXELS))


def recycle(heaps: Column, max_memory: Column, shift: int, floor: int) -> Column:
    """Is any heap above the smaller of max_memory / 2^shift and the floor?"""
    bound = F.least(F.shiftright(max_memory, shift), F.lit(floor))
    return F.exists(heaps, lambda x: x > bound)


def typed_errors(calls: DataFrame, codes: DataFrame) -> DataFrame:
    """Failed engine calls (..., code) with the kind of their error, from a dimension table (code, kind).

    A code that the table lacks, and a failure that reports success (code 0), are internal errors.
    """
    known = codes.select("code", F.col("kind").alias("_kind"))
    kind = F.when(F.col("code") == 0, "Internal").otherwise(F.coalesce("_kind", F.lit("Internal")))
    return calls.join(known, "code", "left").withColumn("kind", kind).drop("_kind")

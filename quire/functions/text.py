"""Text-level expressions: names, literals, edits, offsets, needles in several spellings, ink grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .outcome import first_error, refused


def numbers_in(text: Column) -> Column:
    """All numbers of a text fragment, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\w.+-])([+-]?(?:\d+\.?\d*|\.\d+))(?![\w.+-])"), F.lit(1))
    return F.transform(found, lambda x: x.try_cast("double"))


def names_in(text: Column) -> Column:
    """The distinct names of a content fragment without strings, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"/([^\s()<>\[\]{}/%]+)"), F.lit(1))))


def plain_name(name: Column) -> Column:
    """A name without its slash and its terminator."""
    return F.regexp_replace(F.regexp_replace(name, r"\x00$", ""), "^/", "")


def slashed_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\x00$", "")


def name_error(canonical: Column) -> Column:
    return first_error(
        refused(~canonical.startswith("/"), "Malformed", "missing-slash"),
        refused(canonical.contains("\x00"), "Malformed", "embedded-nul"),
    )


#: Fixed value: the longest name, as written, that all readers take.
MOST_NAME_WRITTEN = 255


def reads_alike(written: Column, following: Column) -> Column:
    """Would all readers take this name, as written without its slash, for the same one? following: the character after it.

    Escapes have two hex digits of one case and are not 00; white space, delimiters and the bytes 80 and FF end it.
    """
    plain = r"[^#\x00\t\n\f\r ()<>\[\]{}/%\x80\xff]"
    escape = r"#(?!00)(?:[0-9a-f]{2}|[0-9A-F]{2})"
    return written.rlike(rf"\A(?:{plain}|{escape})+\z") & (F.length(written) <= MOST_NAME_WRITTEN) & ~following.eqNullSafe(F.lit("\x0b"))


def encode_literal(text: Column) -> Column:
    pairs = (("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\n", "\\n"), ("\r", "\\r"))
    body = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text)
    return F.concat(F.lit("("), body, F.lit(")"))


def decode_hex(token: Column) -> Column:
    """The bytes of a `<..>` token; an odd last digit counts as followed by 0. Null if it holds other characters."""
    digits = F.regexp_replace(F.regexp_replace(token, "^<|>$", ""), r"[\s\x00]+", "")
    even = F.concat(digits, F.when(F.length(digits) % 2 == 1, "0").otherwise(""))
    return F.when(token.rlike(r"^<[0-9A-Fa-f\s\x00]*>$"), F.unhex(even))


def apply_edits(text: Column, edits: Column) -> Column:
    """Ordered splices (start, end, replacement), offsets of characters from 0 in the original text."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, e: Column) -> Column:
        kept = F.substring(text, s["at"] + 1, e["start"] - s["at"])
        return F.struct(F.concat(s["out"], kept, e["text"]).alias("out"), e["end"].alias("at"))

    return F.aggregate(
        F.array_sort(edits), start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    )


def edits_error(text: Column, edits: Column) -> Column:
    """Why edits cannot be applied: an end before its start, one beyond the text, or two that overlap."""
    ordered = F.array_sort(edits)
    pairs = F.transform(ordered, lambda e, i: F.struct(e["start"].alias("start"), F.when(i > 0, F.get(ordered, i - 1)["end"]).alias("before")))
    return first_error(
        refused(F.exists(edits, lambda e: e["end"] < e["start"]), "Malformed", "edit-backwards"),
        refused(F.exists(edits, lambda e: (e["start"] < 0) | (e["end"] > F.length(text))), "Malformed", "edit-outside"),
        refused(F.exists(pairs, lambda p: p["start"] < p["before"]), "Malformed", "edits-overlap"),
    )


def offsets(parts: DataFrame, key: str, order: str, size: Column, separator: int = 1) -> DataFrame:
    """parts with `start`, the offset of each in the concatenation of its key's parts with a separator between them."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum(size + separator).over(before), F.lit(0)).cast("bigint"))


def located(positions: DataFrame, parts: DataFrame, key: str, order: str, size: Column) -> DataFrame:
    """positions (key, offset) with the part that holds each offset and the offset inside it.

    Both sides are merged and sorted once: each position takes the last part that starts at or before it.
    """
    starts = offsets(parts, key, order, size).select(key, F.col("start").alias("offset"), F.col(order).alias("part"), F.lit(0).alias("_kind"))
    wanted = positions.select(key, "offset", F.lit(None).cast(starts.schema["part"].dataType).alias("part"), F.lit(1).alias("_kind"))
    upto = Window.partitionBy(key).orderBy("offset", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = starts.union(wanted).withColumns(
        {"part": F.last("part", True).over(upto), "_start": F.last(F.when(F.col("_kind") == 0, F.col("offset")), True).over(upto)}
    )
    return both.where("_kind = 1").select(key, "offset", "part", (F.col("offset") - F.col("_start")).alias("local"))


def spliced(parts: DataFrame, edits: DataFrame, key: str, order: str, text: str) -> tuple[DataFrame, DataFrame]:
    """parts with the edits of their key's concatenation applied, each in the part that it belongs to, and rows (key, error).

    parts: rows (key, order, text, ...), joined with one separator; edits: rows (key, ord, start, end, text), offsets of
    characters from 0, in the order of ord. An insertion belongs to the part that holds its place or ends there. A deletion
    may cross parts; a replacement may not. Edits that overlap, run backwards, reach outside or change nothing refuse all of
    their key's, whose parts are not in the result. Only the edited parts' keys meet the edits; a crossing deletion is dealt
    over the parts from its first to its last.
    """
    numbered = parts.withColumns({"_at": F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1, "_size": F.length(text)})
    starts = offsets(numbered.select(key, "_at", "_size"), key, "_at", F.col("_size"))
    whole = starts.groupBy(key).agg(F.max(F.col("start") + F.col("_size")).alias("_whole"))
    inserts = F.col("start") == F.col("end")
    places = edits.select(key, F.explode(F.array("start", F.when(inserts, F.col("end")).otherwise(F.col("end") - 1))).alias("offset")).distinct()
    sizes = starts.select(key, F.col("_at").alias("part"), F.col("_size").alias("_n"))
    places = located(places, starts.drop("start"), key, "_at", F.col("_size")).join(sizes, [key, "part"])
    held = F.struct("part", (F.col("local") < F.col("_n")).alias("inside"), (F.col("local") <= F.col("_n")).alias("at_end"))
    places = places.select(key, "offset", held.alias("_place"))
    first = places.select(key, F.col("offset").alias("start"), F.col("_place").alias("_opens"))
    last = places.select(key, F.col("offset").alias("_last"), F.col("_place").alias("_closes"))
    known = edits.withColumn("_last", F.when(inserts, F.col("end")).otherwise(F.col("end") - 1))
    known = known.join(first, [key, "start"], "left").join(last, [key, "_last"], "left").join(whole, key, "left")
    before = F.max("end").over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    opens, closes, blank = F.coalesce("_opens.inside", F.lit(False)), F.coalesce("_closes.inside", F.lit(False)), F.col("text") == ""
    across = ~opens | ~closes | (F.col("_opens.part") != F.col("_closes.part"))
    error = first_error(
        refused(F.col("end") < F.col("start"), "Malformed", "edit-backwards"),
        refused((F.col("start") < 0) | (F.col("end") > F.coalesce("_whole", F.lit(-1))), "Malformed", "edit-outside"),
        refused(F.col("start") < before, "Malformed", "edits-overlap"),
        refused(F.when(inserts, blank).otherwise(~opens & ~closes), "Malformed", "edit-changes-nothing"),
        refused(inserts & ~F.coalesce("_opens.at_end", F.lit(False)), "Malformed", "edit-outside"),
        refused(~inserts & ~blank & across, "Malformed", "edit-across-parts"),
    )
    judged = known.withColumn("error", error)
    wrong = judged.where("error is not null").groupBy(key).agg(F.min_by("error", "ord").alias("error"))
    over = judged.select(key, "ord", "start", "end", "text", F.explode(F.sequence("_opens.part", "_closes.part")).alias("_at"))
    mine = over.join(starts.withColumnRenamed("start", "_from"), [key, "_at"])
    clipped = (F.greatest(F.col("start") - F.col("_from"), F.lit(0)), F.least(F.col("end") - F.col("_from"), F.col("_size")))
    edit = F.struct(clipped[0].cast("int").alias("start"), F.greatest(*clipped).cast("int").alias("end"), "ord", "text")
    lists = mine.groupBy(key, "_at").agg(F.collect_list(edit).alias("_edits"))
    good = numbered.join(wrong, key, "left_anti").join(lists, [key, "_at"], "left")
    edited = F.when(F.col("_edits").isNull(), F.col(text)).otherwise(apply_edits(F.col(text), F.col("_edits")))
    return good.withColumn(text, edited).select(parts.columns), wrong


def spellings(needle: Column) -> Column:
    """A needle as it may stand in a file: raw, and as hexadecimal UTF-16 in either case."""
    wide = F.hex(F.encode(needle, "UTF-16BE"))
    return F.array(needle, wide, F.lower(wide))


def holds(text: Column, needle: Column) -> Column:
    return F.exists(spellings(needle), lambda s: text.contains(s))


def canary_hits(docs: DataFrame, needles: DataFrame, key: str, block_bytes: int = 4 << 20) -> DataFrame:
    """Rows (key, found): in how many texts each needle stands, in any spelling.

    Needles are broadcast in blocks of bounded size: one block for a usual list, one scan of the texts per block for
    a longer one.
    """
    size = needles.agg(F.coalesce(F.sum(F.octet_length("needle")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // block_bytes))
    hits = None
    for k in range(blocks):
        block = needles if blocks == 1 else needles.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)
        found = docs.select("text").join(F.broadcast(block), holds(F.col("text"), F.col("needle"))).groupBy(key).agg(F.count("*").alias("found"))
        hits = found if hits is None else hits.union(found)
    return needles.join(hits, key, "left").select(key, F.coalesce("found", F.lit(0)).alias("found"))


def ink_level(mean: Column) -> Column:
    """A mean of colour values as one of four levels of ink."""
    return F.when(mean <= 63, 3).when(mean <= 127, 2).when(mean <= 191, 1).otherwise(0)


def ink_grid(pixels: DataFrame, width: Column, height: Column, cells: int = 4) -> DataFrame:
    """Rows (image, cell, level) from pixels (image, x, y, r, g, b): means by floor division over a square grid."""
    cell = F.floor(F.col("y") * cells / height) * cells + F.floor(F.col("x") * cells / width)
    sums = pixels.groupBy("image", cell.cast("int").alias("cell")).agg(
        F.sum(F.col("r") + F.col("g") + F.col("b")).alias("total"), F.count("*").alias("n")
    )
    return sums.select("image", "cell", ink_level(F.floor(F.col("total") / (3 * F.col("n")))).alias("level"))

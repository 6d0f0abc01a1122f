"""Line dedup by a deletion-neighbourhood join.

Lines are compared as words (runs of anything but ASCII white space, A-Z lower-cased). Two lines are the same if their
words are equal, or, if the shorter has at least `least_words` words, at most one word apart (one inserted, deleted or
replaced). A line goes if an earlier one (by doc_id, then line number) is the same; a blank line stays.

1. Lines of equal words become one, kept at its earliest place (a partially aggregated minimum).
2. A pair one word apart agrees in its first or its last half, so lines that share neither half with another line
   have no partner; the deletion neighbourhoods are emitted for the others only. This filter loses no pair. Filters like
   this one are bit maps of a fixed size (`common.filtered`), so only rows that may matter are shuffled.
3. Each line emits itself and its n variants of one deleted word as hashed keys (variant, position). Lines that share
   variant and position differ in one replaced word; a line that equals a variant lacks one word. So a minimum per
   (variant, position), per variant and of the whole lines names each line's earliest partner, without listing pairs,
   however many lines share a variant.
4. Each named partner is verified by the edit distance of the two lines' words before the later line goes.
5. Documents are rebuilt from their other lines.

Rows: null and empty texts have no lines to lose and stay as they are. A document is a doc_id with a text (`part`, a hash
of the text): rows that share a doc_id, or have none, and hold different texts are documents each, in the order of their
hashes. Rows that agree in both are one document: their equal line numbers are the same place, so repeated rows stay. A
null doc_id comes before all others. Other columns pass through; ones named n_lines or n_removed are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filtered, parted, set_apart, stored, table
from .words import WordHash, mixed, shingle_words

NO_ID = -(2**63)
PLACE = ["doc_id", "part", "line"]


def half_keys(words: list[bytes]) -> list[int]:
    """Hashes of a line's first and last halves, as long as those of a partner of as many words, one more or one less."""
    n, out = len(words), set()
    for size in {n // 2, (n - 1) // 2}:
        if size:
            out.add(xxhash.xxh64_intdigest(b" ".join(words[:size]), 2 * size))
            out.add(xxhash.xxh64_intdigest(b" ".join(words[n - size :]), 2 * size + 1))
    return [k - 2**64 if k >= 2**63 else k for k in out]


def variants(h: np.ndarray) -> np.ndarray:
    """The hash of the whole line, then of the line without its i-th word for each i."""
    n = len(h)
    base = pow(0x9E3779B97F4A7C15, -1, 2**64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(base))])  # base^i
        term = h * powers[:-1]
        before = np.r_[np.uint64(0), np.cumsum(term, dtype=np.uint64)]
        # after the deleted word every power is one lower
        after = (before[-1] - before[1:]) * np.uint64(0x9E3779B97F4A7C15)
        out = np.r_[before[-1], before[:-1] + after]
        return mixed(out ^ np.r_[np.uint64(n), np.full(n, np.uint64(n - 1))] * np.uint64(0xC2B2AE3D27D4EB4F))


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Is the word edit distance at most one?"""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return p == len(a) or a[p + (len(a) == len(b)) :] == b[p + 1 :]


def _lines(least_words: int):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, parts, numbers, digests, keys = [], [], [], [], []
            for doc, own, x in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("text"), strict=True):
                for k, line in enumerate(x.as_buffer().to_pybytes().split(b"\n") if x.is_valid else ()):
                    if words := shingle_words(line):
                        docs.append(doc), parts.append(own), numbers.append(k)
                        digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                        keys.append(half_keys(words) if len(words) >= least_words else [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(parts, pa.int64()), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "part", "line", "digest", "halves"],
            )

    return part


def _neighbourhoods(least_words: int):
    """From documents with the numbers of their wanted lines: (doc_id, part, line, words, variant hashes) of those lines."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for batch in batches:
            docs, parts, numbers, joined, keys = [], [], [], [], []
            columns = (batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist())
            for doc, own, x, wanted in zip(*columns, strict=True):
                lines = x.as_buffer().to_pybytes().split(b"\n")
                for k in wanted:
                    words = shingle_words(lines[k]) if k < len(lines) else []
                    if len(words) >= least_words:
                        docs.append(doc), parts.append(own), numbers.append(k)
                        joined.append(b" ".join(words))
                        keys.append(variants(seen.of(words)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(parts, pa.int64()), pa.array(numbers, pa.int32()), pa.array(joined, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "part", "line", "words", "variants"],
            )

    return part


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [within_one(a.split(), b.split()) for a, b in zip(batch.column("words").to_pylist(), batch.column("other").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(same)) for c in PLACE], PLACE)


def duplicate_lines(docs: DataFrame, least_words: int = 8) -> DataFrame:
    """Rows (doc_id, part, lines): the numbers, from 0, of each document's lines that an earlier line makes superfluous."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("part"), "text")
    lines = stored(docs.mapInArrow(_lines(least_words), "doc_id long, part long, line int, digest binary, halves array<long>"))
    place = F.struct(*PLACE)
    equal = lines.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    equal = stored(equal.select("digest", "first"))

    halves = lines.select(*PLACE, "digest", F.explode("halves").alias("half"))
    one = F.xxhash64("digest")
    shared = halves.groupBy("half").agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low < high").select("half")
    live = filtered(halves, "half", shared).groupBy("digest").agg(F.min(place).alias("first"))
    live = stored(live.select("digest", "first.*"))

    wanted = live.groupBy("doc_id", "part").agg(F.collect_set("line").alias("wanted"))
    texts = filtered(docs.where("text is not null"), "doc_id", live.select("doc_id")).join(wanted, ["doc_id", "part"])
    around = texts.mapInArrow(_neighbourhoods(least_words), "doc_id long, part long, line int, words binary, variants array<long>")
    around = stored(around.dropDuplicates(PLACE))

    keys = around.select(*PLACE, F.posexplode("variants").alias("at", "variant"))
    several = keys.groupBy("variant").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("variant")
    keys = stored(filtered(keys, "variant", several))
    keys = keys.select(place.alias("own"), "at", "variant")
    whole, cut = keys.where("at = 0"), keys.where("at > 0")
    # the minima are stored: both sides of each join are then plain shuffles, and a template that very many lines fill is a
    # skew that adaptive execution splits
    least = stored(keys.groupBy("variant", "at").agg(F.min("own").alias("by")))
    replaced = cut.join(least.where("at > 0"), ["variant", "at"]).select("own", "by")
    shorter = cut.join(least.where("at = 0").select("variant", "by"), "variant").select("own", "by")
    by_variant = stored(least.where("at > 0").groupBy("variant").agg(F.min("by").alias("by")))
    longer = whole.join(by_variant, "variant").select("own", "by")
    # at most two partners a variant, each the earliest of its kind
    pairs = replaced.union(shorter).union(longer).where("by < own").distinct()
    pairs = pairs.select("own.*", F.col("by.doc_id").alias("d"), F.col("by.part").alias("p"), F.col("by.line").alias("l"))
    words = around.select(*PLACE, "words")
    others = words.select(F.col("doc_id").alias("d"), F.col("part").alias("p"), F.col("line").alias("l"), F.col("words").alias("other"))
    near = pairs.join(words, PLACE).join(others, ["d", "p", "l"]).select(*PLACE, "words", "other")
    near = near.mapInArrow(_verified, "doc_id long, part long, line int").distinct().join(live, PLACE).select("digest", F.lit(True).alias("near"))

    told = stored(equal.join(near, "digest", "full_outer"))
    gone = filtered(lines, "digest", told).join(told, "digest").where((F.col("first") < place) | F.col("near"))
    return gone.groupBy("doc_id", "part").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, least_words: int = 8) -> DataFrame:
    """docs without their superfluous lines, with n_lines and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    gone = stored(duplicate_lines(docs, least_words)).withColumnsRenamed({"doc_id": "_key", "part": "_part", "lines": "_gone"})
    docs, back = set_apart(docs, "doc_id", "text")
    keyed = docs.withColumns({"_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_part": F.xxhash64("text")})
    hit, rest = parted(keyed, "_key", gone.select("_key"))
    hit = hit.join(gone, ["_key", "_part"], "left")
    rest = rest.withColumn("_gone", F.lit(None).cast("array<int>"))
    both = hit.drop("_key", "_part").unionByName(rest.drop("_key", "_part"))  # documents that lose nothing stay where they are
    fields = docs.schema.fields
    both = both.select(*(F.col(f"`{c}`") for c in docs.columns), "_gone")
    more = [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, g = batch.schema.get_field_index("text"), batch.schema.get_field_index("_gone")
            texts, counts, removed = [], [], []
            for text, gone in zip(batch.column(k).to_pylist(), batch.column(g).to_pylist(), strict=True):
                lines = text.split("\n") if text else []
                drop = set(gone or ())
                kept = [x for i, x in enumerate(lines) if i not in drop]
                texts.append("\n".join(kept) if len(kept) < len(lines) else text)
                counts.append(len(lines)), removed.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.string()) if i == k else batch.column(i) for i in range(batch.num_columns) if i != g]
            names = [n for n in batch.schema.names if n != "_gone"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_lines", "n_removed"]
            )

    return back(both.mapInArrow(part, T.StructType([*fields, *more])), "n_lines", "n_removed")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))

#: The rows by SQL. Partners agree in the first or the last half of their words.
OP2_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(doc_id, -9223372036854775808) AS id, doc_id, text, CASE WHEN text IS NULL OR text = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
line AS (SELECT r, id, k, lines[k] AS raw FROM (SELECT r, id, lines, unnest(range(1, len(lines) + 1)) AS k FROM doc) z),
worded AS (
  SELECT r, id, k, raw,
    regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM line),
own AS (SELECT w, len(w) AS n, min((id, k)) AS p FROM worded WHERE len(w) > 0 GROUP BY w),
half AS (
  SELECT *, n // 2 AS size, 'first' AS side, w[1 : n // 2] AS part FROM own WHERE n >= 8
  UNION ALL SELECT *, n - n // 2, 'last', w[n // 2 + 1 : n] FROM own WHERE n >= 8),
shifted AS (
  SELECT *, (n - 1) // 2 AS size, 'first' AS side, w[1 : (n - 1) // 2] AS part FROM own WHERE n >= 9
  UNION ALL SELECT *, n - 1 - (n - 1) // 2, 'last', w[(n - 1) // 2 + 2 : n] FROM own WHERE n >= 9),
pair AS (
  SELECT a.p, a.w, a.n, b.p AS q, b.w AS v, true AS replaced FROM half a JOIN half b ON a.n = b.n AND a.side = b.side AND a.part = b.part AND b.p < a.p
  UNION SELECT a.p, a.w, a.n, b.p, b.w, false FROM half a JOIN shifted b ON b.n = a.n + 1 AND a.side = b.side AND a.part = b.part),
measured AS (SELECT *, coalesce(list_position(list_transform(list_zip(w, v[1 : n]), lambda x: x[1] = x[2]), false), n + 1) AS spot FROM pair),
near AS (
  SELECT DISTINCT greatest(p, q) AS p FROM measured
  WHERE CASE WHEN replaced THEN w[spot + 1 : n] = v[spot + 1 : n] ELSE w[spot : n] = v[spot + 1 : n + 1] END),
told AS (
  SELECT x.r, x.k, x.raw, len(x.w) > 0 AND ((x.id, x.k) > own.p OR near.p IS NOT NULL) AS gone
  FROM worded x LEFT JOIN own ON own.w = x.w LEFT JOIN near ON near.p = own.p),
kept AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(raw, chr(10) ORDER BY k) FILTER (NOT coalesce(gone, false)) AS text FROM told GROUP BY r)
SELECT doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN doc.text ELSE coalesce(kept.text, '') END AS text,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM doc LEFT JOIN kept USING (r)
"""

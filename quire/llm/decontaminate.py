"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of digits, letters and non-ASCII characters with A-Z lower-cased. A window is `width` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. Executors hold the set of window
hashes; each document's windows of the same lengths are looked up at once, each hit is verified word by word, and
every word inside an occurrence counts as hit. Documents are scanned where they lie, without a shuffle.

The set is flat arrays: the windows' hashes, sorted, with the item and the place of each in one byte string of all words,
about 30 bytes a word. It is built and broadcast for at most `block_bytes` of benchmark text at a time. A larger benchmark
is cut into blocks; each block is one more narrow pass that extends the spans and items found so far. An item longer than
`piece_bytes` goes as pieces that overlap by all words of a window but one.

Rows: a null or empty text has no words and is clean. A null item text has no window. A null item_id is the empty
string. Items that share an item_id are one item. Columns besides the named ones are passed through untouched.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import set_apart, stored, table
from .words import WordHash, benchmark_words, window_hashes

#: Fixed value: a document is contaminated if 20 * n_hit >= n_words and n_hit > 0.
SHARE = 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Windows(NamedTuple):
    """Windows of one length, by hash: the item's number, and the first and last byte + 1 in the words of all items."""

    hashes: np.ndarray
    item: np.ndarray
    first: np.ndarray
    last: np.ndarray


class Known(NamedTuple):
    by_length: dict[int, Windows]
    words: bytes
    items: list[str]


def windows_of(items: list[tuple[str, str | None]], width: int) -> Known:
    """The windows of some items."""
    seen, joined, at = WordHash(100_000), [], 0
    names = sorted({item for item, _ in items})
    number = {item: k for k, item in enumerate(names)}
    found: dict[int, list[tuple]] = defaultdict(list)
    for item, text in items:
        words = benchmark_words((text or "").encode())
        n = min(width, len(words))
        if not n:
            continue
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = at + np.cumsum(sizes + 1) - sizes - 1
        joined.append(b" ".join(words) + b" ")
        at += len(joined[-1])
        own = window_hashes(seen.of(words), n)
        m = len(own)
        found[n].append((own, np.full(m, number[item], np.uint32), first[:m].astype(np.uint32), (first + sizes)[n - 1 :].astype(np.uint32)))
    by_length = {}
    for n in list(found):
        whole = [np.concatenate(x) for x in zip(*found.pop(n), strict=True)]
        order = np.argsort(whole[0], kind="stable")
        by_length[n] = Windows(*(x[order] for x in whole))
    return Known(by_length, b"".join(joined), names)


def scan(known: Known, words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, set[str]]:
    """Which words lie in an occurrence of a window, and whose windows occur."""
    depth, items = np.zeros(len(words) + 1, np.int64), set()
    for n, windows in known.by_length.items():
        own = window_hashes(hashes, n)
        at = np.searchsorted(windows.hashes, own)
        at[at == len(windows.hashes)] = 0
        for i in np.flatnonzero(windows.hashes[at] == own).tolist():
            text, hit = b" ".join(words[i : i + n]), False
            for k in range(int(at[i]), int(np.searchsorted(windows.hashes, own[i], "right"))):
                if known.words[windows.first[k] : windows.last[k]] == text:
                    hit = True
                    items.add(known.items[windows.item[k]])
            if hit:
                depth[i] += 1
                depth[i + n] -= 1
    return np.cumsum(depth[:-1]) > 0, items


def _pieces(width: int, piece_bytes: int):
    """Items as (item, text, size); a long one as overlapping pieces of whole words."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text is None:
                    continue
                if len(text) <= piece_bytes // 4:  # a code point has four bytes at most
                    names.append(name), texts.append(text)
                    continue
                words = benchmark_words(text.encode())
                begin = 0
                while begin < len(words):
                    end, size = begin, 0
                    while end < len(words) and (end - begin < 2 * width or size + len(words[end]) < piece_bytes):
                        size += len(words[end]) + 1
                        end += 1
                    names.append(name), texts.append(b" ".join(words[begin:end]).decode())
                    begin = end if end == len(words) else end - width + 1
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["item", "text", "size"])

    return part


def _spans(hit: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return edge.reshape(-1, 2).tolist()


FACTS = ["n_words", "spans", "items"]


def _scanned(docs: DataFrame, windows, text_col: str) -> DataFrame:
    """docs with n_words, spans (first word, end) of hit words, and the items whose windows occur.

    If docs has these columns from another block of the benchmark, they are extended.
    """
    again = all(f in docs.columns for f in FACTS)
    kept = [c for c in docs.columns if c not in FACTS]
    spans_type = pa.list_(pa.list_(pa.int32()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = windows.value, WordHash()
        for batch in batches:
            counts, spans, items = [], [], []
            before = zip(*(batch.column(f).to_pylist() for f in FACTS[1:]), strict=True) if again else None
            for x in batch.column(text_col):
                words = benchmark_words(x.as_buffer().to_pybytes()) if x.is_valid else []
                hit, who = scan(known, words, seen.of(words))
                if before is not None:
                    old_spans, old_items = next(before)
                    who.update(old_items)
                    for a, b in old_spans:
                        hit[a:b] = True
                counts.append(len(words)), spans.append(_spans(hit)), items.append(sorted(who))
            facts = [pa.array(counts, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *facts], [*kept, *FACTS])

    fields = [docs.schema[c] for c in kept]
    kinds = (T.LongType(), T.ArrayType(T.ArrayType(T.IntegerType())), T.ArrayType(T.StringType()))
    return docs.select(*kept, *(FACTS if again else ())).mapInArrow(
        part, T.StructType([*fields, *(T.StructField(f, k) for f, k in zip(FACTS, kinds, strict=True))])
    )


def find_hits(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, text_col: str = "text", block_bytes: int = 8 << 20, piece_bytes: int = 1 << 20
) -> DataFrame:
    """docs with n_words, n_hit, n_items, spans, items and contaminated, one row per row of docs, where it lies."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    items = stored(items.mapInArrow(_pieces(width, min(piece_bytes, block_bytes)), "item string, text string, size long"))
    total = items.agg(F.sum("size")).first()[0] or 0
    blocks = -(-2 * total // block_bytes) or 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    docs = docs.drop(*FACTS, "n_hit", "n_items", "contaminated")
    for k in range(blocks):  # one block unless the benchmark is very large
        rows = [(r[0], r[1]) for r in items.where(part == k).select("item", "text").collect()]
        docs = _scanned(docs, spark.sparkContext.broadcast(windows_of(rows, width)), text_col)
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])")
    return docs.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(SHARE) * F.col("n_hit") >= F.col("n_words"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, spans, items, contaminated), one per row of docs."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_hits(picked, benchmark, **options)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "spans", "items", "contaminated")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text is contaminated. No shuffle; columns named like a fact keep their own values."""
    docs, back = set_apart(docs, "text")
    return back(find_hits(docs, benchmark, **options).where("not contaminated"))


def without_spans(text: str, spans: list[list[int]]) -> str:
    """text without the words of the spans (as contamination() returns them) and what stands between those words."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw)]
    out, end = [], 0
    for a, b in spans:
        out.append(raw[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, raw[end:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs with every hit span cut out of its text; documents without a hit stay as they are."""
    docs, back = set_apart(docs, "text")
    found = find_hits(docs, benchmark, **options).select(*(F.col(f"`{c}`") for c in docs.columns), "spans")
    own = docs.columns

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                without_spans(t, x) if x and t else t
                for t, x in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)
            ]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in own]
            yield pa.RecordBatch.from_arrays(columns, own)

    return back(found.mapInArrow(part, docs.schema))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


OP8_SQL = r"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized) z),
lengths AS (SELECT DISTINCT n FROM win),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
spot AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n),
hit AS (
  SELECT s.r, s.i, s.n, win.item
  FROM spot s JOIN win ON win.n = s.n AND win.win = array_to_string(s.w[s.i : s.i + s.n - 1], ' ')),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) x GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hit) y GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

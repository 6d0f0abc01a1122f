"""Sources of document files, and what can be read from their bytes without decoding them.

Files come as rows (path, content); operators here run in Arrow batches next to the data. Decoding, writing and drawing
documents is out of reach of this library. Bytes that cannot be read give an error row, never a failed job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import syntax as s
from ..functions.outcome import MOST, open_gate

#: Fixed values of the pre-scan: bytes of the tail and of a section's head that are searched, and the most sections of a
#: chain, subsections of a table, numbers of an /Index and lengths that are read.
TAIL, HEAD, MOST_SECTIONS, MOST_SUBSECTIONS, MOST_RANGES, MOST_LENGTHS = 1 << 16, 1 << 16, 32, 1024, 256, 1 << 20
LENGTH = re.compile(rb"/Length[ \t\n\x0c\r]+(\d+)(?![ \t\n\x0c\r]+\d+[ \t\n\x0c\r]+R\b)(?!\d)")
START = re.compile(rb"startxref[ \t\n\x0c\r]*(\d+)")
TABLE = re.compile(rb"[ \t\n\x0c\r]*xref(?=[ \t\n\x0c\r<\[]|\Z)")
SUBSECTION = re.compile(rb"[ \t\n\x0c\r]*\d+[ \t\n\x0c\r]+(\d+)[ \t\n\x0c\r]*")
SIZE, PREVIOUS = (re.compile(rb"/" + key + rb"(?=[ \t\n\x0c\r\[\]<>()/%{}])[ \t\n\x0c\r]*(\d+)") for key in (b"Size", b"Prev"))
INDEX = re.compile(rb"/Index[ \t\n\x0c\r]*\[((?:[ \t\n\x0c\r]*\d+)+)")
ENTRY_BYTES, ENTRIES_AT_ONCE = 20, 1 << 16
PROFILE = "xref_entries long, largest_stream long, xref_sections int, entry_past_end boolean, entries_judged long"


def read_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Rows (doc_id, path, n_bytes, sha256, content) of a folder's files; doc_id is a hash of the path."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select(
        F.xxhash64("path").alias("doc_id"), "path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), "content"
    )


def content_rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows (*columns, content as bytes or None)."""
    for batch in batches:
        others = (batch.column(c).to_pylist() for c in columns)
        for *held, x in zip(*others, batch.column("content"), strict=True):
            yield *held, x.as_buffer().to_pybytes() if x.is_valid else None


def batched(groups: Iterable[Iterable[tuple]], fields: dict[str, pa.DataType], most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The groups' rows in batches of `most` rows."""
    rows = chain.from_iterable(groups)
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*held, strict=True), fields.values(), strict=True)], list(fields))


def _number(digits: bytes) -> int:
    """Digits as a number that stays at the largest BIGINT."""
    return int(digits) if len(digits.lstrip(b"0")) <= 18 else MOST


def _largest(pattern: re.Pattern, raw: bytes, most: int | None = None) -> int | None:
    return max((_number(m[1]) for m in islice(pattern.finditer(raw), most)), default=None)


def largest_length(raw: bytes) -> int:
    """The largest stream length that is declared directly, of at most MOST_LENGTHS."""
    return _largest(LENGTH, raw, MOST_LENGTHS) or 0


def _judged(raw: bytes, first: int, count: int, seen: np.ndarray) -> tuple[int, bool]:
    """How many entries of a subsection were read, and whether one in use lies past the end of the file.

    Entries that begin in bytes read before are passed over; the first one that is not laid out as specified is the last read.
    """
    read, past = 0, False
    count = min(count, (len(raw) - first) // ENTRY_BYTES)
    for k in range(0, count, ENTRIES_AT_ONCE):
        n, at = min(ENTRIES_AT_ONCE, count - k), first + k * ENTRY_BYTES
        rows = np.frombuffer(raw, np.uint8, n * ENTRY_BYTES, at).reshape(n, ENTRY_BYTES)
        spans = seen[at : at + n * ENTRY_BYTES].reshape(n, ENTRY_BYTES)
        digits = (rows[:, :16] - ord("0") < 10) | (np.arange(16) == 10)
        used, ends = rows[:, 17] == ord("n"), rows[:, 18].astype(np.uint16) << 8 | rows[:, 19]
        good = digits.all(1) & (rows[:, 10] == 32) & (rows[:, 16] == 32) & (used | (rows[:, 17] == ord("f"))) & np.isin(ends, (0x200A, 0x200D, 0x0D0A))
        fresh = ~spans[:, 0]
        bad = np.flatnonzero(fresh & ~good)
        fresh[bad[0] if len(bad) else n :] = False
        offsets = (rows[fresh & used, :10].astype(np.int64) - ord("0")) @ 10 ** np.arange(9, -1, -1)
        past |= bool((offsets >= len(raw)).any())
        spans[fresh] = True
        read += int(fresh.sum()) + (len(bad) > 0)
        if len(bad):
            break
    return read, past


def profile(raw: bytes) -> tuple[int, int, int, bool, int]:
    """What a file declares about itself: the PROFILE columns.

    A section is a table, or a stream that declares its /Index or /Size; xref_entries is the largest section's number,
    since one merged table comes of them. If the chain declares none, the largest /Size of the whole file counts. Each byte of
    a table's entries is judged once, however many sections overlap.
    """
    entries, judged, past, seen = 0, 0, False, None
    visited: set[int] = set()
    tail = raw[-TAIL:]
    at = tail.rfind(b"startxref")
    m = START.match(tail, at) if at >= 0 else None
    offset = _number(m[1]) if m else None
    while offset is not None and offset not in visited and offset < len(raw) and len(visited) < MOST_SECTIONS:
        visited.add(offset)
        head = raw[offset : offset + HEAD]
        if table := TABLE.match(raw, offset):
            here, at = 0, table.end()
            seen = np.zeros(len(raw), bool) if seen is None else seen
            for _ in range(MOST_SUBSECTIONS):
                if at >= len(raw) or not (sub := SUBSECTION.match(raw, at)):
                    break
                count = _number(sub[1])
                read, beyond = _judged(raw, sub.end(), count, seen)
                here, judged, past = min(here + count, MOST), judged + read, past or beyond
                at = sub.end() + count * ENTRY_BYTES
        elif ranges := INDEX.search(head):
            here = min(sum(map(_number, ranges[1].split()[1:MOST_RANGES:2])), MOST)
        else:
            here = _largest(SIZE, head) or 0
        entries = max(entries, here)
        offset = _largest(PREVIOUS, head)
    return entries or _largest(SIZE, raw) or 0, largest_length(raw), len(visited), past, judged


def prescanned(documents: DataFrame, limits: dict | None = None) -> DataFrame:
    """documents with the PROFILE columns and `error`, the first check before an open that refuses."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [profile(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column("content")]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))],
                ["doc_id", "n_bytes", "xref_entries", "largest_stream", "xref_sections", "entry_past_end", "entries_judged"],
            )

    found = documents.select("doc_id", "n_bytes", "content").mapInArrow(part, f"doc_id long, n_bytes long, {PROFILE}")
    gate = open_gate(F.col("n_bytes"), F.col("xref_entries"), F.col("largest_stream"), F.col("entry_past_end"), limits)
    return found.withColumn("error", gate)


OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b")
REFERENCE = re.compile(rb"(?<![\d.])(\d{1,10})\s+(\d{1,5})\s+R(?![A-Za-z0-9])")


def _one_value(raw: bytes, at: int = 0) -> Iterator[tuple[int, int]]:
    """The references (num, gen) in the first value from a place on."""
    depth, held = 0, []
    for t in s.tokens(raw, at=at):
        if t.kind == "number":
            held = [*held[-1:], t.value]
            continue
        if t.kind == "keyword" and t.value == b"R" and len(held) == 2 and all(map(bytes.isdigit, held)):
            yield int(held[0]), int(held[1])
        elif not depth and held:
            return  # the value was a number
        held = []
        depth += {"dict_open": 1, "array_open": 1, "dict_close": -1, "array_close": -1}.get(t.kind, 0)
        if depth <= 0:
            return


def _held_by(src: tuple[int, int], raw: bytes, at: int = 0) -> list[tuple]:
    """Reference rows of the value of an object, the last one with the rule if it cannot be read."""
    out = []
    try:
        for num, gen in _one_value(raw, at):
            out.append((*src, num, gen, "reference"))
    except s.SyntaxRefusal as refusal:
        out.append((*src, None, None, f"refused:{refusal.rule}"))
    return out


def references(raw: bytes) -> list[tuple]:
    """Rows (src, src_gen, num, gen, kind): every object and what it refers to; kind `object`, `null` or `reference`.

    A declaration is a row without num. Strings, comments and stream data hold no references.
    """
    out, at = [], 0
    while m := OBJECT.search(raw, at):
        end = raw.find(b"endobj", m.end())
        body = raw[m.end() : end if end >= 0 else len(raw)]
        stream = re.search(rb"\bstream\r?\n", body)
        value = body[: stream.start()] if stream else body
        src = (int(m[1]), int(m[2]))
        out.append((*src, None, None, "null" if value.split() == [b"null"] else "object"))
        out += _held_by(src, value)
        at = m.end() + len(body)
    return out


def value_references(raw: bytes) -> list[tuple[int, int]]:
    """The references (num, gen) of one value, in order."""
    return list(_one_value(raw))


def member_references(raw: bytes, count: int, first: int) -> list[tuple]:
    """The rows of `references` for the members of a decoded object stream, from its header's pairs of number and offset."""
    header = islice(s.tokens(raw[: max(first, 0)]), 2 * max(count, 0))
    try:
        numbers = [int(t.value) if t.kind == "number" and t.value.isdigit() else None for t in header]
    except s.SyntaxRefusal:
        numbers = []
    if count < 0 or len(numbers) < 2 * count or None in numbers or any(first + x >= len(raw) for x in numbers[1::2]):
        return [(None, None, None, None, "refused:object-stream-header")]
    out = []
    for num, offset in zip(numbers[::2], numbers[1::2], strict=True):
        null = re.compile(rb"\s*null(?![^\s/<>\[\](){}%])").match(raw, first + offset)
        out.append((num, 0, None, None, "null" if null else "object"))
        out += _held_by((num, 0), raw, first + offset)
    return out


REFERENCES = "src long, src_gen long, num long, gen long, kind string"


def _reference_rows(frame: DataFrame, read: Callable[..., list[tuple]], *arguments: str) -> DataFrame:
    """The rows that `read` finds in (content, *arguments), next to doc_id; none where one of them is null."""

    fields = dict.fromkeys(("doc_id", "src", "src_gen", "num", "gen"), pa.int64()) | {"kind": pa.string()}

    def found(row: tuple) -> list[tuple]:
        doc, *given, raw = row
        return [] if raw is None or None in given else [(doc, *x) for x in read(raw, *given)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(map(found, content_rows(batches, "doc_id", *arguments)), fields)

    return frame.select("doc_id", "content", *arguments).mapInArrow(part, f"doc_id long, {REFERENCES}")


def reference_rows(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, src, src_gen, num, gen, kind) of every document."""
    return _reference_rows(documents, references)


def member_rows(streams: DataFrame) -> DataFrame:
    """The same rows of decoded object streams (doc_id, content, count, first); src_gen is 0."""
    return _reference_rows(streams, member_references, "count", "first")


def operation_rows(streams: DataFrame, strict: bool = False) -> DataFrame:
    """streams (doc_id, stream_id, content) -> operations with byte spans; a refused stream gives one row with its rule."""
    schema = "doc_id long, stream_id long, op_ord long, operator string, operands array<string>, first long, last long, rule string"
    fields = dict.fromkeys(("doc_id", "stream_id", "op_ord"), pa.int64()) | {"operator": pa.string(), "operands": pa.list_(pa.string())}
    fields |= {"first": pa.int64(), "last": pa.int64(), "rule": pa.string()}

    def found(row: tuple) -> list[tuple]:
        doc, stream, raw = row
        try:
            read = enumerate(s.operations(raw or b"", strict))
            return [(doc, stream, k, op.operator.decode("latin-1"), [t.value.decode("latin-1") for t in op.operands], op.start, op.end, None) for k, op in read]
        except s.SyntaxRefusal as refusal:
            return [(doc, stream, *(None,) * 5, refusal.rule)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(map(found, content_rows(batches, "doc_id", "stream_id")), fields)

    return streams.select("doc_id", "stream_id", "content").mapInArrow(part, schema)


#: What a manifest entry of each kind must state.
MANIFEST = {"fetched": ("url", "sha256", "licence"), "generated": ("generator", "sha256"), "committed": ("path", "sha256")}


def manifest_problems(entries: DataFrame) -> DataFrame:
    """Rows (name, problem) of manifest entries (name, kind, url, sha256, licence, generator, path) that lack something."""
    missing = F.array_compact(
        F.array(
            F.when(~F.col("kind").isin(*MANIFEST) | F.col("kind").isNull(), F.lit("kind")),
            *(
                F.when((F.col("kind") == kind) & (F.coalesce(F.trim(F.col(c)), F.lit("")) == ""), F.lit(c))
                for kind, columns in MANIFEST.items()
                for c in columns
            ),
        )
    )
    return entries.select("name", F.explode(missing).alias("problem"))


def write_parts(split_pages: DataFrame, folder: str) -> None:
    """Each document's parts into folders of their own, doc_id=.../part=..., for delivery one by one."""
    split_pages.repartition("doc_id", "part").write.mode("error").partitionBy("doc_id", "part").parquet(folder)


def glyph_rows(streams: DataFrame, fonts: dict, forms: dict | None = None) -> DataFrame:
    """streams (doc_id, page_no, content) -> rows of glyphs and inks, as functions.content.walk places them.

    fonts and forms are the page resources that the caller has resolved; a refused stream gives one row with its rule.
    """
    from ..functions.content import Glyph, walk

    schema = "doc_id long, page_no long, kind string, glyph_ord long, left double, bottom double, right double, top double, x double, y double, font string, code long, op_ord long, rule string"
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    fields = {name: kinds[kind] for name, kind in map(str.split, schema.split(", "))}

    def found(row: tuple) -> Iterator[tuple]:
        doc, page, raw = row
        try:
            for k, g in enumerate(walk(raw or b"", fonts, forms)):
                box = g.box or (None,) * 4
                if isinstance(g, Glyph):
                    yield (doc, page, "glyph", k, *box, g.x, g.y, g.font, g.code, g.op_ord, None)
                else:
                    yield (doc, page, "ink", k, *box, None, None, None, None, g.op_ord, None)
        except s.SyntaxRefusal as refusal:
            yield (doc, page, "refused", None, *(None,) * 9, refusal.rule)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(map(found, content_rows(batches, "doc_id", "page_no")), fields)

    return streams.select("doc_id", "page_no", "content").mapInArrow(part, schema)

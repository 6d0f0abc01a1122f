"""What the byte parsers read, as rows next to the key of their input: (doc_id, content) -> rows with `rule` for a refused one.

Null contents give no rows; other columns are not read. Every reader is one narrow pass of Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import syntax as s
from .documents import batched, content_rows


def _rows(frame: DataFrame, read: Callable[[bytes], Iterable[tuple]], fields: dict[str, pa.DataType], ddl: str) -> DataFrame:
    def found(row: tuple) -> list[tuple]:
        doc, raw = row
        try:
            return [(doc, *x, None) for x in read(raw)] if raw is not None else []
        except s.SyntaxRefusal as refusal:
            return [(doc, *(None,) * len(fields), refusal.rule)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(map(found, content_rows(batches, "doc_id")), {"doc_id": pa.int64(), **fields, "rule": pa.string()})

    return frame.select("doc_id", "content").mapInArrow(part, f"doc_id long, {ddl}, rule string")


def dictionary_keys(frame: DataFrame) -> DataFrame:
    """Rows (doc_id, at, key, rule): the keys of a dictionary's own entries, in order."""
    return _rows(frame, lambda raw: ((k, x.decode("latin-1")) for k, x in enumerate(s.top_keys(raw))), {"at": pa.int64(), "key": pa.string()}, "at long, key string")


def decoded_strings(frame: DataFrame) -> DataFrame:
    """Rows (doc_id, decoded, rule): the bytes that a string token stands for."""
    return _rows(frame, lambda raw: [(s.decode_string(raw),)], {"decoded": pa.binary()}, "decoded binary")


def numbers(frame: DataFrame) -> DataFrame:
    """Rows (doc_id, at, number, rule): the numbers of a fragment, in order, but not those inside strings and comments."""
    return _rows(frame, lambda raw: enumerate(s.numbers_in(raw)), {"at": pa.int64(), "number": pa.float64()}, "at long, number double")


def names(frame: DataFrame) -> DataFrame:
    """Rows (doc_id, name, whole, rule): the distinct names of a stream, and whether it was read to its end."""

    def read(raw: bytes) -> Iterator[tuple]:
        found, whole = s.names_in(raw)
        return ((x.decode("latin-1"), whole) for x in found)

    return _rows(frame, read, {"name": pa.string(), "whole": pa.bool_()}, "name string, whole boolean")


def code_mappings(frame: DataFrame) -> DataFrame:
    """Rows (doc_id, code, digits, text, rule): what a ToUnicode map makes of each code, in each way it is written."""

    def read(raw: bytes) -> Iterator[tuple]:
        _, codes = s.to_unicode(raw)
        return ((code, digits, wide.decode("utf-16-be", "replace")) for code, ways in codes.items() for digits, wide in ways)

    return _rows(frame, read, {"code": pa.int64(), "digits": pa.int64(), "text": pa.string()}, "code long, digits long, text string")

r"""Chat formatting by event-sourced reconstruction.

The input is a log of events (conv_id, seq, message, kind, role, text):

- `open`: the message begins, with its role; its text starts the message (null: nothing yet)
- `delta`: text is appended to the message; a first event of this kind begins a message without a role
- `edit`: text replaces the message's text; a message that has not begun, or is withdrawn, has nothing to edit
- `regenerate`: the message's text is discarded and begins anew with this text; later deltas continue it
- `delete`: the message is withdrawn; nothing but an `open` or a `regenerate` brings it back

The log is partitioned by conversation and message, sorted by seq (ties: kind, in the order above but with `regenerate`
before `edit` and `delta`, then role and text) and folded as a stream, so that a task holds one message, not a conversation.
Messages are then partitioned by conversation and sorted by message number (ties: role, then text), and rendered as a
stream. A long conversation is one training example and so one row. Messages may share a number if `part` tells them apart.

Template: `<turn ROLE>TEXT</turn>` per message. In roles and texts every backslash, `<` and `>` is preceded by a
backslash, so no text can contain a mark, and `parse` reads back exactly what was written. The loss mask is a list of
(start, end) code-point spans of the formatted text: the escaped texts of the assistant's messages.

Rows: a null text or role is the empty string; a null or unknown kind counts as `delta`. A null conv_id is a conversation of its own. Repeated rows are repeated events (repeated `open`s
restart the message); a conversation table's rows that repeat a (conv_id, turn) are messages of their own. Empty logs
give no rows. Columns besides the named ones are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The template's marks, and the role whose texts are learned.
OPEN, BETWEEN, CLOSE, LEARNED = "<turn ", ">", "</turn>", "assistant"
SPECIAL = re.compile(r"[\\<>]")
MARK = re.compile(r"\\(.)|(<turn )|(</turn>)|(>)", re.DOTALL)


def escape(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[list[int]]]:
    """The formatted text of (role, text) messages and its loss spans."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = OPEN + escape(role) + BETWEEN, escape(text)
        at += len(head)
        if role == LEARNED:
            spans.append([at, at + len(body)])
        at += len(body) + len(CLOSE)
        parts += head, body, CLOSE
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted text; ValueError if it is not one."""
    out, at, state, start, role = [], 0, "outside", 0, ""
    for m in MARK.finditer(formatted):
        if m[1] is not None:
            continue
        if state == "outside" and m[2] and m.start() == at:
            state, start = "role", m.end()
        elif state == "role" and m[4]:
            role, state, start = unescape(formatted[start : m.start()]), "text", m.end()
        elif state == "text" and m[3]:
            out.append((role, unescape(formatted[start : m.start()])))
            state, at = "outside", m.end()
        else:
            raise ValueError(f"misplaced mark at {m.start()}")
    if state != "outside" or at != len(formatted):
        raise ValueError("not a whole formatted text")
    return out


#: Events of the same seq apply in this order.
RANK = ("open", "regenerate", "edit", "delta", "delete")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events sorted by (conv_id, message, part, seq): one row per message that stands."""
    key, role, parts, state = object(), "", [], "none"
    for batch in batches:
        out = []
        for conv, message, part, kind, who, text in zip(
            *(batch.column(c).to_pylist() for c in ("conv_id", "message", "part", "kind", "role", "text")), strict=True
        ):
            if (conv, message, part) != key:
                if state == "there":
                    out.append((*key[:2], role, "".join(parts)))
                key, role, parts, state = (conv, message, part), "", [], "none"
            if kind == "delete":
                parts, state = [], "withdrawn"
            elif kind in ("open", "regenerate"):
                parts, state = [text or ""], "there"
                role = (who or "") if kind == "open" else role
            elif kind == "edit":
                parts = [text or ""] if state == "there" else parts
            elif state != "withdrawn":
                parts.append(text or "")
                state = "there"
        yield _messages(out)
    if state == "there":
        yield _messages([(*key[:2], role, "".join(parts))])


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "message", "role", "text"]
    )


def reconstruct(events: DataFrame) -> DataFrame:
    """Rows (conv_id, message, role, text): the log's final messages. events may have `part` (long) beside message."""
    part = F.col("part") if "part" in events.columns else F.lit(0).cast("long")
    kind = F.when(F.col("kind").isin(*RANK), F.col("kind")).otherwise("delta")
    events = events.select("conv_id", "message", part.alias("part"), "seq", kind.alias("kind"), "role", "text")
    events = events.withColumn("rank", F.array_position(F.array(*map(F.lit, RANK)), F.col("kind")))
    own = ["conv_id", "message", "part"]
    events = events.repartition(*own).sortWithinPartitions(*own, "seq", "rank", "role", "text")
    return events.mapInArrow(_fold, "conv_id long, message long, role string, text string")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages sorted by (conv_id, message): one formatted text per conversation."""

    def row(conv, parts) -> pa.RecordBatch:
        text, spans = render(parts)
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([text], pa.string()), pa.array([spans], pa.list_(pa.list_(pa.int64())))],
            ["conv_id", "formatted", "loss_spans"],
        )

    key, parts, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if begun and conv != key:
                yield row(key, parts)
                parts = []
            key, begun = conv, True
            parts.append((role or "", text or ""))
    if begun:
        yield row(key, parts)


def format_chats(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, formatted, loss_spans) from messages (conv_id, message, role, text)."""
    messages = messages.select("conv_id", "message", "role", "text").repartition("conv_id")
    messages = messages.sortWithinPartitions("conv_id", "message", "role", "text")
    return messages.mapInArrow(_render, "conv_id long, formatted string, loss_spans array<array<long>>")


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as the log of how they came about. Rows that repeat a turn are messages of their own.

    Every turn opens its message. By the hash of its text, a turn was then streamed in two deltas as it stands; or begun
    wrongly, regenerated and continued; or streamed wrongly and set right by an edit; or deleted at first and opened again.
    Equal rows are counted before they are shuffled; `part` numbers them and tells apart what shares a turn.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("message"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    same = rows.groupBy("conv_id", "message", F.xxhash64("role", "text").alias("hash"))
    rows = same.agg(F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("part", F.xxhash64("hash", "copy"))
    whole = F.col("text")
    half = F.floor(F.length(whole) / 2).cast("int")
    head, tail = F.substring(whole, F.lit(1), half), F.substring(whole, half + 1, F.length(whole))
    wrong = F.concat(F.substring(whole, 1, 12), F.lit(" </turn>"))

    def log(*steps: tuple[str, Column]) -> Column:
        made = (F.struct(F.lit(k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text")) for k, (kind, text) in enumerate(steps))
        return F.array(*made)

    none = F.lit("")
    how = F.pmod("hash", F.lit(4))
    events = (
        F.when(how == 0, log(("open", none), ("delta", head), ("delta", tail)))
        .when(how == 1, log(("open", none), ("delta", wrong), ("regenerate", head), ("delta", tail)))
        .when(how == 2, log(("open", wrong), ("delta", wrong), ("edit", whole)))
        .otherwise(log(("open", wrong), ("delete", none), ("delta", wrong), ("open", head), ("delta", tail)))
    )
    return rows.select("conv_id", "message", "part", "role", F.inline(events))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, formatted, spans in zip(
            *(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True
        ):
            turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            messages = parse(formatted)
            for role, text in messages:
                turns.update(f"{role}\n{text}\n".encode())
            for a, b in spans:
                text = unescape(formatted[a:b])
                loss.update(text.encode())
                chars += len(text)
            out.append((conv, len(messages), turns.hexdigest(), chars, loss.hexdigest(), len(formatted)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted texts finds in them, as digests."""
    return formatted.mapInArrow(
        _read_back,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


#: Fixed values of the query's contract.
TRAP_CONV, TRAP_TEXT = -7, r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(TRAP_CONV).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRAP_TEXT).alias("text"),
    )
    return digests(format_chats(reconstruct(events_of(rows.union(trap)))))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
e AS (
  SELECT *, 14 + length(replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>'))
    + length(replace(replace(replace(text, '\', '\\'), '<', '\<'), '>', '\>')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

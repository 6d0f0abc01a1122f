import duckdb
from hypothesis import given
from hypothesis import strategies as st

from quire.llm import chat_format as c

SF = "/root/testdata/sf0.001"
pieces = [*"\\<>/turn #: \n\u00e9\U0001f600", "</turn>", "<turn user>"]
texts = st.lists(st.sampled_from(pieces), max_size=20).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), texts), texts)))
def test_round_trip(messages):
    formatted, spans = c.render(messages)
    assert c.parse(formatted) == messages
    assert [c.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in messages if r == "assistant"]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = c.op5_chat_format(spark, SF)
    rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({c.OP5_SQL}) q").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_events(spark):
    log = [
        (1, 0, 0, "open", "user", "Hi"), (1, 1, 1, "open", "assistant", None), (1, 2, 1, "delta", None, "He"),
        (1, 3, 1, "delta", None, "llo"), (1, 4, 0, "edit", None, "Hi!"), (1, 5, 1, "regenerate", None, ""),
        (1, 6, 1, None, None, "Good "), (1, 7, 1, "delta", None, "day"), (1, 8, 2, "open", "user", "gone"),
        (1, 9, 2, "delete", None, None), (2, 3, 0, "delta", None, "late"), (2, 4, 0, "delta", None, None),
        (None, 0, 0, "open", "assistant", ""), (3, 0, 5, "edit", None, "x"), (4, 0, None, "open", None, "no number"),
    ]
    schema = "conv_id long, seq long, message long, kind string, role string, text string"
    frame = spark.createDataFrame(log, schema)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in c.reconstruct(frame).collect()}
    assert got == {
        (1, 0): ("user", "Hi!"), (1, 1): ("assistant", "Good day"), (2, 0): ("", "late"), (None, 0): ("assistant", ""),
        (4, None): ("", "no number"),
    }
    formatted = {r.conv_id: r.formatted for r in c.format_chats(c.reconstruct(frame)).collect()}
    assert (3, 5) not in got and formatted[1] == "<turn user>Hi!</turn><turn assistant>Good day</turn>"
    assert c.reconstruct(spark.createDataFrame([], schema)).collect() == []


def folded(events):
    """The final (role, text) of each message by states, one event after the other; events: (message, seq, kind, role, text)."""
    rank = {"open": 0, "regenerate": 1, "edit": 2, "delta": 3, "delete": 4}
    out = {}
    for message, _, kind, role, text in sorted(events, key=lambda e: (e[0], e[1], rank[e[2]], e[3] or "", e[4] or "")):
        was = out.get(message)
        if kind == "open":
            out[message] = (role or "", text or "")
        elif kind == "regenerate":
            out[message] = (was[0] if was else out.get((message, "role"), ""), text or "")
        elif kind == "delete":
            out[message, "role"], out[message] = was[0] if was else out.get((message, "role"), ""), False
        elif kind == "edit" and was:
            out[message] = (was[0], text or "")
        elif kind == "delta" and was is not False:
            out[message] = ((was or ("", ""))[0], (was or ("", ""))[1] + (text or ""))
    return {k: v for k, v in out.items() if isinstance(k, int) and v}


def test_random_logs_against_a_plain_fold(spark):
    import random

    r = random.Random(3)
    kinds = ["open", "delta", "delta", "edit", "regenerate", "delete"]
    log = [(k % 40, r.randrange(6), r.choice(kinds), r.choice([None, "user", "assistant"]), r.choice([None, "", "a", "b"])) for k in range(400)]
    frame = spark.createDataFrame([(1, *e) for e in log], "conv_id long, message long, seq long, kind string, role string, text string")
    assert {r.message: (r.role, r.text) for r in c.reconstruct(frame).collect()} == folded(log)


def test_events_of_hold_every_kind(spark):
    log = c.events_of(spark.read.parquet(f"{SF}/conversations.parquet")).groupBy("kind").count().collect()
    assert {r.kind for r in log} == set(c.RANK) and min(r["count"] for r in log) > 5


def test_rows(spark):
    rows = [(1, 0, "user", None, 9), (1, 1, None, "a\\b", 9), (1, 1, None, "a\\b", 9), (1, 1, "assistant", "x" * 10**6, 9), (1, None, "user", "first", 9)]
    rows += [(None, 0, "user", "n", 9)] + [(2, k, "assistant", f"t{k}", 9) for k in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    got = {r.conv_id: r for r in c.format_chats(c.reconstruct(c.events_of(frame))).collect()}
    assert c.parse(got[1].formatted) == [("user", "first"), ("user", ""), ("", "a\\b"), ("", "a\\b"), ("assistant", "x" * 10**6)]
    assert len(got[2].loss_spans) == 3000 and c.parse(got[None].formatted) == [("user", "n")]
    empty = spark.createDataFrame([], frame.schema)
    assert c.digests(c.format_chats(c.reconstruct(c.events_of(empty)))).collect() == []

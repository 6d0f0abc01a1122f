import random
import tracemalloc

import duckdb

from quire.llm import decontaminate as d

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, items string"


def test_query_equals_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = d.op8_decontaminate(spark, SF)
    rows = c.execute(f"SELECT {', '.join(got.columns)} FROM ({d.OP8_SQL}) q").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert any(r[2] for r in rows)


def test_memory_of_a_block():
    """8 MB of benchmark text as windows, on the driver and as what a worker holds."""
    r = random.Random(2)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(50_000)]
    items = [(str(k), " ".join(r.choices(vocabulary, k=150))) for k in range(8_400)]
    assert sum(len(t) for _, t in items) > 8_000_000
    tracemalloc.start()
    known = d.windows_of(items, 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = len(known.words) + sum(x.nbytes for w in known.by_length.values() for x in w)
    print("peak MB", peak >> 20, "held MB", held >> 20)
    assert peak < 200 << 20 and held < 60 << 20


def test_long_items_as_pieces(spark):
    """An item longer than a block, in pieces: every window of it is known."""
    words = [f"w{k}" for k in range(5000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "two words")], "item_id long, text string")
    docs = [(k, " ".join(words[k : k + 13])) for k in range(0, 4988, 31)] + [(-1, " ".join(words[7:19])), (-2, "x " * 2000 + " ".join(words))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in d.contamination(frame, bench, block_bytes=30_000, piece_bytes=2_000).collect()}
    assert all(r.n_hit == 13 and r["items"] == ["1"] for k, r in got.items() if k >= 0)
    assert got[-1].n_hit == 0 and got[-2].n_hit == 5000


def test_rows(spark):
    item = " ".join(f"w{k}" for k in range(15))
    bench = spark.createDataFrame(
        [(1, item), (2, "short item"), (None, "no name here"), (4, None), (5, ""), (2, "another one")], "item_id long, text string"
    )
    docs = [
        (1, None), (2, ""), (3, "Short-ITEM!"), (4, item.upper().replace(" ", ", ")), (5, "w0 " * 1000 + item),
        (6, " ".join(f"w{k}" for k in range(12))), (7, "no name here"), (8, "a short item and another one"), (8, "a short item and another one"),
    ]
    frame = spark.createDataFrame([(*x, "clash") for x in docs], SCHEMA)
    for options in ({}, {"block_bytes": 150}):
        got = {r.doc_id: r for r in d.contamination(frame, bench, **options).collect()}
        assert (got[1].n_words, got[1].n_hit, got[1].contaminated) == (0, 0, False)
        assert got[2].n_words == 0 and not got[2].contaminated
        assert (got[3].n_words, got[3].n_hit, got[3]["items"]) == (2, 2, ["2"])
        assert (got[4].n_hit, got[4]["items"], got[4].contaminated) == (15, ["1"], True)
        assert (got[5].n_words, got[5].n_hit, got[5].contaminated) == (1015, 15, False)
        assert got[6].n_hit == 0
        assert got[7]["items"] == [""] and got[7].n_items == 1
        assert (got[8].n_hit, got[8].n_items) == (4, 1)
    kept = [r.doc_id for r in d.remove_contaminated(frame, bench).collect()]
    assert sorted(kept) == [1, 2, 5, 6]
    cut = {r.doc_id: r for r in d.remove_spans(frame, bench).collect()}
    assert cut[8].text == "a  and " and cut[8]["items"] == "clash" and cut[1].text is None
    empty = spark.createDataFrame([], SCHEMA)
    assert d.contamination(empty, bench).collect() == []
    assert [r.n_hit for r in d.contamination(frame, bench.limit(0)).collect()] == [0] * 9

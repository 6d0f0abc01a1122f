from pyspark.sql import functions as F

from quire.functions import outcome as o
from quire.operators import pages as p
from quire.sources import documents as d
from quire.streaming import ingest as i

BODY = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Kids [3 0 R] /Note (9 0 R) >>\nendobj\n3 0 obj\nnull\nendobj\n"


def file_of(offset=9, count=2, extra=b""):
    head = BODY + extra
    return head + b"xref\n0 %d\n0000000000 65535 f \n%010d 00000 n \ntrailer\n<< /Size 2 >>\nstartxref\n%d\n%%%%EOF" % (count, offset, len(head))


def test_profile_and_gate(spark, tmp_path):
    cases = {
        "good": (file_of(), None),
        "past": (file_of(10**6), "entry-past-end"),
        "many": (file_of(count=10**8), "prescan"),
        "long": (b"<< /Length 999999 >>\nstream", "stream-longer-than-file"),
        "indirect": (b"<< /Length 999999 0 R >>", None),
    }
    for name, (raw, _) in cases.items():
        (tmp_path / name).write_bytes(raw)
    documents = d.read_documents(spark, str(tmp_path))
    found = d.prescanned(documents).join(documents.select("doc_id", "path"), "doc_id")
    got = {r.path.rpartition("/")[2]: r.error and (r.error.rule or r.error.stage) for r in found.collect()}
    assert got == {k: v for k, (_, v) in cases.items()}
    assert d.profile(cases["good"][0])[:3] == (2, 0, 1)


def test_references(spark):
    rows = d.references(BODY)
    assert [(r[0], r[2]) for r in rows if r[4] == "reference"] == [(1, 2), (2, 3)]
    assert [(r[0], r[4]) for r in rows if r[2] is None] == [(1, "object"), (2, "object"), (3, "null")]
    frame = spark.createDataFrame([(7, bytearray(BODY)), (8, None)], "doc_id long, content binary")
    assert d.reference_rows(frame).count() == len(rows)


def chain(*sections, start=0):
    """A file of sections, each a function of the offset of the one before, with a pointer to the last."""
    raw, before = bytearray(b"%PDF-1.7\n"), None
    for make in sections:
        at = len(raw)
        raw += make(before)
        before = at
    return bytes(raw + b"startxref\n%d\n%%%%EOF" % (before + start))


def stream_section(extra):
    return lambda before: b"8 0 obj\n<< /Type /XRef %s%s >>\nendobj\n" % (extra, b" /Prev %d" % before if before else b"")


def table_section(count, *entries, eol=b" \n"):
    rows = b"".join(b"%010d 00000 %s%s" % (x, kind, eol) for x, kind in entries)
    return lambda before: b"xref\n0 %d\n%strailer\n<< /Size 3%s >>\n" % (count, rows, b" /Prev %d" % before if before else b"")


def test_profile_of_sections():
    assert d.profile(chain(stream_section(b"/Size 700")))[:3] == (700, 0, 1)
    assert d.profile(chain(stream_section(b"/Sizes 9 /Size 4 /Size 700")))[0] == 700  # the largest, and whole names only
    assert d.profile(chain(stream_section(b"/Size 700 /Index [0 5 40 6]")))[0] == 11
    apart = b" " * d.HEAD  # the head that is searched for /Prev ends before the next section
    assert d.profile(chain(*(lambda before, n=n: stream_section(b"/Size %d" % n)(before) + apart for n in (50, 60, 55))))[::2] == (60, 3, 0)
    assert d.profile(b"<< /Size 12 >> startxref\n99999\n")[:3] == (12, 0, 0)  # nothing by the chain: the whole file
    assert d.profile(b"/Size " + b"9" * 5000)[0] == o.MOST and d.profile(b"/Length " + b"9" * 5000 + b" ")[1] == o.MOST
    assert d.profile(b"") == (0, 0, 0, False, 0)


def test_entries_are_judged_once():
    good = (5, b"n")
    past = chain(table_section(2, good, (10**9, b"n")), table_section(1, (0, b"f")))
    assert d.profile(past) == (2, 0, 2, True, 3)
    assert d.profile(chain(table_section(2, (10**9, b"f"), good)))[3:] == (False, 2)  # a free entry has no place
    assert d.profile(chain(table_section(2, good, (10**9, b"n"), eol=b"\n")))[3:] == (False, 1)  # not laid out as specified
    assert d.profile(chain(table_section(1, good, (10**9, b"n"))))[3:] == (False, 1)  # beyond the declared number
    assert d.profile(chain(lambda _: b"\n" + table_section(2, good, good)(None)))[0] == 2  # white space before the keyword
    exact = len(chain(table_section(1, good)))
    assert d.profile(chain(table_section(1, (exact, b"n"))))[3] and not d.profile(chain(table_section(1, (exact - 1, b"n"))))[3]
    twice = table_section(3, good, good, good)(None)
    inner = b"xref\n0 1\n" + twice  # its one entry's bytes are no entry, so the table behind is judged from its own start only
    assert d.profile(chain(lambda _: inner))[4] == 1
    many = 3 * d.ENTRIES_AT_ONCE + 7
    assert d.profile(chain(table_section(many, *[good] * (many - 1), (10**9, b"n"))))[3:] == (True, many)


def test_references_of_values_and_members(spark):
    assert d.value_references(b"<< /A 4 0 R /B [5 1 R (6 0 R)] >> 7 0 R") == [(4, 0), (5, 1)]
    assert d.value_references(b"12 8 0 R") == [(8, 0)] and d.value_references(b"12 /A 8 0 R") == []
    head, values = b"21 0 22 13 23 18 ", b"<</K 30 0 R>>null [31 0 R 32 0 R]"
    rows = d.member_references(head + values, 3, len(head))
    assert [r for r in rows if r[4] == "reference"] == [(21, 0, 30, 0, "reference"), (23, 0, 31, 0, "reference"), (23, 0, 32, 0, "reference")]
    assert [r[4] for r in rows if r[2] is None] == ["object", "null", "object"]
    unreadable = [(None, None, None, None, "refused:object-stream-header")]
    assert d.member_references(b"21 x <<>>", 1, 5) == d.member_references(b"21 0 ", 2, 5) == d.member_references(b"21 90 <<>>", 1, 6) == unreadable
    streams = spark.createDataFrame(
        [(1, bytearray(head + values), 3, len(head)), (2, None, 3, 4), (3, bytearray(b"x"), None, 1)], "doc_id long, content binary, count long, first long"
    )
    got = d.member_rows(streams).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {1}


def test_operation_rows(spark):
    frame = spark.createDataFrame([(1, 0, bytearray(b"q /F1 12 Tf Q")), (1, 1, bytearray(b"(x")), (2, 0, None)], "doc_id long, stream_id long, content binary")
    got = d.operation_rows(frame).collect()
    assert [(r.operator, r.operands) for r in got if r.stream_id == 0] == [("q", []), ("Tf", ["F1", "12"]), ("Q", [])]
    assert [r.rule for r in got if r.stream_id == 1] == ["unclosed-string"]


def test_manifest(spark):
    schema = "name string, kind string, url string, sha256 string, licence string, generator string, path string"
    rows = [("a", "fetched", "u", "s", "", None, None), ("b", "generated", None, "s", None, "g", None), ("c", "other", None, None, None, None, None)]
    assert {(r.name, r.problem) for r in d.manifest_problems(spark.createDataFrame(rows, schema)).collect()} == {("a", "licence"), ("c", "kind")}


def test_ingest_takes_each_file_once(spark, tmp_path):
    folder, to, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_bytes(b"one")
    assert i.ingest(spark, folder, to, marks) == 1
    (tmp_path / "in/b").write_bytes(b"two")
    assert i.ingest(spark, folder, to, marks) == 2
    assert i.ingest(spark, folder, to, marks) == 2


def test_parts_are_written_one_by_one(spark, tmp_path):
    pages = spark.createDataFrame([(1, k, 0, f"p{k}") for k in range(1, 6)], "doc_id long, page_no long, rotation int, body string")
    split, outcomes = p.split(pages, spark.createDataFrame([(1, [2, 3])], "doc_id long, cuts array<bigint>"))
    assert outcomes.where("error is null").count() == 1
    d.write_parts(split, str(tmp_path / "parts"))
    back = spark.read.parquet(str(tmp_path / "parts"))
    assert {(r.part, r.page_no, r.body) for r in back.collect()} == {(0, 1, "p1"), (0, 2, "p2"), (1, 1, "p3"), (2, 1, "p4"), (2, 2, "p5")}


def test_empty_tables_and_limits(spark):
    none = spark.createDataFrame([], "doc_id long, page_no long, rotation int, body string")
    assert p.structure_check(none).count() == 0 and p.split_every(none, 0)[0].count() == 0
    big = spark.range(1).select(o.saturating_sum(F.lit(o.MOST), F.lit(5)).alias("x")).first().x
    assert big == o.MOST


def test_parsed_rows_refuse_and_skip_nulls(spark):
    from quire.sources import parsed

    frame = spark.createDataFrame([(1, bytearray(b"(a")), (2, None), (3, bytearray(b""))], "doc_id long, content binary")
    assert [tuple(r) for r in parsed.numbers(frame).collect()] == [(1, None, None, "unclosed-string")]
    assert [r.rule for r in parsed.names(frame).collect()] == ["unclosed-string"]
    assert parsed.dictionary_keys(frame.where("doc_id > 1")).count() == 0
    assert d.operation_rows(frame.withColumn("stream_id", F.lit(0).cast("long"))).where("rule is not null").count() == 1

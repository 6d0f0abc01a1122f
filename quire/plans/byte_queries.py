"""More registered queries: the byte parsers, over files and streams that are written from the tables' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import redaction as r
from ..operators import trees
from ..sources import documents, parsed
from .queries import long, query, rule
from .standin import load


def _written(frame: DataFrame, key: str, content: str, *more: str) -> DataFrame:
    return frame.selectExpr(f"{key} AS doc_id", f"CAST({content} AS BINARY) AS content", *more)


FILE = r"""concat('%PDF-1.7\n', CASE o_orderkey % 3
  WHEN 0 THEN concat('<< /Size ', o_custkey + 1, ' /Length ', o_custkey % 200, ' >>')
  WHEN 1 THEN concat('<< /Size 9 /Index [0 ', o_custkey, ' 40 ', o_orderkey, '] >>')
  ELSE concat('xref\n0 2\n0000000000 65535 f \n', lpad(CAST(o_custkey * 7 % 200 AS STRING), 10, '0'), ' 00000 n \ntrailer\n<< /Size 7 >>') END, '\nstartxref\n9\n%%EOF')"""


@query(r"""WITH f AS (SELECT o_orderkey AS doc_id, o_custkey AS c, o_orderkey % 3 AS kind, 9 + CASE o_orderkey % 3
  WHEN 0 THEN length('<< /Size  /Length  >>' || (o_custkey + 1) || (o_custkey % 200)) WHEN 1 THEN length('<< /Size 9 /Index [0  40 ] >>' || o_custkey || o_orderkey)
  ELSE 9 + 40 + 21 END + 18 AS n FROM orders),
p AS (SELECT doc_id, CASE kind WHEN 0 THEN c + 1 WHEN 1 THEN c + doc_id ELSE 2 END AS xref_entries, CASE kind WHEN 0 THEN c % 200 ELSE 0 END AS largest_stream,
  kind = 2 AND c * 7 % 200 >= n AS entry_past_end, CAST(CASE kind WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS entries_judged, n FROM f)
SELECT doc_id, CAST(xref_entries AS BIGINT) AS xref_entries, CAST(largest_stream AS BIGINT) AS largest_stream, entry_past_end, entries_judged,
  CASE WHEN largest_stream > n THEN 'stream-longer-than-file' WHEN entry_past_end THEN 'entry-past-end' END AS rule FROM p""")
def prescanned_files(spark, d):
    files = _written(load(spark, d, "orders"), "o_orderkey", FILE).withColumn("n_bytes", long(F.octet_length("content")))
    found = documents.prescanned(files)
    return found.select("doc_id", "xref_entries", "largest_stream", "entry_past_end", "entries_judged", rule(F.col("error")).alias("rule"))


@query("""SELECT l_orderkey AS doc_id, l_partkey AS src, NULL::BIGINT AS num, NULL::BIGINT AS gen, 'object' AS kind FROM lineitem
UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, 0, 'reference' FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 1, 'reference' FROM lineitem""")
def scanned_references(spark, d):
    content = r"concat('%PDF-1.7\n', l_partkey, ' 0 obj\n<< /A ', l_suppkey, ' 0 R /B (9 0 R) % 8 0 R\n /C [', l_linenumber, ' 1 R 3] >>\nendobj\n')"
    return documents.reference_rows(_written(load(spark, d, "lineitem"), "l_orderkey", content)).select("doc_id", "src", "num", "gen", "kind")


@query("""WITH m AS (SELECT o_orderkey AS doc_id, o_custkey AS c FROM orders WHERE o_orderkey % 10 <> 0)
SELECT o_orderkey AS doc_id, NULL::BIGINT AS src, NULL::BIGINT AS num, 'refused:object-stream-header' AS kind FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT doc_id, c, NULL, 'object' FROM m UNION ALL SELECT doc_id, c + 1, NULL, 'null' FROM m UNION ALL SELECT doc_id, c, doc_id, 'reference' FROM m""")
def member_references(spark, d):
    head, value = "concat(o_custkey, ' 0 ', o_custkey + 1, ' ', length(concat('<</K ', o_orderkey, ' 0 R>>')), ' ')", "concat('<</K ', o_orderkey, ' 0 R>>')"
    count = "CAST(CASE WHEN o_orderkey % 10 = 0 THEN 3 ELSE 2 END AS BIGINT) AS count"
    streams = _written(load(spark, d, "orders"), "o_orderkey", f"concat({head}, {value}, 'null 5 0 R')", count, f"CAST(length({head}) AS BIGINT) AS first")
    return documents.member_rows(streams).select("doc_id", "src", "num", "kind")


@query("""WITH l AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS stream_id, l_partkey % 9 AS f, l_suppkey AS s, l_returnflag AS m FROM lineitem)
SELECT doc_id, stream_id, 0::BIGINT AS op_ord, 'q' AS operator, '' AS operands FROM l UNION ALL SELECT doc_id, stream_id, 1, 'Tf', 'F' || f || ' ' || s FROM l
UNION ALL SELECT doc_id, stream_id, 2, 'Tj', '(' || m || ' (q Q))' FROM l UNION ALL SELECT doc_id, stream_id, 3, 'Q', '' FROM l""")
def parsed_operations(spark, d):
    content = r"concat('q% Q\n/F', l_partkey % 9, ' ', l_suppkey, ' Tf(', l_returnflag, ' (q Q))Tj Q')"
    streams = _written(load(spark, d, "lineitem"), "l_orderkey", content, "CAST(l_linenumber AS BIGINT) AS stream_id")
    found = documents.operation_rows(streams)
    return found.select("doc_id", "stream_id", "op_ord", "operator", F.array_join("operands", " ").alias("operands"))


@query("""WITH l AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page_no, l_partkey AS x, l_suppkey AS y, CAST(l_quantity AS BIGINT) AS s FROM lineitem),
g AS (SELECT doc_id, page_no, 0::BIGINT AS glyph_ord, x, y, 65::BIGINT AS code, 'F1' AS font FROM l UNION ALL SELECT doc_id, page_no, 1, x + 0.5 * s + 3, y, 32, 'F1' FROM l
  UNION ALL SELECT doc_id, page_no, 2, x, y - 7, 16706, 'F2' FROM l UNION ALL SELECT doc_id, page_no, 3, x + s, y - 7, 32, 'F2' FROM l UNION ALL SELECT doc_id, page_no, 4, x + 2 * s, y - 7, 33, 'F2' FROM l)
SELECT doc_id, page_no, glyph_ord, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, code, font FROM g""")
def walked_glyphs(spark, d):
    size = "CAST(l_quantity AS BIGINT)"
    content = f"concat('BT /F1 ', {size}, ' Tf ', l_partkey, ' ', l_suppkey, ' Td 3 Tc 5 Tw (A ) Tj 0 Tc 0 -7 Td /F2 ', {size}, ' Tf <414200200021> Tj ET')"
    streams = _written(load(spark, d, "lineitem"), "l_orderkey", content, "CAST(l_linenumber AS BIGINT) AS page_no")
    fonts = {"F1": ({65: 500}, 250, (0, -200, 700, 800)), "F2": ({}, 1000, (0, -100, 1000, 900), 2)}
    return documents.glyph_rows(streams, fonts).select("doc_id", "page_no", "glyph_ord", "x", "y", "code", "font")


@query("""WITH p AS (SELECT p_partkey AS doc_id, p_size AS n FROM part) SELECT doc_id, 0::BIGINT AS at, 'A' || n AS key FROM p
UNION ALL SELECT doc_id, 1, 'B ' FROM p UNION ALL SELECT doc_id, 2, 'E' FROM p""")
def dictionary_keys(spark, d):
    content = "concat('<< /A', p_size, ' /V /B#20 << /C [/D ', p_size, '] >> /E (/F (/G)) >>')"
    return parsed.dictionary_keys(_written(load(spark, d, "part"), "p_partkey", content)).select("doc_id", "at", "key")


@query(r"""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN p_type || chr(10) || '(' || p_size || ')' || 'A)\' ELSE upper(p_name) END AS decoded FROM part""")
def decoded_strings(spark, d):
    literal = r"concat('(', p_type, '\\n(', p_size, ')\\101\\)\\\\)')"
    content = f"CASE WHEN p_partkey % 2 = 0 THEN {literal} ELSE concat('<', hex(upper(p_name)), ' >') END"
    return parsed.decoded_strings(_written(load(spark, d, "part"), "p_partkey", content)).select("doc_id", F.decode("decoded", "UTF-8").alias("decoded"))


@query("""WITH p AS (SELECT p_partkey AS doc_id, p_size AS n, CAST(p_partkey % 100 + 1 AS DOUBLE) AS k FROM part)
SELECT doc_id, 0::BIGINT AS at, CAST(n AS DOUBLE) AS number FROM p UNION ALL SELECT doc_id, 1, -k FROM p UNION ALL SELECT doc_id, 2, 0.5 FROM p""")
def fragment_numbers(spark, d):
    content = r"concat(p_size, ' -', p_partkey % 100 + 1, '.0 % 7\n(8 9) /N10 .5')"
    return parsed.numbers(_written(load(spark, d, "part"), "p_partkey", content)).select("doc_id", "at", "number")


@query("""WITH p AS (SELECT p_partkey AS doc_id, p_size AS n FROM part) SELECT doc_id, 'F' || n AS name, true AS whole FROM p
UNION ALL SELECT doc_id, 'Image' || n, true FROM p""")
def stream_names(spark, d):
    content = "concat('/F', p_size, ' 9 Tf (/No) Tj /Image', p_size, ' Do /F', p_size, ' 8 Tf')"
    return parsed.names(_written(load(spark, d, "part"), "p_partkey", content)).select("doc_id", "name", "whole")


@query("""WITH p AS (SELECT p_partkey AS doc_id, p_partkey % 90 + 33 AS c FROM part) SELECT doc_id, CAST(c AS BIGINT) AS code, chr(CAST(c + 1 AS INTEGER)) AS text FROM p
UNION ALL SELECT doc_id, 200 + i, chr(CAST(65 + i AS INTEGER)) FROM p, range(3) t(i)""")
def code_mappings(spark, d):
    wide, code = "lpad(hex(p_partkey % 90 + 34), 4, '0')", "lpad(hex(p_partkey % 90 + 33), 2, '0')"
    content = f"concat('1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfchar <', {code}, '> <', {wide}, '> endbfchar 1 beginbfrange <c8> <ca> <0041> endbfrange')"
    return parsed.code_mappings(_written(load(spark, d, "part"), "p_partkey", content)).select("doc_id", "code", "text")


@query("""WITH u AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_no, CASE WHEN l_partkey % 3 > 0 THEN 'X' || l_partkey % 3 END AS form, 'F' || l_suppkey % 5 AS font FROM lineitem),
r AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page_no, 'F' || i AS font, i FROM lineitem, range(4) t(i))
SELECT u.doc_id, u.page_no, u.form, u.font, CAST(CASE WHEN u.form = 'X2' THEN CASE u.font WHEN 'F4' THEN 77 END ELSE 100 * r.i END AS BIGINT) AS base,
  CASE WHEN CASE WHEN u.form = 'X2' THEN u.font <> 'F4' ELSE r.i IS NULL END THEN 'unknown-resource' END AS rule
FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.page_no = u.page_no AND r.font = u.font""")
def resources_in_scope(spark, d):
    items = load(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS page_no", "l_partkey % 3 AS k", "l_suppkey % 5 AS f")
    uses = items.selectExpr("doc_id", "page_no", "CASE WHEN k > 0 THEN concat('X', k) END AS form", "concat('F', f) AS font")
    page = items.select("doc_id", "page_no").distinct()
    own = page.selectExpr("doc_id", "page_no", "'X2' AS form", "'F4' AS font", "77L AS base")
    held = page.selectExpr("doc_id", "page_no", "CAST(NULL AS STRING) AS form", "explode(sequence(0L, 3L)) AS i").selectExpr("doc_id", "page_no", "form", "concat('F', i) AS font", "100 * i AS base")
    found = r.in_scope(uses, held.unionByName(own), ["font"])
    return found.select("doc_id", "page_no", "form", "font", "base", F.col("error.rule").alias("rule"))


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS at, CAST(CASE WHEN l_partkey % 4 = 0 THEN 1000 + l_suppkey % 7 WHEN l_partkey % 5 < 3 THEN l_partkey % 5 * 50 + l_suppkey % 6 END AS BIGINT) AS width,
  CASE WHEN l_partkey % 4 > 0 AND l_partkey % 5 >= 3 THEN 'unknown-width' END AS rule FROM lineitem""")
def code_widths(spark, d):
    items = load(spark, d, "lineitem")
    codes = items.selectExpr("l_orderkey AS doc_id", "l_linenumber AS at", "concat('F', l_partkey % 4) AS font", "concat('Base', l_partkey % 5) AS base", "l_suppkey % 42 AS code")
    own = codes.where("font = 'F0'").select("doc_id", "font", "code").distinct().withColumn("width", 1000 + F.col("code") % 7)
    standard = spark.range(126).selectExpr("concat('Base', id DIV 42) AS base", "id % 42 AS code", "id DIV 42 * 50 + id % 42 % 6 AS width")
    return r.code_widths(codes, own, standard).select("doc_id", "at", "width", F.col("error.rule").alias("rule"))


CHOSEN = """c AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN length(text) END) AS n, max(CASE WHEN turn = 1 THEN length(text) END) AS m FROM conversations GROUP BY conv_id),
chosen AS (SELECT conv_id, n, conv_id % 9 AS kind FROM c WHERE n >= 20 AND m >= 5)"""


def _spliced(spark, d):
    talk = load(spark, d, "conversations")
    size = lambda k: F.max(F.when(F.col("turn") == k, F.length("text")))
    chosen = talk.groupBy("conv_id").agg(size(0).alias("n"), size(1).alias("m")).where("n >= 20 and m >= 5")
    wrong = """CASE conv_id % 9 WHEN 0 THEN named_struct('ord', 1, 'start', 7, 'end', 6, 'text', '') WHEN 1 THEN named_struct('ord', 1, 'start', 7, 'end', 1000000, 'text', '')
      WHEN 2 THEN named_struct('ord', 1, 'start', 4, 'end', 8, 'text', '') WHEN 3 THEN named_struct('ord', 1, 'start', n, 'end', n + 1, 'text', 'q')
      WHEN 4 THEN named_struct('ord', 1, 'start', n - 2, 'end', n + 2, 'text', 'q') WHEN 5 THEN named_struct('ord', 1, 'start', 9, 'end', 9, 'text', '') END"""
    right = """named_struct('ord', 0, 'start', 3, 'end', 5, 'text', '[a]'), named_struct('ord', 2, 'start', n - 2, 'end', n + 3, 'text', ''),
      named_struct('ord', 3, 'start', n + 3, 'end', n + 3, 'text', '[b]'), named_struct('ord', 4, 'start', n + 3, 'end', n + 3, 'text', '[A]')"""
    edits = chosen.selectExpr("conv_id", f"inline(array_compact(array({right}, {wrong})))")
    return t.spliced(talk.join(chosen, "conv_id", "left_semi"), edits, "conv_id", "turn", "text")


@query(f"""WITH {CHOSEN} SELECT conv_id, turn, CASE turn WHEN 0 THEN substr(text, 1, 3) || '[a]' || substr(text, 6, n - 7) WHEN 1 THEN '[b][A]' || substr(text, 3) ELSE text END AS text
FROM conversations JOIN chosen USING (conv_id) WHERE kind > 5""")
def spliced_parts(spark, d):
    return _spliced(spark, d)[0].select("conv_id", "turn", "text")


@query(f"""WITH {CHOSEN} SELECT conv_id, CASE kind WHEN 0 THEN 'edit-backwards' WHEN 1 THEN 'edit-outside' WHEN 2 THEN 'edits-overlap' WHEN 4 THEN 'edit-across-parts' ELSE 'edit-changes-nothing' END AS rule
FROM chosen WHERE kind <= 5""")
def splice_refusals(spark, d):
    return _spliced(spark, d)[1].select("conv_id", rule(F.col("error")).alias("rule"))


# A document is 64 parts. Its pages are the streams 0 to 3; a stream k names N(k + 4), and N(3 k) too; the name Nk is stream k, or
# nothing but a picture where k is a multiple of 5 or, in two documents of three, from 40 or 30 on, so that its chains end sooner.
STREAMS = """s AS (SELECT p_partkey // 64 AS doc_id, p_partkey % 64 AS k FROM part),
n AS (SELECT doc_id, k, k + 4 AS name FROM s UNION SELECT doc_id, k, 3 * k FROM s),
l AS (SELECT DISTINCT n.doc_id, n.k, n.name AS dst FROM n JOIN s ON s.doc_id = n.doc_id AND s.k = n.name WHERE name % 5 > 0 AND name < [40, 30, 64][n.doc_id % 3 + 1]),
w AS (SELECT doc_id, k AS page, k AS stream, 0 AS depth FROM s WHERE k < 4 UNION SELECT w.doc_id, w.page, l.dst, w.depth + 1 FROM w JOIN l ON l.doc_id = w.doc_id AND l.k = w.stream WHERE depth < 8),
m AS (SELECT doc_id, page, stream, min(depth) AS depth FROM w GROUP BY ALL),
bad AS (SELECT doc_id, max(depth) > 5 AS deep, count(DISTINCT CASE WHEN stream >= 4 THEN stream END) AS streams FROM m GROUP BY doc_id)"""


def _names_used(spark, d):
    part = load(spark, d, "part").selectExpr("p_partkey DIV 64 AS doc_id", "p_partkey % 64 AS stream")
    names = part.selectExpr("doc_id", "stream", "explode(array_distinct(array(stream + 4, 3 * stream))) AS k").selectExpr("doc_id", "stream", "concat('N', k) AS name")
    content = "stream % 5 > 0 AND stream < get(array(40, 30, 64), CAST(doc_id % 3 AS INT))"
    resources = part.selectExpr("doc_id", "concat('N', stream) AS name", f"CASE WHEN {content} THEN stream END AS stream")
    return trees.names_used(part.where("stream < 4").selectExpr("doc_id", "stream AS page", "stream"), names, resources, 5, 22)


@query(f"""WITH RECURSIVE {STREAMS} SELECT DISTINCT m.doc_id, page, 'N' || name AS name FROM m JOIN bad USING (doc_id) JOIN n ON n.doc_id = m.doc_id AND n.k = m.stream WHERE NOT deep AND streams <= 22""")
def names_used(spark, d):
    return _names_used(spark, d)[0].select("doc_id", "page", "name")


@query(f"""WITH RECURSIVE {STREAMS} SELECT doc_id, CASE WHEN deep THEN 'streams-too-deep' ELSE 'streams-too-many' END AS rule FROM bad WHERE deep OR streams > 22""")
def stream_refusals(spark, d):
    return _names_used(spark, d)[1].select("doc_id", rule(F.col("error")).alias("rule"))


@query("""WITH o AS (SELECT l_orderkey AS doc_id, l_linenumber AS op_ord, max(l_partkey) AS k, max(l_suppkey) % 3 AS s FROM lineitem GROUP BY ALL),
l AS (SELECT *, ['Tj', 'TJ', '''', '"', 'f'][k % 5 + 1] AS operator FROM o),
i AS (SELECT l.*, t.i, chr(CAST(65 + (k + t.i) % 26 AS INTEGER)) AS c, t.i % 4 = s AS gone FROM l, range(6) t(i) WHERE operator <> 'f'),
a AS (SELECT doc_id, op_ord, k, operator, string_agg(CASE WHEN gone THEN CAST(-500 - i AS VARCHAR) ELSE '<' || hex(c) || '>' END || CASE WHEN i = 3 AND operator = 'TJ' THEN ' 120' ELSE '' END, ' ' ORDER BY i) AS x
  FROM i GROUP BY ALL)
SELECT doc_id, op_ord, CASE operator WHEN '''' THEN 'T* ' WHEN '"' THEN '5 Tw ' || k % 7 || ' Tc T* ' ELSE '' END || '[' || replace(x, '> <', '') || '] TJ' AS content, NULL AS rule FROM a WHERE k % 11 <> 0
UNION ALL SELECT doc_id, op_ord, NULL, CASE WHEN operator = 'f' THEN 'glyph-without-its-operation' ELSE 'cut-count' END FROM l WHERE operator = 'f' OR k % 11 = 0""")
def rewritten_operations(spark, d):
    key = ["doc_id", "stream_id", "op_ord"]
    items = load(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", "0L AS stream_id", "l_linenumber AS op_ord", "l_partkey", "l_suppkey")
    lines = items.groupBy(key).agg(F.max("l_partkey").alias("k"), (F.max("l_suppkey") % 3).alias("s"))  # line numbers repeat in an order
    lines = lines.withColumn("operator", F.get(F.array(*map(F.lit, ("Tj", "TJ", "'", '"', "f"))), (F.col("k") % 5).cast("int")))
    each = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    shown = each.selectExpr(*key, "2 * i AS item", "i AS glyph_ord", "hex(char(65 + (k + i) % 26)) AS code", "-500 - i AS move")
    kerns = each.where("i = 3 AND operator = 'TJ'").selectExpr(*key, "2 * i + 1 AS item", "CAST(NULL AS INT) AS glyph_ord", "CAST(NULL AS STRING) AS code", "120 AS move")
    cut = each.where("i % 4 = s").selectExpr(*key, "i AS glyph_ord").union(lines.where("k % 11 = 0").selectExpr(*key, "99 AS glyph_ord"))
    found = r.rewritten(shown.union(kerns), cut, lines.selectExpr(*key, "operator", "5 AS word", "k % 7 AS char"))
    return found.select("doc_id", "op_ord", "content", rule(F.col("error")).alias("rule"))

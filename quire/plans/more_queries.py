"""More registered queries: page-level refusals, whole requests, flattening and the checks around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import outcome as o
from ..functions import text as t
from ..operators import pages as p
from ..operators import redaction as r
from ..operators import trees
from ..operators import verify as v
from . import lifecycle
from .queries import long, query, rule
from .standin import GLYPHS, HIT, OPERATIONS, PAGES, REGIONS, glyphs, load, operations, pages, regions


@query("""WITH ob AS (SELECT l_orderkey AS doc_id, ['dictionary', 'stream', 'array'][l_linenumber % 3 + 1] AS kind, l_partkey % 40 = 0 AS ft, l_partkey % 50 = 1 AS oc,
  CASE WHEN l_suppkey % 30 = 0 THEN 'StructElem' WHEN l_suppkey % 45 = 1 THEN 'OCG' ELSE 'Page' END AS type, l_partkey % 60 = 3 AS n FROM lineitem),
f AS (SELECT doc_id, bool_or(kind <> 'array' AND ft) AS field, bool_or(kind <> 'array' AND type = 'StructElem') AS element, bool_or(n) AS n, bool_or(kind <> 'array' AND (oc OR type = 'OCG')) AS oc FROM ob GROUP BY doc_id),
m AS (SELECT DISTINCT o_orderkey AS doc_id FROM orders WHERE o_custkey % 12 = 5)
SELECT doc_id, rule FROM (SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 25 = 0 OR field THEN 'acroform-field' WHEN o_custkey % 25 = 1 OR element THEN 'structure-tree' WHEN n THEN 'null-value'
  WHEN oc THEN 'optional-content' WHEN m.doc_id IS NOT NULL THEN 'optional-content-marked' END AS rule FROM orders LEFT JOIN f ON f.doc_id = o_orderkey LEFT JOIN m ON m.doc_id = o_orderkey) q WHERE rule IS NOT NULL""")
def document_refusals(spark, d):
    k, s, c = F.col("l_partkey"), F.col("l_suppkey"), F.col("o_custkey")
    kind = F.get(F.array(*map(F.lit, ("dictionary", "stream", "array"))), (F.col("l_linenumber") % 3).cast("int"))
    keys = F.array_compact(F.array(F.lit("Type"), F.when(k % 40 == 0, "FT"), F.when(k % 50 == 1, "OC")))
    type_ = F.when(s % 30 == 0, "StructElem").when(s % 45 == 1, "OCG").otherwise("Page")
    objects = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), k.alias("num"), kind.alias("kind"), keys.alias("keys"), type_.alias("type"), (k % 60 == 3).alias("drops_null"))
    orders = load(spark, d, "orders").withColumnRenamed("o_orderkey", "doc_id")
    top = F.array_compact(F.array(F.lit("Pages"), F.when(c % 25 == 0, "AcroForm"), F.when(c % 25 == 1, "StructTreeRoot")))
    marked = orders.select("doc_id", F.when(c % 12 == 5, "OC").otherwise("Span").alias("tag"))
    found = r.document_refusals(orders.select("doc_id", top.alias("keys")), objects, marked)
    return found.select("doc_id", F.col("error.rule").alias("rule"))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey % 9 AS font FROM lineitem), ops AS (SELECT l_orderkey AS doc_id, l_suppkey % 9 AS font, ['Tj', 'f', 'Do', 'q', 'w', 'g', 're'][l_partkey % 7 + 1] AS op FROM lineitem),
u AS (SELECT doc_id, font, bool_or(op = 'Tj') AS shows, bool_or(op IN ('f', 'Do')) AS paints FROM ops GROUP BY ALL)
SELECT doc_id, 'F' || font AS font, paints, CASE WHEN shows THEN 'type3-shows-text' END AS rule FROM f JOIN u USING (doc_id, font) WHERE font % 2 = 0 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = f.doc_id AND o_custkey % 3 = 0)""")
def type_three_fonts(spark, d):
    font = F.concat(F.lit("F"), (F.col("l_suppkey") % 9).cast("string")).alias("font")
    items = load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    operator = F.get(F.array(*map(F.lit, ("Tj", "f", "Do", "q", "w", "g", "re"))), (F.col("l_partkey") % 7).cast("int"))
    subtype = F.when(F.col("l_suppkey") % 9 % 2 == 0, "Type3").otherwise("Type1")
    drawn = items.join(load(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id")), "doc_id", "left_semi").select("doc_id", font)
    found = r.type_three(drawn, items.select("doc_id", font, subtype.alias("subtype")), items.select("doc_id", font, operator.alias("operator")))
    return found.select("doc_id", "font", "paints", F.col("error.rule").alias("rule"))


@query("""WITH c AS (SELECT event_id, event_id % 9 AS code FROM events) SELECT event_id, CASE code WHEN 3 THEN 'PasswordRequired' WHEN 4 THEN 'Unsupported' WHEN 5 THEN 'Malformed' WHEN 6 THEN 'Malformed' ELSE 'Internal' END AS kind FROM c""")
def typed_errors(spark, d):
    codes = spark.createDataFrame([(0, "Malformed"), (3, "PasswordRequired"), (4, "Unsupported"), (5, "Malformed"), (6, "Malformed")], "code long, kind string")
    return o.typed_errors(load(spark, d, "events").select("event_id", (F.col("event_id") % 9).alias("code")), codes).select("event_id", "kind")


@query("""SELECT l_orderkey AS doc_id, l_partkey AS num, CASE WHEN l_suppkey % 17 = 0 THEN 'empty-key' WHEN l_partkey % 13 = 0 THEN 'empty-value' ELSE 'null-value' END AS rule
FROM lineitem WHERE l_suppkey % 17 = 0 OR l_partkey % 13 = 0 OR l_partkey % 11 = 0""")
def value_refusals(spark, d):
    k = F.col("l_partkey")
    key = F.when(F.col("l_suppkey") % 17 == 0, "").otherwise("Kids")
    value = F.when(k % 26 == 0, F.lit(None)).when(k % 13 == 0, "").when(k % 11 == 0, "null").otherwise("4 0 R")
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), k.alias("num"), key.alias("key"), value.alias("value"))
    return trees.value_refusals(rows).select("doc_id", "num", F.col("error.rule").alias("rule"))


NAMES = ("Font", "F#31", "F#3a", "F#3A", "F#aB", "A#00", "A#4", "A B", "A(", "", "A\x80", "#23", "a" * 255, "a" * 256)


@query("""SELECT p_partkey, p_partkey % 14 IN (0, 1, 2, 3, 11, 12) AND p_size % 7 <> 0 AS alike FROM part""")
def names_alike(spark, d):
    written = F.get(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES)).cast("int"))
    following = F.when(F.col("p_size") % 7 == 0, "\x0b").when(F.col("p_size") % 7 == 1, F.lit(None)).otherwise(" ")
    return load(spark, d, "part").select("p_partkey", t.reads_alike(written, following).alias("alike"))


@query(f"""WITH {PAGES}, want AS (SELECT doc_id FROM counts WHERE doc_id % 3 = 1) SELECT doc_id, page_no FROM pages_in SEMI JOIN want USING (doc_id)""")
def drawn_annotations(spark, d):
    all_ = pages(spark, d)
    requests = all_.select("doc_id").distinct().withColumn("annotations", F.when(F.col("doc_id") % 3 != 2, F.col("doc_id") % 3 == 1))
    return p.drawn_annotations(all_.select("doc_id", "page_no"), requests)


FLAT = f"""WITH {PAGES}, req AS (SELECT doc_id, n_pages, doc_id % 5 AS page, (doc_id % 90 + 1) * 60 AS w, (doc_id % 70 + 1) * 80 AS h FROM counts),
px AS (SELECT *, CAST(ceil(w * 150 / 72.0) AS BIGINT) AS pw, CAST(ceil(h * 150 / 72.0) AS BIGINT) AS ph FROM req),
judged AS (SELECT *, CASE WHEN page < 1 OR page > n_pages THEN 'past-end' WHEN pw * ph > 89478485 THEN 'pixels:max_pixels' END AS rule FROM px)"""


def _flattened(spark, d):
    k = F.col("doc_id")
    requests = p.page_count(pages(spark, d)).select("doc_id", (k % 5).alias("page_no"), ((k % 90 + 1) * 60).alias("width"), ((k % 70 + 1) * 80).alias("height"))
    return p.flattened(pages(spark, d), requests)


@query(f"""{FLAT} SELECT p.doc_id, page_no, CAST(CASE WHEN page_no = page THEN 0 ELSE rotation END AS BIGINT) AS rotation, CASE WHEN page_no <> page THEN body END AS body,
  CASE WHEN page_no = page THEN pw END AS width, CASE WHEN page_no = page THEN ph END AS height FROM pages_in p JOIN judged j ON j.doc_id = p.doc_id AND rule IS NULL""")
def flatten(spark, d):
    made = _flattened(spark, d)[0]
    return made.select("doc_id", "page_no", long("rotation").alias("rotation"), "body", F.col("picture.width").alias("width"), F.col("picture.height").alias("height"))


@query(f"{FLAT} SELECT doc_id, n_pages, rule FROM judged")
def flatten_refusals(spark, d):
    return _flattened(spark, d)[1].select("doc_id", "n_pages", rule(F.col("error")).alias("rule"))


@query("""WITH px AS (SELECT l_suppkey AS image, l_partkey % 40 AS x, l_orderkey % 40 AS y, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_orderkey % 256 END AS r FROM lineitem),
q AS (SELECT s_suppkey AS image, s_suppkey % 20 AS l, s_suppkey % 15 AS t FROM supplier)
SELECT image, count(*) AS n FROM px JOIN q USING (image) WHERE x >= greatest(l - 1, 0) AND x < least(l + 13, 40) AND y >= greatest(t - 1, 0) AND y < least(t + 9, 40) AND r <> 0 GROUP BY image""")
def paint_disagreements(spark, d):
    k, c, o_ = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    px = load(spark, d, "lineitem").select(c.alias("image"), (k % 40).alias("x"), (o_ % 40).alias("y"), F.when(k % 3 == 0, 0).otherwise(o_ % 256).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    s = F.col("s_suppkey")
    # displayed at 20 by 20 points, painted at 40 by 40 pixels: the region is scaled by two
    region = F.struct((s % 20 / 2).alias("left"), (s % 15 / 2).alias("top"), F.lit(6.0).alias("width"), F.lit(4.0).alias("height"))
    rect = g.check_rectangle(region, (F.lit(20.0), F.lit(20.0)), (F.lit(40), F.lit(40)))
    return r.paint_disagreements(px, load(spark, d, "supplier").select(s.alias("image"), rect.alias("rect")))


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey >= 3 THEN p_partkey // 3 END AS parent, p_size AS ord FROM part),
w AS (SELECT node, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.node, depth + 1 FROM n JOIN w ON n.parent = w.node)
SELECT k.node, n.parent, CAST(count(m.node) AS BIGINT) AS place, CAST(any_value(w.depth) AS BIGINT) AS depth, CASE WHEN any_value(n.ord) IS NULL THEN 'page-not-in-tree' END AS rule
FROM (SELECT DISTINCT o_custkey AS node FROM orders) k LEFT JOIN n USING (node) LEFT JOIN w USING (node) LEFT JOIN n m ON m.parent = n.parent AND m.ord < n.ord GROUP BY k.node, n.parent""")
def flatten_placement(spark, d):
    k = F.col("p_partkey")
    zero = F.lit(0)
    nodes = load(spark, d, "part").select(zero.alias("doc_id"), k.alias("node"), F.when(k >= 3, F.floor(k / 3).cast("bigint")).alias("parent"), F.col("p_size").alias("ord"))
    found = trees.placement(nodes, load(spark, d, "orders").select(zero.alias("doc_id"), F.col("o_custkey").alias("node")))
    return found.select("node", "parent", F.coalesce("place", F.lit(0)).cast("bigint").alias("place"), long("depth").alias("depth"), F.col("error.rule").alias("rule"))


@query(f"""WITH {OPERATIONS} SELECT doc_id, CAST(count(*) FILTER (operator = 'Tj') AS BIGINT) AS n_examined, CAST(count(*) FILTER (operator = 'Do') AS BIGINT) AS n_cut FROM operations GROUP BY doc_id
HAVING count(*) FILTER (operator = 'Tj') <> count(*) FILTER (operator = 'Do')""")
def miscounted(spark, d):
    ops = operations(spark, d)
    return v.miscounted(ops.where("operator = 'Tj'"), ops.where("operator = 'Do'"))


@query(f"""WITH {PAGES} SELECT doc_id, page_no, 'no-text' AS rule FROM pages_in WHERE body IS NOT NULL AND (doc_id, page_no) NOT IN (SELECT (l_orderkey, CAST(l_linenumber AS BIGINT)) FROM lineitem)""")
def unread_pages(spark, d):
    origins = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), long("l_linenumber").alias("page_no"))
    return v.unread_pages(pages(spark, d).where("body is not null"), origins)


@query(f"""WITH {PAGES}, b AS (SELECT doc_id, sum(strlen(body)) AS n FROM pages_in GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'document' WHEN doc_id % 4 = 1 THEN 'contents' ELSE 'not-smaller' END AS rule FROM b WHERE doc_id % 4 < 2 OR doc_id % 7 - 3 >= 0""")
def broken_compression(spark, d):
    before = pages(spark, d).groupBy("doc_id").agg(F.sum(F.octet_length("body")).cast("bigint").alias("n_bytes")).join(v.page_promise(pages(spark, d)).select("doc_id", "digest"), "doc_id")
    k = F.col("doc_id")
    after = before.where(k % 4 != 0).select("doc_id", (F.col("n_bytes") + k % 7 - 3).alias("n_bytes"), F.when(k % 4 == 1, F.col("digest") + 1).otherwise(F.col("digest")).alias("digest"))
    return v.broken_compression(before, after).select("doc_id", F.col("error.rule").alias("rule"))


TYPED = """CASE WHEN doc_id % 7 = 0 AND doc_id % 5 NOT IN (2, 3) THEN 'degrees' WHEN doc_id % 5 = 2 THEN 'past-end' WHEN doc_id % 5 = 3 THEN 'empty-item' WHEN doc_id % 5 IN (1, 4) AND n_pages < 2 THEN 'past-end' END"""


@query(f"""WITH {PAGES}, req AS (SELECT doc_id, {TYPED} AS rule FROM counts)
SELECT p.doc_id, page_no, CAST(CASE WHEN page_no = 1 OR (page_no = 2 AND p.doc_id % 5 IN (1, 4)) THEN (coalesce(rotation, 0) + 90) % 360 ELSE rotation END AS BIGINT) AS rotation FROM pages_in p JOIN req r ON r.doc_id = p.doc_id AND rule IS NULL""")
def rotate_typed(spark, d):
    all_ = pages(spark, d)
    typed = F.get(F.array(*map(F.lit, ("1", "1-2", "9999", ",", "2,1,1"))), (F.col("doc_id") % 5).cast("int"))
    requests = all_.select("doc_id").distinct().select("doc_id", typed.alias("typed"), F.when(F.col("doc_id") % 7 == 0, 30).otherwise(90).alias("degrees"))
    return lifecycle.rotate_typed(all_, requests).pages.select("doc_id", "page_no", long("rotation").alias("rotation"))


@query(f"""WITH {GLYPHS}, {REGIONS}, hit AS (SELECT g.* FROM glyphs g SEMI JOIN regions r ON g.doc_id = r.doc_id AND g.page_no = r.page_no AND {HIT}),
ink AS (SELECT DISTINCT doc_id FROM hit WHERE doc_id % 5 = 0), shared AS (SELECT DISTINCT doc_id FROM hit WHERE doc_id % 3 = 0)
SELECT doc_id, rule, n_cut FROM (SELECT r.doc_id, CASE WHEN r.doc_id IN (FROM ink) THEN 'ink-in-region' WHEN r.doc_id IN (FROM shared) THEN 'shared-stream' END AS rule, CASE WHEN r.doc_id NOT IN (FROM ink) AND r.doc_id NOT IN (FROM shared) THEN n END AS n_cut
  FROM (SELECT DISTINCT doc_id FROM regions) r LEFT JOIN (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id) c ON c.doc_id = r.doc_id) q""")
def redaction_report(spark, d):
    all_ = glyphs(spark, d).withColumn("stream_id", F.col("page_no"))
    ink = all_.where("doc_id % 5 = 0").select("doc_id", "page_no", *g.SIDES)
    uses = all_.select("doc_id", "stream_id").distinct().withColumn("uses", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1))
    mappings = all_.select("doc_id", "font", "code").distinct()
    keys = all_.select("doc_id", "page_no", F.col("font").alias("key")).distinct()
    done = lifecycle.redact(all_, ink, regions(spark, d), uses, mappings, keys, ("F1", "F2"))
    return done.outcomes.join(done.report, "doc_id", "left").select("doc_id", F.col("error.rule").alias("rule"), "n_cut")

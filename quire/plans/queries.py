"""The registered queries on the stand-in tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import outcome as o
from ..functions import selection as s
from ..functions import text as t
from ..operators import pages as p
from ..operators import redaction as r
from ..operators import trees
from ..operators import verify as v
from ..streaming.ingest import breaker
from .standin import GLYPHS, HIT, OPERATIONS, PAGES, REGIONS, glyphs, load, operations, pages, regions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def long(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("bigint")


def longs(*xs: int) -> Column:
    return F.array(*(F.lit(x).cast("bigint") for x in xs)) if xs else F.array().cast("array<bigint>")


def rule(error: Column) -> Column:
    return F.when(error.isNotNull(), F.coalesce(error["rule"], F.concat_ws(":", error["stage"], error["limit"])))


# 2.1, 2.3: pages


@query(f"WITH {PAGES} SELECT doc_id, n_pages FROM counts")
def page_count(spark, d):
    return p.page_count(pages(spark, d))


@query(r"""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_no FROM documents WHERE text IS NOT NULL),
l2 AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND page_no = 2 THEN 1 WHEN doc_id % 11 = 0 THEN page_no + 1 ELSE page_no END AS page_no FROM l)
SELECT doc_id, count(*) AS n_pages, CASE WHEN count(*) > 40 THEN 'page_count:max_pages'
  WHEN min(page_no) = 1 AND max(page_no) = count(*) AND count(DISTINCT page_no) = count(*) THEN NULL ELSE 'page-tree' END AS rule
FROM l2 GROUP BY doc_id""")
def structure_check(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "body"))
    no = long(F.col("i") + 1)
    off = F.when((F.col("doc_id") % 7 == 0) & (no == 2), F.lit(1)).when(F.col("doc_id") % 11 == 0, no + 1).otherwise(no)
    return p.structure_check(lines.select("doc_id", long(off).alias("page_no")), 40).select("doc_id", "n_pages", rule(F.col("error")).alias("rule"))


@query(f"WITH {PAGES} SELECT doc_id, page_no, CAST(coalesce(rotation, 0) % 360 AS BIGINT) AS rotation FROM pages_in")
def page_rotations(spark, d):
    return pages(spark, d).select("doc_id", "page_no", long(p.declared_rotation(F.col("rotation"))).alias("rotation"))


CUTS = """CASE doc_id % 6 WHEN 0 THEN CAST([] AS BIGINT[]) WHEN 1 THEN [1] WHEN 2 THEN [1, n_pages - 1] WHEN 3 THEN [0, 1]
  WHEN 4 THEN [n_pages] ELSE [2, 1] END"""
CUT_RULE = """CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN 1 >= n_pages THEN 'cut-past-end' END
  WHEN 2 THEN CASE WHEN 1 >= n_pages THEN 'cut-past-end' WHEN n_pages - 1 <= 1 THEN 'cuts-not-increasing' END WHEN 3 THEN 'cut-zero'
  WHEN 4 THEN 'cut-past-end' ELSE CASE WHEN 2 >= n_pages THEN 'cut-past-end' ELSE 'cuts-not-increasing' END END"""


def _cut_requests(spark, d) -> DataFrame:
    n, k = F.col("n_pages"), F.col("doc_id") % 6
    cuts = (
        F.when(k == 0, longs()).when(k == 1, longs(1)).when(k == 2, F.array(F.lit(1).cast("bigint"), n - 1))
        .when(k == 3, longs(0, 1)).when(k == 4, F.array(n)).otherwise(longs(2, 1))
    )
    return p.page_count(pages(spark, d)).select("doc_id", cuts.alias("cuts"))


@query(f"""WITH {PAGES}, req AS (SELECT doc_id, n_pages, {CUTS} AS cuts, {CUT_RULE} AS rule FROM counts),
marked AS (SELECT p.doc_id, p.page_no, CAST(sum(CASE WHEN list_contains(cuts, p.page_no - 1) THEN 1 ELSE 0 END)
  OVER (PARTITION BY p.doc_id ORDER BY p.page_no) AS BIGINT) AS part FROM pages_in p JOIN req USING (doc_id) WHERE rule IS NULL)
SELECT doc_id, part, min(page_no) AS "first", count(*) AS n_pages FROM marked GROUP BY doc_id, part""")
def split(spark, d):
    return p.parts(p.split(pages(spark, d), _cut_requests(spark, d))[0]).select("doc_id", "part", "first", "n_pages")


@query(f"WITH {PAGES} SELECT doc_id, n_pages, {CUT_RULE} AS rule FROM counts")
def split_refusals(spark, d):
    return p.split(pages(spark, d), _cut_requests(spark, d))[1].select("doc_id", "n_pages", rule(F.col("error")).alias("rule"))


@query(f"""WITH {PAGES} SELECT doc_id, (page_no - 1) // 3 AS part, (page_no - 1) % 3 + 1 AS page_no, body FROM pages_in""")
def split_every(spark, d):
    return p.split_every(pages(spark, d), 3)[0].select("doc_id", "part", "page_no", "body")


@query(f"""WITH {PAGES}, f AS (SELECT doc_id, page_no, doc_id % 2 = 1 AND page_no >= 3 AS failed FROM pages_in)
SELECT doc_id, page_no AS part, NOT bool_or(failed) OVER (PARTITION BY doc_id ORDER BY page_no) AS delivered_split,
  NOT failed AS delivered_render FROM f""")
def partial_delivery(spark, d):
    error = o.refused((F.col("doc_id") % 2 == 1) & (F.col("page_no") >= 3), "Internal", "part")
    parts = pages(spark, d).select("doc_id", F.col("page_no").alias("part"), error.alias("error"))
    both = p.delivered_renders(p.delivered_parts(parts).withColumnRenamed("delivered", "delivered_split"))
    return both.select("doc_id", "part", "delivered_split", F.col("delivered").alias("delivered_render"))


@query(f"""WITH {PAGES}, req AS (SELECT doc_id, n_pages, doc_id % 3 AS "first", doc_id % 4 AS n FROM counts)
SELECT p.doc_id, p.page_no - r."first" AS page_no, p.body FROM pages_in p JOIN req r USING (doc_id)
WHERE n >= 1 AND r."first" + n <= r.n_pages AND p.page_no > r."first" AND p.page_no <= r."first" + n""")
def subset(spark, d):
    requests = p.page_count(pages(spark, d)).select("doc_id", (F.col("doc_id") % 3).alias("first"), (F.col("doc_id") % 4).alias("count"))
    return p.subset(pages(spark, d), requests)[0].select("doc_id", "page_no", "body")


def _turns(spark, d) -> DataFrame:
    k, n = F.col("doc_id") % 6, F.col("n_pages")
    named = F.when(k == 0, longs(1)).when(k == 1, F.sequence(F.lit(1).cast("bigint"), n)).when(k == 2, longs(1, 1)).when(k == 3, F.array(n + 1))
    named = named.when(k == 4, longs(0)).otherwise(F.array(n))
    return p.page_count(pages(spark, d)).select("doc_id", named.alias("selected"), F.when(F.col("doc_id") % 5 == 0, 45).otherwise(F.col("doc_id") % 4 * 90 - 90).alias("degrees"))


TURN_RULE = """CASE WHEN doc_id % 5 = 0 THEN 'degrees' WHEN doc_id % 6 = 2 THEN 'named-twice' WHEN doc_id % 6 = 3 THEN 'past-end'
  WHEN doc_id % 6 = 4 THEN 'page-zero' END"""


@query(f"""WITH {PAGES}, req AS (SELECT *, {TURN_RULE} AS rule, doc_id % 4 * 90 - 90 AS degrees FROM counts)
SELECT p.doc_id, p.page_no, CAST(CASE WHEN r.doc_id % 6 = 1 OR (r.doc_id % 6 = 0 AND page_no = 1) OR (r.doc_id % 6 = 5 AND page_no = n_pages)
  THEN (coalesce(rotation, 0) + degrees + 360) % 360 ELSE rotation END AS BIGINT) AS rotation
FROM pages_in p JOIN req r USING (doc_id) WHERE rule IS NULL""")
def rotate(spark, d):
    return p.rotate(pages(spark, d), _turns(spark, d))[0].select("doc_id", "page_no", long("rotation").alias("rotation"))


@query(f"WITH {PAGES} SELECT doc_id, n_pages, {TURN_RULE} AS rule FROM counts")
def rotate_refusals(spark, d):
    return p.rotate(pages(spark, d), _turns(spark, d))[1].select("doc_id", "n_pages", rule(F.col("error")).alias("rule"))


@query(f"""WITH {PAGES} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_pages + 1 - page_no WHEN 1 THEN (page_no + n_pages - 2) % n_pages + 1 ELSE page_no END AS page_no,
  body FROM pages_in JOIN counts USING (doc_id) WHERE doc_id % 4 <> 3 OR n_pages < 2""")
def reorder(spark, d):
    n, k = F.col("n_pages"), F.col("doc_id") % 4
    every = F.sequence(F.lit(1).cast("bigint"), n)
    order = F.when(k == 0, F.reverse(every)).when(k == 1, F.concat(F.filter(every, lambda x: x > 1), longs(1))).when(k == 2, every)
    order = order.otherwise(F.transform(every, lambda x: F.lit(1).cast("bigint")))
    requests = p.page_count(pages(spark, d)).select("doc_id", order.alias("order"))
    return p.reorder(pages(spark, d), requests)[0].select("doc_id", "page_no", "body")


MERGE = f"""WITH {PAGES}, inputs AS (SELECT c.doc_id // 3 AS out_id, c.doc_id % 3 AS input_ord, c.doc_id, n_pages,
  (SELECT sum(strlen(body)) FROM pages_in q WHERE q.doc_id = c.doc_id) AS n_bytes FROM counts c),
totals AS (SELECT out_id, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, CAST(sum(n_pages) AS BIGINT) AS n_pages FROM inputs GROUP BY out_id),
placed AS (SELECT *, coalesce(sum(n_pages) OVER (PARTITION BY out_id ORDER BY input_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM inputs)"""


def _merge(spark, d):
    sizes = pages(spark, d).groupBy("doc_id").agg(F.sum(F.octet_length("body")).cast("bigint").alias("n_bytes"))
    inputs = sizes.select(F.floor(F.col("doc_id") / 3).cast("bigint").alias("out_id"), (F.col("doc_id") % 3).alias("input_ord"), "doc_id", "n_bytes")
    return p.merge(pages(spark, d), inputs, 6000)


@query(f"""{MERGE} SELECT out_id AS doc_id, CAST(before + page_no AS BIGINT) AS page_no, body FROM placed JOIN totals USING (out_id)
JOIN pages_in USING (doc_id) WHERE totals.n_bytes <= 6000""")
def merge(spark, d):
    return _merge(spark, d)[0].select("doc_id", "page_no", "body")


@query(f"""{MERGE} SELECT out_id AS doc_id, n_pages, CASE WHEN n_bytes > 6000 THEN 'input_size:max_input_bytes' END AS rule,
  CASE WHEN n_bytes > 6000 THEN n_bytes END AS requested FROM totals""")
def merge_budget(spark, d):
    return _merge(spark, d)[1].select("doc_id", "n_pages", rule(F.col("error")).alias("rule"), F.col("error.requested").alias("requested"))


@query("""SELECT doc_id, CASE WHEN made < strlen(text) THEN 'Smaller' ELSE 'NotSmaller' END AS outcome, least(made, strlen(text)) AS kept_bytes,
  made < strlen(text) AS verified FROM (SELECT doc_id, text, CAST(n_chars + doc_id % 40 - 20 AS BIGINT) AS made FROM documents)""")
def compress_choice(spark, d):
    docs = load(spark, d, "documents")
    chosen = p.compress_choice(long(F.octet_length("text")), F.col("n_chars") + F.col("doc_id") % 40 - 20)
    return docs.select("doc_id", chosen.alias("c")).select("doc_id", "c.*")


FIT = """WITH b AS (SELECT p_partkey, CAST(p_size * 12 AS DOUBLE) AS w, CAST((p_partkey % 60) * 13 AS DOUBLE) AS h FROM part),
s AS (SELECT *, least(256 / w, 384 / h) AS k FROM b WHERE w > 0 AND h > 0)"""


@query(f"""{FIT} SELECT b.p_partkey AS page, CASE WHEN k IS NOT NULL THEN CAST(least(round(greatest(s.w * k, 1)), 256) AS BIGINT) END AS width,
  CASE WHEN k IS NOT NULL THEN CAST(least(round(greatest(s.h * k, 1)), 384) AS BIGINT) END AS height, CASE WHEN k IS NULL THEN 'page-size' END AS rule FROM b LEFT JOIN s USING (p_partkey)""")
def render_fit(spark, d):
    w, h = (F.col("p_size") * 12).cast("double"), (F.col("p_partkey") % 60 * 13).cast("double")
    safe_w, safe_h = F.when(w > 0, w), F.when(h > 0, h)
    fit = g.fit_into(safe_w, safe_h, F.lit(256.0), F.lit(384.0))
    return load(spark, d, "part").select(
        F.col("p_partkey").alias("page"), fit["width"].alias("width"), fit["height"].alias("height"), rule(g.fit_error(w, h)).alias("rule")
    )


# 2.2: limits and gates


@query("""WITH s AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n, doc_id % 50 AS entries, n_chars * (doc_id % 3) AS longest, doc_id % 13 = 0 AS past FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n > 8000 THEN 'input_size' WHEN n + n // 4 + 16777216 > 16782000 THEN 'size_estimate' WHEN longest > n THEN 'stream-longer-than-file'
  WHEN past THEN 'entry-past-end' WHEN entries * 64 > 16782000 THEN 'prescan' END AS refusal,
  CASE WHEN n > 8000 THEN n WHEN n + n // 4 + 16777216 > 16782000 THEN n + n // 4 + 16777216 END AS requested FROM s""")
def open_gate(spark, d):
    docs = load(spark, d, "documents").where("text is not null")
    error = o.open_gate(
        long(F.octet_length("text")), F.col("doc_id") % 50, F.col("n_chars") * (F.col("doc_id") % 3), F.col("doc_id") % 13 == 0,
        {"max_input_bytes": 8000, "max_memory_bytes": 16_782_000},
    )
    e = docs.select("doc_id", error.alias("e"))
    return e.select("doc_id", F.coalesce("e.rule", "e.stage").alias("refusal"), F.when(F.col("e.kind") == "LimitExceeded", F.col("e.requested")).alias("requested"))


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'empty-raster' WHEN p_size % 10 * 1000 * (p_partkey % 30 + 1) * 900 > 100000000 THEN 'pixels:max_pixels'
  WHEN p_size % 10 * 1000 * (p_partkey % 30 + 1) * 900 > 89478485 THEN 'pixels:max_pixels' END AS rule, CASE WHEN p_size % 10 <> 0 AND p_size % 10 * 1000 * (p_partkey % 30 + 1) * 900 > 89478485
  THEN CAST(CASE WHEN p_size % 10 * 1000 * (p_partkey % 30 + 1) * 900 > 100000000 THEN 100000000 ELSE 89478485 END AS BIGINT) END AS allowed FROM part""")
def pixel_gates(spark, d):
    error = o.flatten_gate(F.col("p_size") % 10 * 1000, (F.col("p_partkey") % 30 + 1) * 900, 100_000_000)
    return load(spark, d, "part").select("p_partkey", error.alias("e")).select("p_partkey", rule(F.col("e")).alias("rule"), F.col("e.allowed").alias("allowed"))


@query("""SELECT c_custkey, greatest(c_custkey * 1000 - 5000, 0) AS grown, c_custkey * 1000 - 5000 > 500000 + 67108864 AS measured_refused,
  c_custkey * 1000 > least(65536 * (1 + c_nationkey) >> 1, 200000) OR c_nationkey * 20000 > least(65536 * (1 + c_nationkey) >> 1, 200000) AS recycled FROM customer""")
def memory_gates(spark, d):
    k = F.col("c_custkey")
    most = long(F.lit(65536) * (F.col("c_nationkey") + 1))
    return load(spark, d, "customer").select(
        "c_custkey", F.greatest(k * 1000 - 5000, F.lit(0).cast("bigint")).alias("grown"),
        o.measured_gate(F.lit(5000).cast("bigint"), k * 1000, 500_000).isNotNull().alias("measured_refused"),
        o.recycle(F.array(k * 1000, long(F.col("c_nationkey") * 20000)), most, 1, 200_000).alias("recycled"),
    )


@query("""WITH k AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS key FROM part)
SELECT p_partkey, key FROM k WHERE key NOT IN ('STANDARD', 'PROMO', 'BRASS', 'STEEL') GROUP BY p_partkey, key""")
def key_allow_list(spark, d):
    keys = load(spark, d, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("key"))
    allowed = spark.createDataFrame([("STANDARD",), ("PROMO",), ("BRASS",), ("STEEL",)], "key string")
    return keys.distinct().join(allowed, "key", "left_anti").select("p_partkey", "key")


# 2.4: page lists

SAMPLES = ("1-3, 5", " 2 , 2,1", "1,,3", "5-2", "0", "1-99", "x", "", "3-3,4-6", "1-2-3", "7, 3-5", "000000001", "2-, 3", "9 - 4,1")


def _typed(spark, d) -> DataFrame:
    typed = F.get(F.array(*map(F.lit, SAMPLES)), (F.col("p_partkey") % len(SAMPLES)).cast("int"))
    return load(spark, d, "part").select("p_partkey", typed.alias("typed"), long("p_size").alias("pages"))


TYPED = f"""typed AS (SELECT p_partkey, {list(SAMPLES)!r}[p_partkey % {len(SAMPLES)} + 1] AS typed, CAST(p_size AS BIGINT) AS pages FROM part)"""
BOUNDS = f"""{TYPED}, item AS (SELECT p_partkey, pages, i, trim(string_split(trim(typed), ',')[i]) AS item, typed FROM (SELECT *, unnest(range(1, len(string_split(trim(typed), ',')) + 1)) AS i FROM typed) q),
bound AS (SELECT *, list_transform(string_split(item, '-'), lambda x: trim(x)) AS b FROM item)"""


def _answered(df: DataFrame, answer: Column) -> DataFrame:
    done = df.select("p_partkey", answer.alias("a"))
    return done.select("p_partkey", F.col("a.problem").alias("problem"), F.concat_ws(",", F.col("a.pages").cast("array<string>")).alias("pages"))


@query(f"""WITH {BOUNDS},
num AS (SELECT *, len(list_filter(b, lambda x: NOT regexp_full_match(x, '[0-9]{{1,9}}'))) = 0 AS good FROM bound),
val AS (SELECT *, CASE WHEN good THEN CAST(b[1] AS BIGINT) END AS lo, CASE WHEN good THEN CAST(b[len(b)] AS BIGINT) END AS hi FROM num),
bad AS (SELECT *, CASE WHEN item = '' THEN 'empty-item' WHEN len(b) > 2 THEN 'not-a-range' WHEN NOT good THEN 'not-a-number' WHEN lo < 1 THEN 'before-first'
  WHEN lo > pages THEN 'past-end' WHEN hi < 1 THEN 'before-first' WHEN hi > pages THEN 'past-end' WHEN lo > hi THEN 'backwards' END AS problem FROM val),
one AS (SELECT p_partkey, CASE WHEN any_value(trim(typed)) = '' THEN 'empty' ELSE arg_min(problem, i) FILTER (problem IS NOT NULL) END AS problem FROM bad GROUP BY p_partkey),
listed AS (SELECT p_partkey, unnest(range(lo, hi + 1)) AS page FROM bad JOIN one o USING (p_partkey) WHERE o.problem IS NULL),
joined AS (SELECT p_partkey, string_agg(page, ',' ORDER BY page) AS pages FROM (SELECT DISTINCT * FROM listed) l GROUP BY p_partkey)
SELECT p_partkey, problem, coalesce(pages, '') AS pages FROM one LEFT JOIN joined USING (p_partkey)""")
def page_selection(spark, d):
    return _answered(df := _typed(spark, d), s.page_selection(F.col("typed"), F.col("pages")))


RANGED = f"""WITH {BOUNDS}, ok AS (SELECT *, regexp_full_match(item, '[0-9]+(\\s*-\\s*[0-9]+)?') AS good FROM bound WHERE item <> ''),
val AS (SELECT *, CASE WHEN good THEN CAST(b[1] AS BIGINT) END AS lo, CASE WHEN good THEN CAST(b[len(b)] AS BIGINT) END AS hi FROM ok)"""


@query(f"""{RANGED}, own AS (SELECT *, CASE WHEN NOT good THEN 'not-a-number' WHEN lo < 1 OR hi < 1 THEN 'before-first' WHEN lo >= pages OR hi >= pages THEN 'past-end'
  WHEN hi < lo THEN 'backwards' END AS problem, coalesce(lag(hi) OVER (PARTITION BY p_partkey ORDER BY i), 0) AS last FROM val),
bad AS (SELECT *, coalesce(problem, CASE WHEN lo = last THEN 'twice' WHEN lo < last THEN 'out-of-order' END) AS p FROM own),
one AS (SELECT p_partkey, arg_min(p, i) FILTER (p IS NOT NULL) AS problem FROM bad GROUP BY p_partkey),
joined AS (SELECT p_partkey, string_agg(page, ',' ORDER BY page) AS pages FROM (SELECT p_partkey, unnest(range(lo, hi + 1)) AS page FROM bad JOIN one o USING (p_partkey) WHERE o.problem IS NULL) l GROUP BY p_partkey)
SELECT t.p_partkey, problem, coalesce(j.pages, '') AS pages FROM typed t LEFT JOIN one USING (p_partkey) LEFT JOIN joined j USING (p_partkey)""")
def cut_list(spark, d):
    return _answered(_typed(spark, d), s.cut_list(F.col("typed"), F.col("pages")))


@query(f"""{RANGED}, own AS (SELECT *, CASE WHEN NOT good THEN 'not-a-number' WHEN lo < 1 OR hi < 1 THEN 'before-first' WHEN lo > pages OR hi > pages THEN 'past-end' END AS problem FROM val),
one AS (SELECT p_partkey, arg_min(problem, i) FILTER (problem IS NOT NULL) AS problem FROM own GROUP BY p_partkey),
named AS (SELECT p_partkey, i, unnest(CASE WHEN lo <= hi THEN range(lo, hi + 1) ELSE range(lo, hi - 1, -1) END) AS page, lo <= hi AS up FROM own JOIN one o USING (p_partkey) WHERE o.problem IS NULL),
ranked AS (SELECT p_partkey, page, row_number() OVER (PARTITION BY p_partkey ORDER BY i, CASE WHEN up THEN page ELSE -page END) AS at FROM named),
twice AS (SELECT p_partkey FROM ranked GROUP BY p_partkey HAVING count(*) > count(DISTINCT page)),
every AS (SELECT p_partkey, unnest(range(1, pages + 1)) AS page FROM typed),
whole AS (SELECT e.p_partkey, string_agg(e.page, ',' ORDER BY coalesce(r.at, 1000000 + e.page)) AS pages FROM every e LEFT JOIN ranked r USING (p_partkey, page)
  WHERE e.p_partkey NOT IN (SELECT * FROM twice) GROUP BY e.p_partkey)
SELECT t.p_partkey, CASE WHEN w.p_partkey IS NOT NULL THEN 'twice' ELSE problem END AS problem, CASE WHEN problem IS NULL THEN coalesce(whole.pages, '') ELSE '' END AS pages
FROM typed t LEFT JOIN one USING (p_partkey) LEFT JOIN twice w USING (p_partkey) LEFT JOIN whole USING (p_partkey)""")
def order_list(spark, d):
    return _answered(_typed(spark, d), s.order_list(F.col("typed"), F.col("pages")))


@query("""SELECT p_partkey, CASE WHEN p_size >= 3 THEN '1-' || (p_size - 1) ELSE '1' END AS typed, CAST(greatest(p_size, 2) AS BIGINT) AS n_parts,
  p_size % 2 = 0 OR p_size = 1 AS unchanged FROM part""")
def every_page_cuts(spark, d):
    n = long(F.greatest(F.col("p_size"), F.lit(2)))
    every = F.sequence(F.lit(1).cast("bigint"), long("p_size"))
    order = F.when(F.col("p_size") % 2 == 0, every).otherwise(F.reverse(every))
    cuts = s.cut_list(s.every_page_cuts(long("p_size")), n)["pages"]
    return load(spark, d, "part").select(
        "p_partkey", s.every_page_cuts(F.col("p_size")).alias("typed"), long(F.size(s.parts_from(cuts, n))).alias("n_parts"), s.is_unchanged(order).alias("unchanged")
    )


# 2.5: trees and graphs


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey >= 2 THEN p_partkey // 2 END AS parent,
  CASE WHEN p_partkey % 5 = 0 OR p_partkey = 1 AND false THEN p_partkey % 4 * 90 END AS rotate FROM part),
w AS (SELECT node, node AS at, parent AS up, rotate AS value, 0 AS levels FROM n
  UNION ALL SELECT w.node, n.node, n.parent, n.rotate, levels + 1 FROM w JOIN n ON n.node = w.up WHERE w.value IS NULL)
SELECT node, CAST(arg_max(value, levels) AS BIGINT) AS rotation, coalesce(CAST(arg_max(value, levels) AS BIGINT), 0) AS effective,
  CAST(max(levels) AS BIGINT) + CASE WHEN max(CASE WHEN up IS NOT NULL AND value IS NULL AND up NOT IN (SELECT node FROM n) THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END AS levels FROM w GROUP BY node""")
def inherited_rotation(spark, d):
    k = F.col("p_partkey")
    nodes = load(spark, d, "part").select(
        F.lit(0).alias("doc_id"), k.alias("node"), F.when(k >= 2, F.floor(k / 2)).cast("bigint").alias("parent"),
        F.when(k % 5 == 0, k % 4 * 90).alias("rotate"),
    )
    found = trees.inherited(nodes, "rotate")
    return found.select("node", F.col("value").cast("bigint").alias("rotation"), F.coalesce("value", F.lit(0)).cast("bigint").alias("effective"), long("levels").alias("levels"))


@query("""WITH a AS (SELECT o_custkey % 50 AS doc_id, o_orderkey AS page_no, o_custkey % 4 AS num, 0 AS gen FROM orders),
s AS (SELECT doc_id, num, gen, count(DISTINCT page_no) AS n FROM a WHERE NOT (num = 0 AND gen = 0) GROUP BY ALL)
SELECT a.doc_id, a.page_no, s.n - 1 AS n_shared FROM a JOIN s USING (doc_id, num, gen) WHERE s.n > 1""")
def shared_arrays(spark, d):
    orders = load(spark, d, "orders")
    rows = orders.select((F.col("o_custkey") % 50).alias("doc_id"), F.col("o_orderkey").alias("page_no"), (F.col("o_custkey") % 4).alias("num"), F.lit(0).alias("gen"))
    return trees.shared_arrays(rows).select("doc_id", "page_no", (F.col("n_pages") - 1).alias("n_shared"))


RESOURCES = """res AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page_no, l_suppkey % 3 AS num, 0 AS gen,
  ['Font', 'XObject', 'ExtGState', 'ProcSet', 'Odd'][l_partkey % 5 + 1] AS category, 'N' || (l_partkey % 20) AS name FROM lineitem),
used AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page_no, 'N' || (l_suppkey % 20) AS name FROM lineitem)"""


@query(f"""WITH {RESOURCES}, r AS (SELECT DISTINCT * FROM res),
wanted AS (SELECT DISTINCT r.doc_id, num, gen, u.name FROM r JOIN used u USING (doc_id, page_no))
SELECT doc_id, page_no, num, category, name FROM r WHERE category IN ('ExtGState', 'ProcSet')
UNION ALL SELECT doc_id, page_no, num, category, name FROM r SEMI JOIN wanted USING (doc_id, num, gen, name) WHERE category IN ('Font', 'XObject')""")
def pruned_resources(spark, d):
    items = load(spark, d, "lineitem")
    page = [F.col("l_orderkey").alias("doc_id"), long("l_linenumber").alias("page_no")]
    category = F.get(F.array(*map(F.lit, ("Font", "XObject", "ExtGState", "ProcSet", "Odd"))), (F.col("l_partkey") % 5).cast("int"))
    res = items.select(*page, (F.col("l_suppkey") % 3).alias("num"), F.lit(0).alias("gen"), category.alias("category"), F.concat(F.lit("N"), F.col("l_partkey") % 20).alias("name"))
    used = items.select(*page, F.concat(F.lit("N"), F.col("l_suppkey") % 20).alias("name"))
    return trees.pruned_resources(res.distinct(), used, ["Font", "XObject", "ExtGState"]).select("doc_id", "page_no", "num", "category", "name")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS src, (s_suppkey * 7 + 3) % 20 AS dst FROM supplier UNION ALL SELECT s_suppkey, (s_suppkey + 40) % 91 FROM supplier WHERE s_suppkey % 9 = 0),
c AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 5000 UNION SELECT dst FROM c JOIN e ON e.src = c.node) SELECT node FROM c""")
def annotation_dependents(spark, d):
    k = F.col("s_suppkey")
    sup = load(spark, d, "supplier")
    a = sup.select(F.lit(0).alias("doc_id"), k.alias("src"), ((k * 7 + 3) % 20).alias("dst"))
    b = sup.where(k % 9 == 0).select(F.lit(0).alias("doc_id"), k.alias("src"), ((k + 40) % 91).alias("dst"))
    return trees.closure(sup.where("s_acctbal < 5000").select(F.lit(0).alias("doc_id"), k.alias("node")), a.union(b)).select("node")


@query("""WITH removed AS (SELECT s_suppkey AS node FROM supplier WHERE s_suppkey % 5 = 0), e AS (SELECT s_suppkey AS src, (s_suppkey * 7 + 3) % 97 AS dst FROM supplier)
SELECT src, dst FROM e WHERE src NOT IN (SELECT node FROM removed) AND dst IN (SELECT node FROM removed)""")
def kept_dependents(spark, d):
    k = F.col("s_suppkey")
    sup = load(spark, d, "supplier").select(F.lit(0).alias("doc_id"), k.alias("annotation"), ((k * 7 + 3) % 97).alias("dst"))
    links = sup.select("doc_id", F.col("annotation").alias("src"), "dst")
    removed = sup.where("annotation % 5 = 0").select("doc_id", F.col("annotation").alias("node"))
    return trees.kept_dependents(sup.select("doc_id", "annotation"), links, removed).select("src", "dst")


@query("""WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_nationkey + 1 AS BIGINT) AS dst, 1 AS refs FROM nation WHERE n_nationkey % 8 <> 7 AND n_nationkey < 24
  UNION ALL SELECT n_nationkey, n_nationkey + 3, 2 FROM nation WHERE n_nationkey % 8 < 4 AND n_nationkey < 22 AND n_nationkey % 2 = 0),
w AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(CASE WHEN n_nationkey % 6 = 0 THEN 1 ELSE 0 END AS HUGEINT) AS uses FROM nation WHERE n_nationkey % 6 = 0
  UNION ALL SELECT e.dst, uses * refs FROM w JOIN e ON e.src = w.node)
SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(coalesce(sum(uses), 0) AS BIGINT) AS uses, true AS settled FROM nation LEFT JOIN w ON w.node = n_nationkey GROUP BY n_nationkey""")
def form_uses(spark, d):
    nation = load(spark, d, "nation").select(F.lit(0).alias("doc_id"), long("n_nationkey").alias("k"))
    base = nation.select("doc_id", F.col("k").alias("node"), F.when(F.col("k") % 6 == 0, 1).otherwise(0).cast("bigint").alias("uses"))
    one = nation.where("k % 8 <> 7 and k < 24").select("doc_id", F.col("k").alias("src"), (F.col("k") + 1).alias("dst"), F.lit(1).alias("refs"))
    two = nation.where("k % 8 < 4 and k < 22 and k % 2 = 0").select("doc_id", F.col("k").alias("src"), (F.col("k") + 3).alias("dst"), F.lit(2).alias("refs"))
    return trees.use_counts(base, one.union(two)).select("node", "uses", "settled")


@query("""WITH refs AS (SELECT l_orderkey AS src, l_partkey AS num FROM lineitem), decl AS (SELECT p_partkey AS num, p_size <= 5 AS nulled, p_partkey % 2 = 0 AS streamed FROM part WHERE p_partkey % 10 <> 0)
SELECT src, num, CASE WHEN d.num IS NULL THEN 'dangling-reference' ELSE 'null-in-object-stream' END AS rule FROM refs LEFT JOIN decl d USING (num) WHERE d.num IS NULL OR nulled AND streamed""")
def dangling_references(spark, d):
    edges = load(spark, d, "lineitem").select(F.lit(0).alias("doc_id"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("num"), F.lit(0).alias("gen"))
    declared = load(spark, d, "part").where("p_partkey % 10 <> 0").select(
        F.lit(0).alias("doc_id"), F.col("p_partkey").alias("num"), F.lit(0).alias("gen"), F.when(F.col("p_size") <= 5, "null").otherwise("dict").alias("kind"), (F.col("p_partkey") % 2 == 0).alias("in_stream")
    )
    return trees.dangling(edges, declared).select("src", "num", F.col("error.rule").alias("rule"))


@query("""SELECT l_partkey AS num, count(*) AS sites, count(*) FILTER (l_returnflag = 'A') AS held, count(*) FILTER (l_returnflag = 'R') AS dest_entries FROM lineitem GROUP BY 1""")
def referrers(spark, d):
    site = F.when(F.col("l_returnflag") == "A", "held").when(F.col("l_returnflag") == "R", "dest").otherwise("value")
    edges = load(spark, d, "lineitem").select(F.lit(0).alias("doc_id"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("num"), site.alias("site"))
    return trees.referrers(edges).select("num", "sites", "held", "dest_entries")


@query(f"""WITH {GLYPHS}, form AS (SELECT o_custkey % 9 + 1 AS page_no, o_orderkey % 5 AS form FROM orders GROUP BY ALL), held AS (SELECT n_nationkey % 5 AS form, 'F' || n_nationkey AS font FROM nation),
fp AS (SELECT font, page_no FROM glyphs UNION SELECT font, page_no FROM form JOIN held USING (form)), part_of AS (SELECT DISTINCT font, 'P' || CAST(substr(font, 2) AS INTEGER) % 4 AS part FROM glyphs)
SELECT part, count(DISTINCT page_no) AS n_pages, count(DISTINCT page_no) FILTER (page_no > 2) AS outside, count(DISTINCT page_no) FILTER (page_no > 7) = 0 AS within FROM fp JOIN part_of USING (font) GROUP BY part""")
def font_parts(spark, d):
    fonts = glyphs(spark, d).select(F.lit(0).alias("doc_id"), "page_no", "font")
    forms = load(spark, d, "orders").select(F.lit(0).alias("doc_id"), (F.col("o_custkey") % 9 + 1).alias("page_no"), (F.col("o_orderkey") % 5).alias("form")).distinct()
    held = load(spark, d, "nation").select(F.lit(0).alias("doc_id"), (F.col("n_nationkey") % 5).cast("bigint").alias("form"), F.concat(F.lit("F"), F.col("n_nationkey").cast("string")).alias("font"))
    on_pages = trees.fonts_on_pages(forms, held, fonts)
    parts = fonts.select("doc_id", "font", F.concat(F.lit("P"), F.substring("font", 2, 9).cast("int") % 4).alias("part")).distinct()
    found = trees.parts_on_pages(parts, on_pages)
    return found.select("part", long(F.size("pages")).alias("n_pages"), long(trees.pages_outside(F.col("pages"), longs(1, 2))).alias("outside"), trees.wholly_within(F.col("pages"), longs(1, 2, 3, 4, 5, 6, 7)).alias("within"))


@query("""WITH a AS (SELECT o_orderkey AS annotation, o_custkey % 3 = 0 AS ambiguous, o_orderkey % 20 AS page_no, o_custkey % 25 AS owner, o_custkey % 30 AS dest,
  CASE WHEN o_orderkey % 4 = 0 THEN 'u' END AS uri, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 30 END AS goto_, CASE WHEN o_orderkey % 7 = 0 THEN 'n' END AS next FROM orders)
SELECT annotation, dest < 20 AS keeps_dest, next IS NULL AND (uri IS NOT NULL OR coalesce(goto_ < 20, false)) AS keeps_action FROM a WHERE NOT ambiguous OR owner < 20""")
def pruned_annotations(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = load(spark, d, "orders").select(
        F.lit(0).cast("bigint").alias("doc_id"), k.alias("annotation"), (c % 3 == 0).alias("ambiguous"), (k % 20).alias("page_no"), (c % 25).alias("owner"), (c % 30).alias("dest"),
        F.when(k % 4 == 0, "u").alias("uri"), F.when(k % 4 == 1, k % 30).alias("goto"), F.when(k % 7 == 0, "n").alias("next"),
    )
    output = spark.range(20).select(F.lit(0).cast("bigint").alias("doc_id"), F.col("id").alias("page_no"))
    return trees.pruned_annotations(rows, output).select("annotation", "keeps_dest", "keeps_action")


# 2.6: text


@query(r"""SELECT p_partkey, '(' || replace(replace(replace(p_name || chr(10) || '(' || p_type || '\', '\', '\\'), '(', '\('), chr(10), '\n') || ')' AS literal, upper(hex('A' || p_name)) AS hexed FROM part""")
def literals(spark, d):
    raw = F.concat("p_name", F.lit("\n("), "p_type", F.lit("\\"))
    token = F.concat(F.lit("<"), F.lower(F.hex(F.concat(F.lit("A"), "p_name"))), F.lit(">"))
    return load(spark, d, "part").select("p_partkey", t.encode_literal(raw).alias("literal"), F.hex(t.decode_hex(token)).alias("hexed"))


@query(r"""SELECT page_id, n_tags, names FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '<[a-z0-9]+')) AS BIGINT) AS n_tags,
  array_to_string(list_sort(list_distinct(regexp_extract_all(html, '/([^\s()<>\[\]{}/%]+)', 1))), ' ') AS names FROM pages WHERE html IS NOT NULL)""")
def content_names(spark, d):
    return load(spark, d, "pages").where("html is not null").select(
        "page_id", long(F.size(F.regexp_extract_all("html", F.lit("<[a-z0-9]+"), F.lit(0)))).alias("n_tags"), F.array_join(t.names_in(F.col("html")), " ").alias("names")
    )


@query("""SELECT conv_id, turn, substr(text, 1, 2) || '[a]' || substr(text, 5, 4) || '' || substr(text, 12) AS edited FROM conversations WHERE length(text) >= 20""")
def applied_edits(spark, d):
    edits = F.expr("array(named_struct('start', 8, 'end', 11, 'text', ''), named_struct('start', 2, 'end', 4, 'text', '[a]'))")
    rows = load(spark, d, "conversations").where("length(text) >= 20")
    good = rows.withColumn("_e", t.edits_error(F.col("text"), edits)).where("_e is null")
    return good.select("conv_id", "turn", t.apply_edits(F.col("text"), edits).alias("edited"))


@query("""WITH c AS (SELECT conv_id, turn, strlen(text) AS n, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations),
w AS (SELECT conv_id, unnest(range(0, total, 137)) AS pos FROM (SELECT conv_id, CAST(sum(n + 1) AS BIGINT) AS total FROM c GROUP BY conv_id) q)
SELECT w.conv_id, w.pos AS "offset", max(c.turn) AS part, CAST(w.pos - max(c.start) AS BIGINT) AS local FROM w JOIN c ON c.conv_id = w.conv_id AND c.start <= w.pos GROUP BY w.conv_id, w.pos""")
def located_offsets(spark, d):
    parts = load(spark, d, "conversations")
    total = parts.groupBy("conv_id").agg(F.sum(F.octet_length("text") + 1).cast("bigint").alias("total"))
    wanted = total.select("conv_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, F.lit(137).cast("bigint"))).alias("offset"))
    return t.located(wanted, parts, "conv_id", "turn", F.octet_length("text")).select("conv_id", "offset", "part", long("local").alias("local"))


@query("""SELECT b.item_id, count(d.doc_id) AS found FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text)
  OR contains(d.text, upper(hex(b.text))) GROUP BY b.item_id""")
def canary_search(spark, d):
    needles = load(spark, d, "benchmark").select("item_id", F.col("text").alias("needle"))
    return t.canary_hits(load(spark, d, "documents"), needles, "item_id")


@query("""WITH px AS (SELECT l_suppkey % 5 AS image, l_partkey % 40 AS x, l_orderkey % 40 AS y, l_partkey % 256 AS r, l_suppkey * 3 % 256 AS g, l_orderkey % 256 AS b FROM lineitem)
SELECT image, CAST(y * 4 // 40 * 4 + x * 4 // 40 AS BIGINT) AS cell, CAST(CASE WHEN sum(r + g + b) // (3 * count(*)) <= 63 THEN 3 WHEN sum(r + g + b) // (3 * count(*)) <= 127 THEN 2
  WHEN sum(r + g + b) // (3 * count(*)) <= 191 THEN 1 ELSE 0 END AS BIGINT) AS level FROM px GROUP BY 1, 2""")
def ink_grid(spark, d):
    k, c, o_ = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    px = load(spark, d, "lineitem").select((c % 5).alias("image"), (k % 40).alias("x"), (o_ % 40).alias("y"), (k % 256).alias("r"), (c * 3 % 256).alias("g"), (o_ % 256).alias("b"))
    return t.ink_grid(px, F.lit(40), F.lit(40)).select("image", long("cell").alias("cell"), long("level").alias("level"))


# 2.7: geometry and redaction


@query(f"""WITH {GLYPHS}, {REGIONS} SELECT g.* FROM glyphs g SEMI JOIN regions r ON g.doc_id = r.doc_id AND g.page_no = r.page_no AND {HIT}""")
def selected_glyphs(spark, d):
    return r.selected_glyphs(glyphs(spark, d), regions(spark, d))


@query(f"""WITH {GLYPHS}, {REGIONS} SELECT DISTINCT g.doc_id, g.page_no FROM glyphs g JOIN regions r USING (doc_id, page_no) WHERE g.glyph_ord % 50 = 0 OR {HIT}""")
def ink_refusals(spark, d):
    cols = [F.when(F.col("glyph_ord") % 50 != 0, F.col(c)).alias(c) for c in g.SIDES]
    return r.ink_refusals(glyphs(spark, d).select("doc_id", "page_no", *cols), regions(spark, d)).select("doc_id", "page_no")


@query(f"""WITH {GLYPHS}, {REGIONS}, cut AS (SELECT DISTINCT doc_id, page_no, glyph_ord FROM glyphs g JOIN regions r USING (doc_id, page_no) WHERE {HIT})
SELECT DISTINCT doc_id, font, code FROM glyphs WHERE (doc_id, page_no, glyph_ord) NOT IN (SELECT (doc_id, page_no, glyph_ord) FROM cut)""")
def codes_still_drawn(spark, d):
    all_ = glyphs(spark, d)
    return r.codes_still_drawn(all_, r.selected_glyphs(all_, regions(spark, d)))


@query(f"""WITH {GLYPHS}, {REGIONS} SELECT g.doc_id, g.page_no AS stream_id, g.op_ord, count(DISTINCT g.glyph_ord) AS n_codes FROM glyphs g JOIN regions r USING (doc_id, page_no) WHERE {HIT} GROUP BY ALL""")
def cuts_by_operation(spark, d):
    all_ = glyphs(spark, d)
    cut = r.selected_glyphs(all_, regions(spark, d)).withColumnRenamed("page_no", "stream_id")
    done = r.cuts_by_operation(cut, all_.withColumnRenamed("page_no", "stream_id")).where("error is null")
    return done.select("doc_id", "stream_id", "op_ord", long(F.size("codes")).alias("n_codes"))


DEPTH = f"""WITH {OPERATIONS}, s AS (SELECT *, CASE WHEN operator IN ('BDC', 'BMC') THEN 1 WHEN operator = 'EMC' THEN -1 ELSE 0 END AS step FROM operations),
a AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, stream_id ORDER BY op_ord) AS total FROM s),
c AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY doc_id, stream_id ORDER BY op_ord)) AS after FROM a),
deep AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY doc_id, stream_id ORDER BY op_ord), 0) AS depth FROM c)"""


@query(f"{DEPTH} SELECT doc_id, stream_id, op_ord, CAST(depth AS BIGINT) AS depth FROM deep")
def marked_depth(spark, d):
    return r.marked_depth(operations(spark, d)).select("doc_id", "stream_id", "op_ord", "depth")


@query(f"{DEPTH} SELECT doc_id, stream_id, CAST(sum(depth) AS BIGINT) AS work FROM deep GROUP BY ALL")
def marked_work(spark, d):
    return r.marked_work(operations(spark, d)).select("doc_id", "stream_id", long("work").alias("work"))


@query(f"""{DEPTH}, span AS (SELECT b.doc_id, b.stream_id, b.op_ord AS "first", min(e.op_ord) AS "last" FROM deep b LEFT JOIN deep e ON e.doc_id = b.doc_id AND e.stream_id = b.stream_id AND e.op_ord > b.op_ord AND e.operator = 'EMC' AND e.depth = b.depth + 1
  WHERE b.operator IN ('BDC', 'BMC') GROUP BY ALL)
SELECT DISTINCT s.* FROM span s JOIN operations o ON o.doc_id = s.doc_id AND o.stream_id = s.stream_id AND o.operator = 'Do' AND o.op_ord % 5 = 0 AND o.op_ord > s."first" AND (s."last" IS NULL OR o.op_ord < s."last")""")
def carried_text(spark, d):
    ops = operations(spark, d)
    return r.carried_text(r.marked_spans(ops), ops.where("operator = 'Do' and op_ord % 5 = 0"))


@query(f"""WITH {OPERATIONS} SELECT doc_id, op_ord, operator, CASE WHEN operator = 'EMC' THEN 'unknown-operator' ELSE 'too-few-operands' END AS rule FROM operations
WHERE operator = 'EMC' OR n_operands < CASE operator WHEN 'BDC' THEN 2 WHEN 'BMC' THEN 1 WHEN 'Tj' THEN 1 WHEN 'Do' THEN 1 END""")
def unknown_operators(spark, d):
    known = spark.createDataFrame([("BDC", 2), ("BMC", 1), ("Tj", 1), ("Do", 1)], "operator string, arity int")
    return r.unknown_operators(operations(spark, d), known).select("doc_id", "op_ord", "operator", F.col("error.rule").alias("rule"))


@query(f"""WITH {OPERATIONS}, u AS (SELECT doc_id, stream_id, count(*) AS uses FROM operations WHERE operator = 'Do' GROUP BY ALL),
cut AS (SELECT DISTINCT doc_id, stream_id FROM operations WHERE operator = 'Tj') SELECT doc_id, stream_id FROM u SEMI JOIN cut USING (doc_id, stream_id) WHERE uses > 1""")
def sharing_refusals(spark, d):
    ops = operations(spark, d)
    uses = ops.where("operator = 'Do'").groupBy("doc_id", "stream_id").agg(F.count("*").alias("uses"))
    return r.sharing_refusals(ops.where("operator = 'Tj'"), uses).select("doc_id", "stream_id")


@query("""WITH f AS (SELECT o_orderkey, o_custkey % 4 * 90 AS rotate, o_custkey % 50 AS bl, o_orderkey % 70 AS bb, CAST(600 AS BIGINT) AS w, CAST(800 AS BIGINT) AS h, o_custkey % 300 AS l, o_orderkey % 200 AS t, o_custkey % 90 - 5 AS rw, CAST(40 AS BIGINT) AS rh FROM orders),
e AS (SELECT *, CASE WHEN rotate IN (90, 270) THEN h ELSE w END AS dw, CASE WHEN rotate IN (90, 270) THEN w ELSE h END AS dh, CASE WHEN rw <= 0 THEN 'region-extent' END AS rule FROM f)
SELECT o_orderkey, rule,
 CAST(CASE WHEN rule IS NULL THEN bl + CASE rotate WHEN 0 THEN l WHEN 90 THEN t WHEN 180 THEN dw - l - rw ELSE dh - t - rh END END AS DOUBLE) AS "left",
 CAST(CASE WHEN rule IS NULL THEN bb + CASE rotate WHEN 0 THEN dh - t - rh WHEN 90 THEN l WHEN 180 THEN t ELSE dw - l - rw END END AS DOUBLE) AS bottom,
 CAST(CASE WHEN rule IS NULL THEN bl + CASE rotate WHEN 0 THEN l + rw WHEN 90 THEN t + rh WHEN 180 THEN dw - l ELSE dh - t END END AS DOUBLE) AS "right",
 CAST(CASE WHEN rule IS NULL THEN bb + CASE rotate WHEN 0 THEN dh - t WHEN 90 THEN l + rw WHEN 180 THEN t + rh ELSE dw - l END END AS DOUBLE) AS top FROM e""")
def region_to_content(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    box = g.rect(c % 50, k % 70, c % 50 + 600, k % 70 + 800)
    args = [(c % 300).cast("double"), (k % 200).cast("double"), (c % 90 - 5).cast("double"), F.lit(40.0), box, c % 4 * 90]
    rows = load(spark, d, "orders").select("o_orderkey", g.region_error(*args).alias("e"), g.region_to_content(*args).alias("r"))
    return rows.select("o_orderkey", F.col("e.rule").alias("rule"), *(F.when(F.col("e").isNull(), F.col(f"r.{s_}")).alias(s_) for s_ in g.SIDES))


@query("""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 100 END AS cl, c_custkey % 11 = 0 AS crop_up, c_nationkey = 3 AS no_media, c_custkey % 13 = 0 AS rot_up,
  CASE WHEN c_custkey % 17 = 0 THEN 45.5 ELSE 90.0 * (c_custkey % 4) END AS rot, CASE WHEN c_custkey % 19 = 0 THEN 2.0 ELSE 1.0 END AS unit FROM customer)
SELECT c_custkey, CASE WHEN cl IS NOT NULL AND crop_up THEN 'page-attribute-inherited' WHEN no_media THEN 'no-display-box' WHEN cl >= 90 THEN 'unreadable-box' WHEN rot_up THEN 'page-attribute-inherited'
  WHEN rot <> floor(rot) THEN 'rotate-not-whole' WHEN unit <> 1 THEN 'user-unit-not-one' END AS rule FROM x""")
def page_frames(spark, d):
    k = F.col("c_custkey")
    crop = F.when(k % 3 != 0, g.rect(k % 100, F.lit(0), F.lit(200), F.lit(300)))
    media = F.when(F.col("c_nationkey") != 3, g.rect(F.lit(0), F.lit(0), F.lit(90), F.lit(300)))
    turn = F.when(k % 17 == 0, 45.5).otherwise(90.0 * (k % 4))
    error = g.frame_error(crop, k % 11 == 0, media, turn, k % 13 == 0, F.when(k % 19 == 0, 2.0).otherwise(1.0))
    return load(spark, d, "customer").select("c_custkey", error["rule"].alias("rule"))


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey % 300 AS a, l_suppkey % 200 AS b, l_partkey % 90 AS w, l_suppkey % 80 AS h FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, a, b, a < 180 AND 100 < a + w AND b < 150 AND 50 < b + h AS meets, 100 <= a AND a + w <= 180 AND 50 <= b AND b + h <= 150 AS inside,
  CAST(least(a * 2 + 7, (a + w) * 2 + 7) AS DOUBLE) AS moved_left, CAST(greatest(-b, -(b + h)) + 5 AS DOUBLE) AS moved_top,
  CASE WHEN greatest(a - 2, 0) < least(a + w + 2, 250) AND greatest(b - 2, 0) < least(b + h + 2, 180) THEN least(a + w + 2, 250) - greatest(a - 2, 0) END AS painted, ceil(w * 150 / 72.0)::BIGINT AS pixels FROM q""")
def rectangles(spark, d):
    a, b, w, h = F.col("l_partkey") % 300, F.col("l_suppkey") % 200, F.col("l_partkey") % 90, F.col("l_suppkey") % 80
    box, other = g.rect(a, b, a + w, b + h), g.rect(F.lit(100), F.lit(50), F.lit(180), F.lit(150))
    moved = g.transformed(box, g.compose(g.matrix(2, 0, 0, 1, 0, 0), g.matrix(1, 0, 0, -1, 7, 5)))
    corners = [(x.cast("double"), y.cast("double")) for x in (a, a + w) for y in (b, b + h)]
    paint = g.paint_rectangle(corners, F.lit(250), F.lit(180))
    return load(spark, d, "lineitem").select(
        "l_orderkey", long("l_linenumber").alias("line"), a.alias("a"), b.alias("b"), g.intersects(box, other).alias("meets"), g.contains(other, box).alias("inside"),
        moved["left"].alias("moved_left"), moved["top"].alias("moved_top"), (paint["right"] - paint["left"]).alias("painted"), g.pixels_at_dpi(w).alias("pixels"),
    )


@query("""WITH c AS (SELECT user_id AS doc_id, event_id AS k FROM events),
m AS (SELECT doc_id, k, (CAST(k % 512 AS DOUBLE) * 8 + 1 + CASE WHEN k % 6 = 0 THEN 3 ELSE 0 END) * 2 - CAST(k % 64 AS DOUBLE) * 1000 / 1000 * 8 * 2 AS move FROM c)
SELECT doc_id, k AS "at", coalesce(sum(move) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM m""")
def shown_text(spark, d):
    at = F.col("event_id")
    move = g.shown_width((at % 512).cast("double"), F.lit(8.0), F.lit(1.0), F.lit(3.0), F.lit(2.0), at % 6 == 0) + g.adjusted((at % 64).cast("double") * 1000, F.lit(8.0), F.lit(2.0))
    rows = load(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.lit(0).alias("stream_id"), F.lit(0).alias("run"), at.alias("at"), move.alias("move"))
    return r.shown_positions(rows).select("doc_id", "at", "x")


# 2.8: verification


@query(f"""WITH {PAGES} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'document' WHEN doc_id % 5 = 1 THEN 'page-count' WHEN doc_id % 5 = 2 THEN 'rotations' ELSE 'contents' END AS rule FROM counts
WHERE doc_id % 5 <> 4 AND (doc_id % 5 <> 1 OR n_pages >= 2)
UNION ALL SELECT doc_id, 'document' FROM counts WHERE doc_id % 5 = 1 AND n_pages < 2""")
def broken_promises(spark, d):
    promised = pages(spark, d)
    k = F.col("doc_id") % 5
    written = promised.where((k != 0) & ((k != 1) | (F.col("page_no") != 1))).withColumns(
        {
            "rotation": F.when(k == 2, F.coalesce("rotation", F.lit(0)) + 90).otherwise(F.col("rotation")).cast("int"),
            "body": F.when(k == 3, F.concat("body", F.lit("!"))).otherwise(F.col("body")),
        }
    )
    return v.broken_promises(v.page_promise(promised), v.page_promise(written)).select("doc_id", F.col("error.rule").alias("rule"))


@query("""WITH e AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 7 <> 0 THEN o_orderstatus END AS want FROM orders WHERE o_orderkey % 11 <> 0),
f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'X' WHEN o_custkey % 7 <> 0 THEN o_orderstatus END AS got FROM orders WHERE o_orderkey % 13 <> 0),
n AS (SELECT k, any_value(got) AS got, any_value(got IS NULL) AS isnull, count(*) AS n FROM f GROUP BY k), w AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 9 = 0)
SELECT k, verdict FROM (SELECT coalesce(e.k, n.k, w.k) AS k, CASE WHEN n.n > 1 THEN 'duplicate' WHEN e.k IS NULL AND n.k IS NULL THEN 'stale-waiver' WHEN n.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected'
  WHEN want IS DISTINCT FROM got AND w.k IS NOT NULL THEN 'waived' WHEN want IS DISTINCT FROM got THEN 'different' WHEN w.k IS NOT NULL THEN 'stale-waiver' END AS verdict
FROM e FULL JOIN n ON n.k = e.k FULL JOIN w ON w.k = coalesce(e.k, n.k)) q WHERE verdict IS NOT NULL""")
def differential_compare(spark, d):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderstatus"))
    orders = load(spark, d, "orders")
    expected = orders.where(k % 11 != 0).select(k.alias("k"), status.alias("v"))
    found = orders.where(k % 13 != 0).select(k.alias("k"), F.when(k % 6 == 0, "X").otherwise(status).alias("v"))
    return v.differences(expected, found, orders.where(k % 9 == 0).select(k.alias("k")), ["k"], "v")


@query("""WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k FROM orders), w AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0),
e AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT k AS object, 'lost' AS verdict FROM w WHERE k NOT IN (FROM a) UNION ALL SELECT k, 'trespasser' FROM a WHERE k IN (FROM b) AND k NOT IN (FROM w) UNION ALL SELECT k, 'open' FROM e WHERE k NOT IN (FROM a)""")
def object_closure(spark, d):
    objects = load(spark, d, "orders").select(F.lit(0).alias("doc_id"), F.col("o_orderkey").alias("object"))
    edges = load(spark, d, "lineitem").select(F.lit(0).alias("doc_id"), F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"))
    return v.object_closure(objects, objects.where("object % 3 <> 0"), edges, objects.where("object % 5 <> 0")).select("object", "verdict")


@query(f"""WITH {GLYPHS}, {REGIONS} SELECT DISTINCT g.doc_id, g.page_no, 'glyph-in-region' AS rule FROM glyphs g JOIN regions r USING (doc_id, page_no) WHERE {HIT} AND glyph_ord % 3 = 0
UNION ALL SELECT DISTINCT doc_id, NULL, 'undrawn-mapping' FROM glyphs WHERE (doc_id, font, code) NOT IN (SELECT (doc_id, font, code) FROM glyphs WHERE glyph_ord % 3 = 0)
UNION ALL SELECT DISTINCT doc_id, page_no, 'key-not-allowed' FROM glyphs WHERE font NOT IN ('F0', 'F1', 'F2', 'F3', 'F4', 'F5', 'F6', 'F7')""")
def region_cleared(spark, d):
    all_ = glyphs(spark, d)
    keys = all_.select("doc_id", "page_no", F.col("font").alias("key"))
    allowed = tuple(f"F{k}" for k in range(8))
    return v.region_not_cleared(all_.where("glyph_ord % 3 = 0"), regions(spark, d), all_.select("doc_id", "font", "code"), keys, allowed)


# 2.15: the sliding crash window


@query("""WITH c AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS at FROM events)
SELECT a.event_id, count(*) AS recent, count(*) > 3 AS "open" FROM c a JOIN c b ON b.user_id = a.user_id AND b.at BETWEEN a.at - 60 AND a.at GROUP BY a.event_id""")
def crash_breaker(spark, d):
    return breaker(load(spark, d, "events"), "user_id").select("event_id", "recent", "open")


# more of 2.1 to 2.8


@query("SELECT unnest(['merge', 'split', 'rotate', 'reorder', 'compress', 'render']) AS operation, '0.1.0' AS version")
def operation_list(spark, d):
    from quire import __version__

    names = F.array(*map(F.lit, ("merge", "split", "rotate", "reorder", "compress", "render")))
    return spark.range(1).select(F.explode(names).alias("operation"), F.lit(__version__).alias("version"))


@query("""WITH m AS (SELECT p_partkey, ['fetched', 'generated', 'committed', 'odd'][p_partkey % 4 + 1] AS kind, p_size % 2 = 0 AS named FROM part)
SELECT 'e' || p_partkey AS name, unnest(CASE kind WHEN 'odd' THEN ['kind'] WHEN 'fetched' THEN CASE WHEN named THEN ['licence'] ELSE ['url', 'licence'] END
  WHEN 'generated' THEN CASE WHEN named THEN CAST([] AS VARCHAR[]) ELSE ['generator'] END ELSE CASE WHEN named THEN CAST([] AS VARCHAR[]) ELSE ['path'] END END) AS problem FROM m""")
def manifest_problems(spark, d):
    from ..sources.documents import manifest_problems as problems

    named = F.when(F.col("p_size") % 2 == 0, F.col("p_name"))
    kind = F.get(F.array(*map(F.lit, ("fetched", "generated", "committed", "odd"))), (F.col("p_partkey") % 4).cast("int"))
    rows = load(spark, d, "part").select(
        F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("name"), kind.alias("kind"), named.alias("url"), F.col("p_name").alias("sha256"),
        F.lit(" ").alias("licence"), named.alias("generator"), named.alias("path"),
    )
    return problems(rows)


STATES = """st AS (SELECT o_custkey % 40 AS doc_id, o_orderkey AS page_no, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 5 + 1 END AS num,
  CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_custkey % 3 + 1 END AS holder, 'G' || (o_orderkey % 4) AS name, 'G' || (o_custkey % 4) AS used FROM orders),
pooled AS (SELECT *, CASE WHEN num <> 0 THEN 'own:' || num || ':0' WHEN holder <> 0 THEN 'holder:' || holder || ':0' ELSE 'page:' || page_no END AS pool FROM st)"""


@query(f"""WITH {STATES} SELECT DISTINCT doc_id, pool, name FROM pooled p WHERE NOT EXISTS (SELECT 1 FROM pooled q WHERE q.doc_id = p.doc_id AND q.pool = p.pool AND q.used = p.name)""")
def unused_pool_entries(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    zero = F.lit(0).cast("bigint")
    st = load(spark, d, "orders").select(
        (c % 40).alias("doc_id"), k.alias("page_no"), F.when(k % 3 != 0, k % 5 + 1).otherwise(zero).alias("num"), zero.alias("gen"),
        F.when(k % 2 != 0, c % 3 + 1).otherwise(zero).alias("holder_num"), zero.alias("holder_gen"),
        F.concat(F.lit("G"), k % 4).alias("name"), F.concat(F.lit("G"), c % 4).alias("used"),
    )
    pooled = trees.state_pools(st)
    return trees.unused_pool_entries(pooled.select("doc_id", "page_no", "pool", "name"), st.select("doc_id", "page_no", F.col("used").alias("name")))


@query(f"""WITH {GLYPHS}, {REGIONS}, cut AS (SELECT DISTINCT doc_id, page_no, glyph_ord FROM glyphs g JOIN regions r USING (doc_id, page_no) WHERE {HIT}),
drawn AS (SELECT DISTINCT doc_id, font, code FROM glyphs WHERE (doc_id, page_no, glyph_ord) NOT IN (SELECT (doc_id, page_no, glyph_ord) FROM cut))
SELECT DISTINCT doc_id, font, code, code + 32 AS maps_to FROM glyphs SEMI JOIN drawn USING (doc_id, font, code)""")
def narrowed_fonts(spark, d):
    all_ = glyphs(spark, d)
    mappings = all_.select("doc_id", "font", "code", (F.col("code") + 32).alias("maps_to")).distinct()
    return r.narrowed_fonts(mappings, r.codes_still_drawn(all_, r.selected_glyphs(all_, regions(spark, d))))


@query(f"""WITH RECURSIVE {GLYPHS}, {REGIONS}, c AS (SELECT DISTINCT g.doc_id, g.glyph_ord AS node FROM glyphs g JOIN regions r USING (doc_id, page_no) WHERE {HIT}
  UNION SELECT c.doc_id, (c.node * 3 + 1) % 12 FROM c) SELECT doc_id, node FROM c""")
def removed_annotations(spark, d):
    notes = glyphs(spark, d).withColumnRenamed("glyph_ord", "annotation")
    gone = r.removed_annotations(notes, regions(spark, d))
    every = gone.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint"))).alias("src"))
    links = gone.select("doc_id", F.col("node").alias("src")).union(every).distinct().withColumn("dst", (F.col("src") * 3 + 1) % 12)
    return trees.closure(gone, links)


@query("""WITH a AS (SELECT o_orderkey AS doc_id, o_custkey % 5 AS page_no, CAST(600 AS DOUBLE) AS w FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey AS doc_id, o_custkey % 5 AS page_no, 600 + (o_orderkey % 4) / 100.0 * 0.75 AS width, o_custkey % 100 AS x, o_orderkey % 100 AS y FROM orders WHERE o_orderkey % 9 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page_no, b.page_no) AS page_no, CASE WHEN w IS NULL OR width IS NULL THEN 'page-count' ELSE 'size' END AS rule FROM a FULL JOIN b ON a.doc_id = b.doc_id
  WHERE w IS NULL OR width IS NULL OR abs(w - width) > 0.01
UNION ALL SELECT doc_id, page_no, 'text-in-region' FROM b WHERE x > 10.05 AND x < 39.95 AND y > 20.05 AND y < 59.95""")
def second_reading(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = load(spark, d, "orders")
    key = [k.alias("doc_id"), (c % 5).alias("page_no")]
    first = orders.where(k % 7 != 0).select(*key, F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    kept = orders.where(k % 9 != 0)
    second = kept.select(*key, (F.lit(600.0) + k % 4 / 100.0 * 0.75).alias("width"), F.lit(800.0).alias("height"))
    origins = kept.select(*key, (c % 100).alias("x"), (k % 100).alias("y"))
    places = kept.select(*key, g.rect(F.lit(10), F.lit(20), F.lit(40), F.lit(60)).alias("region"))
    return v.second_reading(first, second, origins, places)


@query("""WITH p AS (SELECT o_orderkey AS fixture, o_orderpriority AS channel, ['refused', 'gone', 'present'][o_custkey % 3 + 1] AS expect FROM orders),
s AS (SELECT o_orderkey AS fixture, o_orderkey % 8 <> 0 AS before, o_custkey % 6 = 1 AS after, o_custkey % 9 IN (0, 3) AS refused FROM orders WHERE o_orderkey % 10 <> 0)
SELECT fixture, channel, expect, CASE WHEN before IS NULL THEN 'not-observed' WHEN NOT before THEN 'never-there' WHEN seen = expect THEN 'held' ELSE 'was-' || seen END AS verdict
FROM (SELECT p.*, before, CASE WHEN refused THEN 'refused' WHEN after THEN 'present' ELSE 'gone' END AS seen FROM p LEFT JOIN s USING (fixture)) q""")
def corpus_audit(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = load(spark, d, "orders")
    key = [k.alias("fixture"), F.col("o_orderpriority").alias("channel")]
    expect = F.get(F.array(*map(F.lit, ("refused", "gone", "present"))), (c % 3).cast("int"))
    seen = orders.where(k % 10 != 0).select(*key, (k % 8 != 0).alias("before"), (c % 6 == 1).alias("after"), (c % 9).isin(0, 3).alias("refused"))
    return v.audit(orders.select(*key, expect.alias("expect")), seen)


@query("""WITH r AS (SELECT DISTINCT 'r' || p_size AS rule FROM part), s AS (SELECT DISTINCT 'r' || (p_size * 2) AS rule FROM part)
SELECT rule, 'not-probed' AS verdict FROM r WHERE rule NOT IN (FROM s) UNION ALL SELECT rule, 'unknown-rule' FROM s WHERE rule NOT IN (FROM r)""")
def rule_coverage(spark, d):
    part = load(spark, d, "part")
    named = lambda x: F.concat(F.lit("r"), x.cast("string")).alias("rule")
    return v.rule_coverage(part.select(named(F.col("p_size"))).distinct(), part.select(named(F.col("p_size") * 2)))


@query(f"""WITH {GLYPHS} SELECT doc_id, page_no, glyph_ord, "left" - 2.5 AS "left", bottom - 2.5 AS bottom, greatest("right", "left" + 12) + 2.5 AS "right", greatest(top, bottom + 9) + 2.5 AS top FROM glyphs""")
def glyph_boxes(spark, d):
    x, y = F.col("left"), F.col("bottom")
    stroke = g.stroke_reach(F.lit(1.0), F.lit(4.0), F.lit(True))
    box = g.glyph_box(r.box_of(), g.rect(x, y, x + 12, y + 4), g.rect(x, y, x + 3, y + 9), stroke, F.lit(0.5))
    return glyphs(spark, d).select("doc_id", "page_no", "glyph_ord", box.alias("b")).select("doc_id", "page_no", "glyph_ord", "b.*")


@query("""WITH RECURSIVE f AS (SELECT p_partkey // 16 AS doc_id, p_partkey AS src, p_partkey // 16 * 16 + (p_partkey * 5 + 2) % 16 AS dst FROM part),
c AS (SELECT doc_id, src AS source, dst AS node FROM f UNION SELECT c.doc_id, c.source, f.dst FROM c JOIN f ON f.src = c.node AND f.doc_id = c.doc_id) SELECT doc_id, source, node FROM c""")
def used_names(spark, d):
    k = F.col("p_partkey")
    doc = F.floor(k / 16).cast("bigint")
    edges = load(spark, d, "part").select(doc.alias("doc_id"), k.alias("src"), (doc * 16 + (k * 5 + 2) % 16).alias("dst"))
    return trees.reach(edges.select("doc_id", F.col("src").alias("node")), edges)


from . import byte_queries, more_queries  # noqa: E402, F401  (register their own)

"""The paged stand-in: the driver's tables read as documents, pages, glyphs and graphs.

There are no document files among the tables. A conversation is a document and its turns are pages; everything else is
integer arithmetic on keys, so that Spark and the SQL of plans.queries read exactly the same data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import rect


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, page_no, rotation, body); every fourth page declares no rotation."""
    rotation = F.when(F.col("turn") % 4 != 3, (F.col("turn") * 7 + F.col("conv_id")) % 4 * 90).cast("int")
    return load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), rotation.alias("rotation"), F.col("text").alias("body")
    )


PAGES = """pages_in AS (
  SELECT conv_id AS doc_id, turn + 1 AS page_no, CASE WHEN turn % 4 <> 3 THEN (turn * 7 + conv_id) % 4 * 90 END AS rotation,
    text AS body FROM conversations),
counts AS (SELECT doc_id, count(*) AS n_pages FROM pages_in GROUP BY doc_id)"""


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, page_no, glyph_ord, left .. top, font, code, op_ord) from line items, as whole coordinates.

    Equal rows may repeat in this table; glyph_ord alone is no key.
    """
    q = F.col("l_quantity").cast("bigint")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").cast("bigint").alias("page_no"),
        F.col("l_partkey").alias("glyph_ord"),
        (F.col("l_partkey") % 500).cast("double").alias("left"),
        (F.col("l_suppkey") % 700).cast("double").alias("bottom"),
        (F.col("l_partkey") % 500 + q).cast("double").alias("right"),
        (F.col("l_suppkey") % 700 + 10).cast("double").alias("top"),
        F.concat(F.lit("F"), (F.col("l_suppkey") % 9).cast("string")).alias("font"),
        (F.col("l_partkey") % 97).alias("code"),
        (F.col("l_partkey") % 7).alias("op_ord"),
    )


GLYPHS = """glyphs AS (
  SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page_no, l_partkey AS glyph_ord,
    CAST(l_partkey % 500 AS DOUBLE) AS "left", CAST(l_suppkey % 700 AS DOUBLE) AS bottom,
    CAST(l_partkey % 500 + CAST(l_quantity AS BIGINT) AS DOUBLE) AS "right", CAST(l_suppkey % 700 + 10 AS DOUBLE) AS top,
    'F' || (l_suppkey % 9) AS font, l_partkey % 97 AS code, l_partkey % 7 AS op_ord FROM lineitem)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, page_no, region): one per order, on its page 1 to 3."""
    x, y = F.col("o_custkey") % 450, F.col("o_orderkey") % 90
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        (F.col("o_custkey") % 3 + 1).alias("page_no"),
        rect(x, y, x + 120, y + 60).alias("region"),
    )


REGIONS = """regions AS (
  SELECT o_orderkey AS doc_id, o_custkey % 3 + 1 AS page_no, o_custkey % 450 AS rl, o_orderkey % 90 AS rb,
    o_custkey % 450 + 120 AS rr, o_orderkey % 90 + 60 AS rt FROM orders)"""
HIT = 'g."left" < r.rr AND r.rl < g."right" AND g.bottom < r.rt AND r.rb < g.top'


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, stream_id, op_ord, operator, n_operands) from events: a user's events in order."""
    kinds = F.array(*map(F.lit, ("BDC", "Tj", "EMC", "BMC", "EMC", "Do")))
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"),
        (F.col("user_id") % 3).alias("stream_id"),
        F.col("event_id").alias("op_ord"),
        F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("operator"),
        (F.col("event_id") % 4).alias("n_operands"),
    )


OPERATIONS = """operations AS (
  SELECT user_id AS doc_id, user_id % 3 AS stream_id, event_id AS op_ord,
    ['BDC', 'Tj', 'EMC', 'BMC', 'EMC', 'Do'][event_id % 6 + 1] AS operator, event_id % 4 AS n_operands FROM events)"""

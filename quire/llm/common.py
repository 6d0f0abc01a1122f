"""What several operators share: tables, checkpoints, names, sorted runs, components of a link graph."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one spark.checkpoint.dir names.

    Where that is unset, a folder is chosen here on a single machine (as in tests); on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoints-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: The most rows of a task that `packed` makes.
PACKED = 1 << 19


def packed(df: DataFrame, rows: int = PACKED) -> DataFrame:
    """df, of narrow rows, stored, and read again in no more partitions than its rows fill (`rows` each)."""
    return _packed(df, rows)[0]


def _packed(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    df = stored(df)
    parts = max(1, -(-df.count() // rows))
    return df.coalesce(parts), parts


def few(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, of narrow rows, stored; where these are counted to be at most `rows`, joins broadcast it."""
    df, parts = _packed(df, rows)
    return F.broadcast(df) if parts == 1 else df


def set_apart(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with every column but the used ones under a name that no operator has, and the way back.

    The way back takes a result and further columns of it; it gives df's own columns, in their order and under their names,
    then the further ones. So no column of a table can clash with a working column.
    """
    names = [c if c in used else f"column {k}" for k, c in enumerate(df.columns)]
    own = df.columns

    def back(result: DataFrame, *more: str | Column) -> DataFrame:
        return result.select(*(F.col(f"`{n}`").alias(c) for n, c in zip(names, own, strict=True)), *more)

    return df.toDF(*names), back


FILTER_BITS = 24


def _bit_of(column: Column) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
    return F.shiftright(h, 6), h.bitwiseAND(F.lit(63))


def parted(df: DataFrame, column: str, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df's rows whose column may be among the first column of values, and the rows for which it is not.

    A bit map of 2^24 hashed bits, aggregated from values and broadcast as at most 262,144 words of 64 bits, whatever
    the number of values. No row that belongs is lost; few that do not belong come along. A map more than a quarter full
    would let too many through: both parts are then plain joins with the values. df may hold no column beginning with `_`
    but those of the caller's own that are not named here.
    """
    word, bit = _bit_of(F.col(values.columns[0]))
    mask = values.select(word.alias("_w"), F.expr("1L").alias("_one"), bit.cast("int").alias("_b"))
    mask = stored(mask.groupBy("_w").agg(F.bit_or(F.expr("shiftleft(_one, _b)")).alias("_mask")))
    if (mask.agg(F.sum(F.bit_count("_mask"))).first()[0] or 0) > 1 << (FILTER_BITS - 2):
        one = values.select(F.col(values.columns[0]).alias(column)).distinct()
        return df.join(one, column, "left_semi"), df.join(one, column, "left_anti")
    word, bit = _bit_of(F.col(column))
    df = df.withColumns({"_word": word, "_bit": bit.cast("int")})
    there = (F.col("_word") == F.col("_w")) & (F.expr("shiftright(_mask, _bit) & 1L") == 1)
    first, rest = (df.join(F.broadcast(mask), there, how).drop("_word", "_bit") for how in ("left_semi", "left_anti"))
    return first, rest


def filtered(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    return parted(df, column, values)[0]


def running_starts(counts: DataFrame, key: str, amount: str, block: int = 1024) -> DataFrame:
    """counts (key: a number from 0, amount) with `start`, the sum of all amounts of smaller keys.

    Two levels: within blocks of `block` keys, and over the blocks' totals; so one task sees a row per block, not per key.
    """
    counts = counts.withColumn("_block", F.floor(F.col(key) / block))
    sums = counts.groupBy("_block").agg(F.sum(amount).alias("_sum"))
    over = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select("_block", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_head"))
    within = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_head") + F.coalesce(F.sum(amount).over(within), F.lit(0))
    return counts.join(heads, "_block").withColumn("start", start).drop("_block", "_head")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by the keys. Holds one key's rows and one batch."""
    open_key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i, key in enumerate(rows):
            if key != open_key:
                if i > start:
                    parts.append(batch.slice(start, i - start))
                if parts:
                    yield pa.Table.from_batches(parts)
                open_key, parts, start = key, [], i
        parts.append(batch.slice(start))
    if parts:
        yield pa.Table.from_batches(parts)


def by_run(df: DataFrame, keys: list[str], each: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """each() applied to the rows of every key. Keys must be bounded in rows; the caller has split larger ones."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, keys):
            out = each(run)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(part, schema)


def _print_of(edges: DataFrame) -> tuple:
    """Tells edge lists apart: their number and two order-free digests."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


#: The most edges that a task contracts at once.
CONTRACTED = 1 << 19


def least_linked(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of m nodes the least node that the links a[i] - b[i] reach."""
    comp = np.arange(m)
    while True:
        least = comp.copy()
        np.minimum.at(least, a, comp[b])
        np.minimum.at(least, b, comp[a])
        least = np.minimum(least, least[least])
        np.minimum.at(least, comp, least)
        if (least == comp).all():
            return comp
        comp = least


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some edges at a time as the stars of their components: the same connections, one edge a node."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("u", "v"))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        comp = least_linked(len(ids), at[: len(u)], at[len(u) :])
        own = np.flatnonzero(comp != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[comp[own]])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CONTRACTED:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the smallest node.

    Every task replaces the edges it has, at most CONTRACTED at a time, by stars of the same connections. Where all edges
    fit one such step, that is the result. Else large-star and small-star steps alternate with it until nothing changes,
    which takes a number of rounds logarithmic in the longest path. A step is a join and a partially aggregated minimum. The
    minima are stored before they are joined, so both sides of a join are plain shuffles: a node with very many links is then
    a skew that adaptive execution splits (or, while the minima are few, broadcasts away), not one task's list. Nodes
    without an edge to another node do not appear. Each step is checkpointed.
    """
    e, parts = _packed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), CONTRACTED)
    seen = None
    for _ in range(most_rounds):
        one = parts == 1
        e = packed(e.mapInArrow(_contracted, "u long, v long"), CONTRACTED)
        now = None if one else _print_of(e)
        if one or now == seen:
            break
        seen = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        # large star: every larger neighbour of a node links to the node's least neighbour
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
        large = stored(large.select(F.col("w").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours link to the least of them
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        rest = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, parts = _packed(low.select("u", F.col("m").alias("v")).union(rest).distinct(), CONTRACTED)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))

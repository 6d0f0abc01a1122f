"""Embedding near-dedup by Euclidean p-stable hashing.

Unit vectors of cosine c lie sqrt(2 - 2c) apart. A table hashes a unit vector u to floor((a_i . u + b_i) / w) for k
Gaussian directions a_i; L independent tables are used. k follows the number of vectors, so that a table puts
about a quarter of a foreign vector into a bucket, and L follows from k, so that a pair at the threshold shares a
bucket with probability `recall` (pairs above it with a higher one): both are computed, neither depends on the data.

1. Equal vectors become one node with a multiplicity.
2. Keys are made once and checkpointed. Buckets of one node end there (a partially aggregated count); only the
   others' vectors are shuffled, each with its bucket's key alone.
3. A bucket of many nodes is dealt into blocks of about `block_rows`; a pair of blocks is one task's work: cosines in
   double precision. A pair counts only in the first table that it shares, so that link counts need no list of pairs: the
   earlier tables' keys of the linked vectors are made again from the vectors (their projections are sums of numbers rounded
   so that double precision adds them exactly, so they come out the same everywhere); a task returns a count per node and a
   star per component.
4. Sums of the counts, components of the stars, then the copies of each node.

Rows: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with
a null vec_id (their component_id is null, and they are kept). Vectors of different lengths do not link. Rows that share
a vec_id are one vector for the counts. Labels and other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, least_linked, stored, table
from .words import mixed

#: Quantisation width, for unit vectors.
WIDTH = 2.0


def collision(distance: float, width: float = WIDTH) -> float:
    """The probability that one quantised Gaussian projection agrees at a distance."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Projections a table, and tables, for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(2, 4 * n)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    raw /= np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _usable(kind: str):
    """Vectors as bytes of the table's own kind of number; unusable ones as null."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, x in zip(batch.column("vec_id"), batch.column("embedding"), strict=True):
                ok = i.is_valid and x.is_valid and len(x.values) and not x.values.null_count
                v = x.values.to_numpy(zero_copy_only=False).astype(kind) if ok else None
                out.append((v + 0).tobytes() if ok and np.isfinite(v).all() and v.any() else None)  # + 0: no negative zeros
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "vector"])

    return part


class Hasher:
    """The bucket keys of unit vectors of one size."""

    def __init__(self, size: int, k: int, tables: int, seed: int):
        r = np.random.default_rng([seed, size])
        self.size, self.k = size, k
        # rounded, so that products and their sums, in whatever order, are exact in double precision
        self.directions = np.round(r.standard_normal((size, k * tables)) * 2**20) / 2**20
        self.shift = np.round(r.uniform(0, WIDTH, k * tables) * 2**20) / 2**20

    def keys(self, unit: np.ndarray, tables: int) -> np.ndarray:
        """The keys of the first tables, as a row per vector."""
        n = tables * self.k
        u = np.round(unit * 2**22) / 2**22
        cells = np.floor((u @ self.directions[:, :n] + self.shift[:n]) / WIDTH).astype(np.int64).view(np.uint64)
        cells = cells.reshape(len(u), tables, self.k)
        key = np.full((len(u), tables), np.uint64(self.size))
        with np.errstate(over="ignore"):
            for j in range(self.k):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
        return key.view(np.int64)


def _keys(k: int, tables: int, seed: int, kind: str):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            out: list = [None] * len(raw)
            for size in {len(x) for x in raw}:
                at = [i for i, x in enumerate(raw) if len(x) == size]
                v = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1)
                hasher = hashers.setdefault(size, Hasher(v.shape[1], k, tables, seed))
                for i, row in zip(at, hasher.keys(_unit(v), tables), strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.list_(pa.int64()))], ["node", "keys"])

    return part


#: A run of at most so many rows has its pairs listed with those of other such runs.
FEW = 32


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs a < b of rows of the same run, for runs of FEW rows at most."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size in np.unique(sizes[(sizes > 1) & (sizes <= FEW)]):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size]
        left.append((at[:, None] + i).ravel()), right.append((at[:, None] + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _links(threshold: float, k: int, tables: int, seed: int, kind: str):
    """From rows sorted by (t, key, low, high): counts of links (a, n) and stars (a, b), some runs at a time."""
    hashers: dict[int, Hasher] = {}

    def found(rows: pa.Table) -> pa.RecordBatch | None:
        m = rows.num_rows
        raw = rows.column("vector").to_pylist()
        t, key, low, high, block, node, copies = (rows.column(c).to_numpy() for c in ("t", "key", "low", "high", "block", "node", "copies"))
        new = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, m])
        lengths = np.fromiter(map(len, raw), np.int64, m)
        a_of, b_of = [], []
        by_length = {}  # rows of a key have vectors of one length
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            place = np.full(m, -1)
            place[at] = np.arange(len(at))
            by_length[int(length)] = (place, _unit(np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1)))
        for length, (place, unit) in by_length.items():
            mine = lengths[starts] == length
            left, right = _pairs(starts[mine], sizes[mine])
            step = max(1, 4_000_000 // unit.shape[1])
            for i in range(0, len(left), step):
                x, y = left[i : i + step], right[i : i + step]
                near = np.einsum("ij,ij->i", unit[place[x]], unit[place[y]]) >= threshold
                a_of.append(x[near]), b_of.append(y[near])
            for start, size in zip(starts[mine & (sizes > FEW)], sizes[mine & (sizes > FEW)], strict=True):
                u = unit[place[start] : place[start] + size]
                x, y = np.nonzero(np.triu(u @ u.T >= threshold, 1))
                a_of.append(x + start), b_of.append(y + start)
        a, b = np.concatenate(a_of), np.concatenate(b_of)
        good = (node[a] != node[b]) & ((low[a] == high[a]) | (block[a] != block[b]))
        a, b = a[good], b[good]
        first = np.ones(len(a), bool)
        for table in np.unique(t[a]):
            at = np.flatnonzero(t[a] == table)
            if not table:
                continue
            for length in np.unique(lengths[a[at]]):
                some = at[lengths[a[at]] == length]
                place, unit = by_length[int(length)]
                hasher = hashers.setdefault(int(length), Hasher(unit.shape[1], k, tables, seed))
                linked, where = np.unique(np.concatenate([a[some], b[some]]), return_inverse=True)
                shared = np.zeros(len(some), bool)
                step = max(1, 2_000_000 // (hasher.k * int(table)))
                earlier = np.concatenate([hasher.keys(unit[place[linked[i : i + step]]], int(table)) for i in range(0, len(linked), step)])
                x, y = where[: len(some)], where[len(some) :]
                step = max(1, 4_000_000 // int(table))
                for i in range(0, len(some), step):
                    shared[i : i + step] = (earlier[x[i : i + step]] == earlier[y[i : i + step]]).any(1)
                first[some] = ~shared
        a, b = a[first], b[first]
        if not len(a):
            return None
        ids, at = np.unique(np.concatenate([node[a], node[b]]), return_inverse=True)
        n = np.bincount(at, np.concatenate([copies[b], copies[a]]), len(ids))
        comp = least_linked(len(ids), at[: len(a)], at[len(a) :])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(ids[comp])], ["a", "n", "b"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = ("t", "key", "low", "high")
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in names]
            other = np.zeros(batch.num_rows, bool)
            for c, x in zip(names, last, strict=True):
                other |= batch.column(c).to_numpy() != x
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # where the last run of the batch begins
            if held and not cut and all(held[0].column(c)[held[0].num_rows - 1].as_py() == x for c, x in zip(names, last, strict=True)):
                held.append(batch)
                continue
            whole = pa.Table.from_batches([*held, batch.slice(0, cut)]) if held or cut else None
            held = [batch.slice(cut)]
            if whole is not None and (out := found(whole)) is not None:
                yield out
        if held and (out := found(pa.Table.from_batches(held))) is not None:
            yield out

    return part


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, block_rows: int = 512, seed: int = 1
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors (vec_id, embedding)."""
    kind = "<f4" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "<f8"
    made = stored(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(
            _usable(kind), "vec_id long, vector binary"
        )
    )
    distinct = made.where("vector is not null").distinct()
    nodes = distinct.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = stored(nodes)
    k, tables = plan(nodes.count(), threshold, recall)
    keyed = stored(nodes.select("node", "vector").mapInArrow(_keys(k, tables, seed, kind), "node long, keys array<bigint>"))
    entries = keyed.select("node", F.posexplode("keys").alias("t", "key"))
    shared = entries.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(shared.select("t", "key", F.ceil(F.col("size") / block_rows).cast("int").alias("blocks")))
    # plain shuffled sides: a full bucket is a skew that adaptive execution splits
    live = entries.join(shared, ["t", "key"])
    rows = live.join(nodes, "node").withColumn("block", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "t", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "node", "copies", "vector",
    )
    keys = ["t", "key", "low", "high"]
    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links(threshold, k, tables, seed, kind), "a long, n long, b long")
    found = stored(found)
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    group = components(found.select("a", "b"))
    told = nodes.join(counts, "node", "left").join(group, "node", "left")
    told = told.select("vector", "n", "copies", F.coalesce("component", "node").alias("component"))
    out = made.join(told, "vector", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.coalesce("n", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))

#: The rows by SQL: all pairs are compared, so it suits small tables only.
OP1_SQL = r"""
WITH RECURSIVE vec AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT DISTINCT vec_id, e FROM vec
  WHERE vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
number AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
  vec_id IS NULL OR vec_id <= coalesce(least.b, vec_id) AS kept
FROM vec LEFT JOIN least ON least.a = vec_id LEFT JOIN number ON number.a = vec_id
"""

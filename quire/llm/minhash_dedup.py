"""MinHash near-dedup by an LSH forest.

A document is the set of its distinct five-word shingles (words: runs of anything but ASCII white space,
A-Z lower-cased; a text of fewer words is one shingle; a text without words, empty or null, is the empty set).
Two documents link if |A and B| / |A or B| >= threshold; groups are the components of the links.

1. One scan makes for every document a digest of its word sequence, its set size and 96 MinHash values.
   Texts of one word sequence become one representative, by a partially aggregated minimum.
2. The forest: 16 signature orders of 6 values each. All orders are one range sort of (order, label, node).
   In an order, documents whose labels share a prefix of at least 4 values form a region. A region of more than
   `region_rows` rows is split by the next value, and so on (adaptive depth); at full depth it goes in windows
   that are joined whole. Within a region, rows whose estimated similarity and set sizes allow a link become
   connected; that takes one pass per row outside the region's largest component, not all pairs, and gives stars.
   A region that a partition's end cuts is joined whole. Components of these stars are the candidate groups,
   which are supersets of the true groups.
3. Only documents of candidate groups have their texts shuffled; full shingle sets are compared exactly by matrix products
   over the shared shingles. A group of at most `block_rows` rows and `block_shingles` shingles is one task's work. A larger
   one is never paired row by row: in rounds, up to `hubs` of its rows (then four times as many, and so on) are compared
   with all rows of the group, block by block. Each round chooses them among the rows that lie outside the group's largest
   component, by their agreement with the consensus of such rows' signatures, so that the text that the others were
   copied from comes first. When no row is left that neither lies in the largest component nor was compared with all
   others, every link between two components has been looked for. A group of copies takes a round or two, linear in its
   size; only rows that resemble each other without a link cost more.
4. Components of confirmed links, then the copies of each representative.

A pair at the threshold 0.85 shares a region of depth 6 in at least one order with probability
1 - (1 - 0.85^6)^16 = 0.9995, so a region's size does not decide what is found; of depth 4 with all but 8e-6. The
similarity is estimated from all 96 values; its bound lies four deviations below the threshold.

Rows: null, empty and blank texts link with nothing. A document is a doc_id with a text: rows that share a doc_id and differ
in their words are nodes of their own, and each has its own component_id. A null doc_id links with nothing, its
component_id is null and it is kept. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_run, components, few, filtered, packed, parted, set_apart, stored, table
from .words import WordHash, shingle_words, shingles

ORDERS, DEPTH, LEAST_DEPTH = 16, 6, 4
HASHES = ORDERS * DEPTH
#: The values that estimate a pair's similarity and travel, as a byte each, with every row of the forest.
ESTIMATED = 96


def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    odd = r.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, r.integers(0, 2**63, HASHES, dtype=np.uint64)


def signature(s: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The 96 MinHash values of a set of hashes, 16 low bits of each."""
    a, b = functions
    least = np.full(HASHES, np.uint64(2**64 - 1))
    for k in range(0, len(s), 2048):
        np.minimum(least, (s[k : k + 2048, None] * a + b).min(0), out=least)
    return (least >> np.uint64(24)).astype(np.uint16)


def _signatures(width: int):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, functions = WordHash(), _functions()
        for batch in batches:
            digests, sizes, labels, lows = [], [], [], []
            for x in batch.column("text"):
                words = shingle_words(x.as_buffer().to_pybytes()) if x.is_valid else []
                s = shingles(words, seen, width)
                sizes.append(len(s))
                if words:
                    sig = signature(s, functions)
                    digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    labels.append(sig.astype(">u2").tobytes())
                    lows.append(sig[:ESTIMATED].astype(np.uint8).tobytes())
                else:
                    digests.append(None), labels.append(None), lows.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("raw"),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(labels, pa.binary()),
                    pa.array(lows, pa.binary()),
                ],
                ["doc_id", "raw", "digest", "n_shingles", "labels", "lows"],
            )

    return part


def _linked(n: np.ndarray, lows: np.ndarray, ratio: float, alike: float) -> np.ndarray:
    """For the rows of a region, the first row of each one's component under: sizes and estimate allow a link.

    A row compares with all others unless it lies in the largest component at its turn, so every pair of
    rows in different components has been compared.
    """
    m = len(n)
    comp, led, least = np.arange(m), np.zeros(m, bool), math.ceil(alike * ESTIMATED)
    sizes = np.ones(m, np.int64)
    while True:
        largest = int(sizes.argmax())
        todo = np.flatnonzero(~led & (comp != largest))
        if not led.any():
            todo = np.arange(1)
        if not len(todo):
            return comp
        i = int(todo[0])
        led[i] = True
        fits = np.flatnonzero((n >= ratio * n[i]) & (n * ratio <= n[i]))
        hit = fits[(lows[fits] == lows[i]).sum(1) >= least]
        touched = np.unique(comp[hit])
        if len(touched) > 1:
            comp[np.isin(comp, touched)] = touched[0]
            sizes = np.bincount(comp, minlength=m)


def _regions(region_rows: int, ratio: float, alike: float, held_rows: int):
    """From rows sorted by (tree, label, node): stars (a, b) of candidate links, and pieces of cut regions."""

    def stars(ids, labels, n, lows, depth, out):
        m = len(ids)
        if m <= region_rows or depth > DEPTH:
            for k in range(0, m, region_rows):
                comp = _linked(n[k : k + region_rows], lows[k : k + region_rows], ratio, alike)
                own = np.flatnonzero(comp != np.arange(len(comp)))
                out.append((ids[k + own], ids[k + comp[own]]))
                if k:  # full depth and still too many: consecutive windows are one group, to be told apart later
                    out.append((ids[k : k + region_rows], np.full(len(comp), ids[k - 1])))
                    out.append((ids[k - region_rows : k], np.full(region_rows, ids[k])))
            return
        same = (labels[1:, 2 * depth - 2 : 2 * depth] == labels[:-1, 2 * depth - 2 : 2 * depth]).all(1)
        cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), m]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                stars(ids[a:b], labels[a:b], n[a:b], lows[a:b], depth + 1, out)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True

        def piece(rows):
            """A region at an end of the partition, which may go on elsewhere: its rows with its first row."""
            ids, name = rows[1], rows[0][0].tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.full(len(ids), ids[0])), pa.array([name] * len(ids), pa.binary())],
                ["a", "b", "region"],
            )

        def made(pairs):
            a, b = (np.concatenate([x[k] for x in pairs]) if pairs else np.empty(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary())], ["a", "b", "region"])

        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            tree = batch.column("tree").to_numpy(zero_copy_only=False).astype(np.uint8)
            labels = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(m, 2 * DEPTH)
            now = (
                np.concatenate([tree[:, None], labels[:, : 2 * LEAST_DEPTH]], 1),
                batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64),
                labels,
                batch.column("n_shingles").to_numpy(zero_copy_only=False).astype(np.int64),
                np.frombuffer(b"".join(batch.column("lows").to_pylist()), np.uint8).reshape(m, ESTIMATED),
            )
            rows = now if held is None else tuple(np.concatenate([x, y]) for x, y in zip(held, now, strict=True))
            cuts = np.flatnonzero((rows[0][1:] != rows[0][:-1]).any(1)) + 1
            bounds = np.r_[0, cuts, len(rows[1])]
            out: list = []
            if first and len(cuts):
                yield piece([x[: bounds[1]] for x in rows])
                first = False
            for k in np.flatnonzero(np.diff(bounds[:-1]) > 1):
                stars(*(x[bounds[k] : bounds[k + 1]] for x in (rows[1], rows[2], rows[3], rows[4])), LEAST_DEPTH + 1, out)
            held = tuple(x[bounds[-2] :].copy() for x in rows)
            if len(held[1]) > held_rows:  # bounded memory: a longer region is cut here as at a partition's end
                yield piece(held)
                stars(*held[1:], LEAST_DEPTH + 1, out)
                held, first = None, True
            yield made(out)
        if held is not None:
            out = []
            yield piece(held)
            if len(held[1]) > 1:
                stars(*held[1:], LEAST_DEPTH + 1, out)
            yield made(out)

    return part


def _stars(ids: np.ndarray, sets: list[np.ndarray], against: np.ndarray, num: int, den: int) -> pa.RecordBatch | None:
    """Stars (a, b) of the links between the sets and those of them that `against` names by index."""
    m = len(ids)
    n = np.array([len(s) for s in sets], np.int64)
    shared = np.zeros((m, len(against)), np.float32)
    values, rows = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    new = np.r_[True, values[1:] != values[:-1]]
    column, count = np.cumsum(new) - 1, np.diff(np.r_[np.flatnonzero(new), len(values)])
    many = count[column] > 1  # a shingle of one document adds nothing to any intersection
    column, rows = column[many], rows[many]
    if not len(column):
        return None
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
    step = max(1, 8_000_000 // m)
    for k in range(0, int(column[-1]) + 1, step):
        lo, hi = np.searchsorted(column, [k, k + step])
        x = np.zeros((m, int(column[hi - 1]) + 1 - k), np.float32)
        x[rows[lo:hi], column[lo:hi] - k] = 1
        shared += x @ x[against].T
    both = shared.astype(np.int64)
    link = den * both >= num * (n[:, None] + n[against][None, :] - both)
    link[against, np.arange(len(against))] = True
    comp = np.arange(m)
    while True:
        least = comp.copy()
        hub = np.where(link, comp[:, None], m).min(0)
        least = np.minimum(least, np.where(link, hub[None, :], m).min(1))
        if (least == comp).all():
            break
        comp = least
    own = np.flatnonzero(comp != np.arange(m))
    if not len(own):
        return None
    return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[comp[own]])], ["a", "b"])


def _confirm(width: int, num: int, den: int):
    """Stars of confirmed links among the documents of a group; of a large group, between a block of it and some hubs."""

    def each(run: pa.Table) -> pa.RecordBatch | None:
        seen = each.__dict__.setdefault("seen", WordHash())
        hub = run.column("hub").to_numpy(zero_copy_only=False)
        ids = run.column("node").to_numpy()
        first = np.lexsort((~hub, ids))  # a hub that also lies in the block counts once, as a hub
        at = first[np.r_[True, ids[first][1:] != ids[first][:-1]]]
        ids, hub = ids[at], hub[at]
        if len(ids) < 2:
            return None
        texts = run.column("text")
        sets = [shingles(shingle_words(texts[int(k)].as_buffer().to_pybytes()), seen, width) for k in at]
        return _stars(ids, sets, np.flatnonzero(hub), num, den)

    return each


def _consensus(run: pa.Table) -> pa.RecordBatch:
    """The most frequent value at each place of some signatures."""
    lows = np.frombuffer(b"".join(run.column("lows").to_pylist()), np.uint8).reshape(run.num_rows, ESTIMATED)
    out = bytes(int(np.bincount(lows[:, k]).argmax()) for k in range(ESTIMATED))
    return pa.RecordBatch.from_arrays([run.column("component").combine_chunks()[:1], pa.array([out], pa.binary())], ["component", "consensus"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, ESTIMATED) for c in ("lows", "consensus"))
        agreed = pa.array((x == y).sum(1), pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "node", "slots")), agreed], ["component", "node", "slots", "agreed"])


HUBS_A_TASK = 128


def _large_groups(rows: DataFrame, confirm, hubs: int) -> DataFrame:
    """Links (a, b) of groups of several blocks; rows: (component, blocks, block, node, lows, text), stored. See the module."""
    spark = rows.sparkSession
    narrow = packed(rows.select("component", "node", "lows"))
    links = spark.createDataFrame([], "a long, b long")
    done = spark.createDataFrame([], "component long, node long")
    open_ = narrow
    for turn in range(64):
        count = open_.groupBy("component").agg(F.count("*").alias("n"))
        slots = few(count.select("component", F.least(F.col("n"), F.lit(hubs)).cast("int").alias("slots")))
        if slots.isEmpty():
            return links
        sample = open_.groupBy("component", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(64)).alias("place"))
        sample = sample.agg(F.max_by("lows", F.xxhash64("node", F.lit(-turn))).alias("lows"))
        wanted = few(by_run(sample.select("component", "lows"), ["component"], _consensus, "component long, consensus binary"))
        scored = open_.join(wanted, "component").join(slots, "component").select("component", "node", "slots", "lows", "consensus")
        scored = scored.mapInArrow(_agreement, "component long, node long, slots int, agreed int")
        # every row where they are few, else the best of each of `hubs` shares
        place = F.xxhash64("node", F.lit(turn))
        all_ = scored.where(F.col("slots") < hubs).select("component", "node", F.pmod(place, F.ceil(F.col("slots") / HUBS_A_TASK)).cast("int").alias("chunk"))
        slot = F.pmod(place, F.lit(hubs)).cast("int")
        best = scored.where(F.col("slots") == hubs).groupBy("component", slot.alias("slot")).agg(F.max(F.struct("agreed", "node")).alias("best"))
        best = best.select("component", F.col("best.node").alias("node"), F.floor(F.col("slot") / HUBS_A_TASK).cast("int").alias("chunk"))
        chosen = packed(all_.union(best))
        chunks = few(chosen.groupBy("component").agg((F.max("chunk") + 1).alias("chunks")))
        every = rows.join(chunks, "component").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        every = every.select("component", "block", "chunk", "node", F.lit(False).alias("hub"), "text")
        picked = rows.join(chosen, ["component", "node"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        picked = picked.select("component", "block", "chunk", "node", F.lit(True).alias("hub"), "text")
        found = by_run(every.union(picked), ["component", "block", "chunk"], confirm, "a long, b long")
        joined = components(links.union(found))
        links = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
        done = packed(done.union(chosen.select("component", "node")))
        named = narrow.join(joined.withColumnRenamed("component", "label"), "node", "left")
        named = packed(named.select("component", "node", "lows", F.coalesce("label", "node").alias("label")))
        sizes = named.groupBy("component", "label").agg(F.count("*").alias("n"))
        largest = few(sizes.groupBy("component").agg(F.max(F.struct("n", "label")).alias("m")).select("component", F.col("m.label").alias("label")))
        rest = named.join(largest, ["component", "label"], "left_anti").select("component", "node", "lows")
        open_ = packed(rest.join(done, ["component", "node"], "left_anti"))
        hubs *= 4
    raise RuntimeError("a candidate group was not told apart in 64 rounds")


SIGNED = "doc_id long, raw long, digest binary, n_shingles long, labels binary, lows binary"


def _grouped(docs: DataFrame, width: int, threshold: tuple[int, int], region_rows: int, block_rows: int, block_shingles: int, hubs: int) -> DataFrame:
    """Rows (doc_id, raw, n_shingles, component_id, kept, stays) from docs (doc_id, text).

    raw: a hash of the text; stays: the row's doc_id and text are the ones that stand for its group.
    """
    num, den = threshold
    t = num / den
    alike = t - 4 * math.sqrt(t * (1 - t) / ESTIMATED)
    docs = docs.select("doc_id", F.xxhash64("text").alias("raw"), "text")
    made = stored(docs.mapInArrow(_signatures(width), SIGNED))
    whole = made.where("digest is not null and doc_id is not null")
    rep = F.min(F.struct("doc_id", "raw")).alias("rep")
    groups = whole.groupBy("digest").agg(rep, F.min("n_shingles").alias("size"), F.count("*").alias("n"))
    groups = stored(groups.select("digest", "rep.*", "size", "n"))
    # a text's node is its smallest doc_id; where texts share that, they are told apart by a hash of their words
    shared = stored(groups.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id", F.lit(True).alias("several")))
    told_apart = not shared.isEmpty()
    if told_apart:
        groups = groups.join(shared, "doc_id", "left").withColumn("node", F.when(F.col("several"), F.xxhash64("digest")).otherwise(F.col("doc_id")))
        groups = stored(groups.drop("several"))
    else:
        groups = groups.withColumn("node", F.col("doc_id"))
    reps = whole.join(groups.select("digest", "doc_id", "raw", "node"), ["digest", "doc_id", "raw"]).select("node", "n_shingles", "labels", "lows")
    trees = reps.select(
        F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("tree"), "node", "n_shingles", "labels", "lows"
    ).select(
        "tree",
        F.expr(f"substring(labels, {2 * DEPTH} * tree + 1, {2 * DEPTH})").alias("label"),
        "node",
        "n_shingles",
        "lows",
    )
    order = ["tree", "label", "node"]
    found = stored(
        trees.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_regions(region_rows, t, alike, 16 * region_rows), "a long, b long, region binary")
    )
    pieces = found.where("region is not null")
    parts = stored(pieces.groupBy("region").agg(F.min("b").alias("least"), F.max("b").alias("most")).where("least < most"))
    cut = pieces.join(parts, "region").select("a", F.col("least").alias("b"))
    group = components(found.where("region is null").select("a", "b").union(cut))

    heads = group.select("component").distinct().select(F.col("component").alias("node"), "component")
    members = group.union(heads).join(groups.select("node", "doc_id", "raw", "size"), "node")
    members = stored(members)
    blocks = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("size") / block_shingles)).cast("int")
    blocks = stored(members.groupBy("component").agg(blocks.alias("blocks")))
    members = members.join(blocks, "component").drop("size")
    # only documents of candidate groups are shuffled; rows that repeat one are compared once
    texts = filtered(docs, "doc_id", members.select("doc_id")).join(members, ["doc_id", "raw"])
    confirm = _confirm(width, num, den)
    texts = texts.dropDuplicates(["component", "node"])
    one = texts.where("blocks = 1").select("component", "node", F.lit(True).alias("hub"), "text")
    links = by_run(one, ["component"], confirm, "a long, b long")
    large = blocks.where("blocks > 1")
    if not large.isEmpty():
        lows = whole.select("doc_id", "raw", "lows")
        several = texts.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        wanted = members.where("blocks > 1").select("doc_id")
        several = several.join(filtered(lows, "doc_id", wanted).dropDuplicates(["doc_id", "raw"]), ["doc_id", "raw"])
        several = stored(several.select("component", "blocks", "block", "node", "lows", "text"))
        links = links.union(_large_groups(several, confirm, hubs))
    group = components(links)
    group = group.withColumn("survivor", F.col("component"))
    if told_apart:  # a component's name is its smallest doc_id, not its smallest node
        inside = group.select("component", "node").union(group.select("component", F.col("component").alias("node"))).distinct()
        least = F.min(F.struct("doc_id", "node")).alias("least")
        named = inside.join(groups.select("node", "doc_id"), "node").groupBy("component").agg(least)
        group = inside.join(stored(named), "component").select("node", F.col("least.doc_id").alias("component"), F.col("least.node").alias("survivor"))
    # both joins have plain shuffled sides, so that many copies of one text are a skew that adaptive execution splits
    copied = groups.where("n > 1 or node <> doc_id")
    copied = stored(copied.select("digest", F.col("doc_id").alias("rep"), F.col("raw").alias("rep_raw"), F.col("node").alias("own")))
    named = made.select("doc_id", "raw", "n_shingles", "digest").join(copied, "digest", "left")
    named = named.withColumns({"rep": F.coalesce("rep", "doc_id"), "rep_raw": F.coalesce("rep_raw", "raw"), "own": F.coalesce("own", "doc_id")})
    out = named.join(group, F.col("own") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    first = (F.col("doc_id") == F.col("rep")) & F.col("raw").eqNullSafe(F.col("rep_raw"))
    return out.select(
        "doc_id",
        "raw",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        (first & F.coalesce(F.col("own") == F.col("survivor"), F.lit(True))).alias("stays"),
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: tuple[int, int] = (85, 100),
    region_rows: int = 2048,
    block_rows: int = 1024,
    block_shingles: int = 4_000_000,
    hubs: int = 64,
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs; see the module."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _grouped(docs, width, threshold, region_rows, block_rows, block_shingles, hubs).drop("raw", "stays")


def remove_near_duplicates(
    docs: DataFrame,
    width: int = 5,
    threshold: tuple[int, int] = (85, 100),
    region_rows: int = 2048,
    block_rows: int = 1024,
    block_shingles: int = 4_000_000,
    hubs: int = 64,
) -> DataFrame:
    """docs with one document of each group, that with the smallest doc_id; rows without a doc_id all stay.

    A document is a doc_id with a text: of rows that agree in both, one stays; rows that share a doc_id and hold different
    texts are judged each. Only rows that may be superfluous or repeated are shuffled; the others stay where they are.
    """
    docs, back = set_apart(docs, "doc_id", "text")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _grouped(plain, width, threshold, region_rows, block_rows, block_shingles, hubs).where("doc_id is not null")
    told = found.groupBy("doc_id", "raw").agg(F.min("stays").alias("_stays"), F.count("*").alias("n"))
    touched = stored(told.where("n > 1 or not _stays").select(F.xxhash64("doc_id", "raw").alias("_key"), "_stays"))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    keyed = docs.withColumn("_key", F.when(F.col("doc_id").isNotNull(), key))
    hit, rest = parted(keyed, "_key", touched.select("_key"))
    hit = hit.join(touched, "_key", "left").where("_stays is null or _stays")
    return back(rest.select(docs.columns).union(hit.dropDuplicates(["_key"]).select(docs.columns)))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

#: The rows by SQL: documents that share a rare shingle are compared whole, and all pairs within a component are listed.
OP10_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id, array_to_string(w, ' ') AS t, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM doc),
text AS (SELECT min(doc_id) AS rep, t, any_value(s) AS s, len(any_value(s)) AS n FROM sets WHERE doc_id IS NOT NULL AND t <> '' GROUP BY t),
shingle AS (SELECT rep, n, unnest(s) AS h FROM text),
rare AS (SELECT h, count(*) AS df FROM shingle GROUP BY h),
ranked AS (SELECT rep, n, h, row_number() OVER (PARTITION BY rep ORDER BY df, h) AS k FROM shingle JOIN rare USING (h)),
head AS (SELECT rep, n, h FROM ranked WHERE k <= n - (85 * n + 99) // 100 + 1),
candidate AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM head a JOIN head b ON a.h = b.h AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
met AS (
  SELECT c.a, c.b, x.n + y.n AS total, len(list_intersect(x.s, y.s)) AS common
  FROM candidate c JOIN text x ON x.rep = c.a JOIN text y ON y.rep = c.b),
near AS (SELECT a, b FROM met WHERE 100 * common >= 85 * (total - common)),
link AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
  least(coalesce(rep, sets.doc_id), coalesce(least.b, sets.doc_id)) AS component_id,
  sets.doc_id IS NULL OR sets.doc_id = least(coalesce(rep, sets.doc_id), coalesce(least.b, sets.doc_id)) AS kept
FROM sets LEFT JOIN text ON sets.doc_id IS NOT NULL AND text.t = sets.t LEFT JOIN least ON least.a = rep
"""

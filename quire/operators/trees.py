"""Operators on page trees and object graphs.

Nodes are keys of any type inside a document (doc_id). Closures run level by level: each step joins only the rows that
the last step added, leaves out what is known by an anti join, and is checkpointed, so cycles end and lineage stays
short. A level bound turns a longer path into a refusal, not into a cut-off result.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import outcome as o

#: The most levels of a page tree, and the most relaxations of use counts.
MOST_DEPTH, MOST_ROUNDS = 64, 33


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder that spark.checkpoint.dir names; where that is unset, a single machine's own folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoints-"))
    return df.checkpoint(eager=True)


def inherited(nodes: DataFrame, value: str, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Rows (doc_id, node, value, levels, error): the nearest declared value up the parents, null if none declares it.

    nodes: rows (doc_id, node, parent, <value>). A path longer than most_depth, as in a cycle, is refused.
    Pointer jumping: each round joins the open nodes with what the nodes they have reached know, so the reach doubles
    and a tree of depth 64 takes seven joins.
    """
    known = F.col("value").isNotNull() | F.col("at").isNull()
    state = nodes.select("doc_id", "node", F.col("parent").alias("at"), F.col(value).alias("value"))
    state = state.select("doc_id", "node", F.when(~known, F.col("at")).alias("at"), "value", F.when(known, 0).otherwise(1).alias("levels"))
    state = checkpointed(state)
    reached = 1
    while reached <= most_depth and not state.where("at is not null").isEmpty():
        up = state.select("doc_id", F.col("node").alias("_at"), F.col("at").alias("_up"), F.col("value").alias("_value"), F.col("levels").alias("_levels"))
        step = state.where("at is not null").alias("o").join(up.alias("u"), (F.col("o.doc_id") == F.col("u.doc_id")) & (F.col("at") == F.col("_at")), "left")
        levels = F.col("levels") + F.coalesce("_levels", F.lit(0))
        step = step.select("o.doc_id", "node", F.col("_up").alias("at"), F.col("_value").alias("value"), levels.alias("levels"))
        state = checkpointed(state.where("at is null").union(step))
        reached *= 2
    deep = F.col("at").isNotNull() | (F.col("levels") > most_depth)
    return state.select(
        "doc_id", "node", F.when(~deep, F.col("value")).alias("value"), F.when(deep, most_depth).otherwise(F.col("levels")).alias("levels"),
        o.refused(deep, "Malformed", "page-tree-too-deep").alias("error"),
    )


def placement(nodes: DataFrame, pages: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Where the pages (doc_id, node) that are to be replaced hang in the tree: rows (doc_id, node, parent, place, depth, error).

    nodes: rows (doc_id, node, parent, ord); place: the position among the parent's kids, from 0. A page that is not in
    the tree, or lies deeper than most_depth, is refused.
    """
    wanted = pages.select("doc_id", "node").distinct()
    roots = nodes.select("doc_id", "node", "parent", F.when(F.col("parent").isNull(), 1).alias("root"))
    depth = inherited(roots, "root", most_depth).select("doc_id", "node", F.col("levels").alias("depth"), "error")
    own = nodes.join(wanted, ["doc_id", "node"], "left_semi").select("doc_id", "node", "parent", "ord")
    kids = nodes.select("doc_id", F.col("parent").alias("_p"), F.col("ord").alias("_ord"))
    before = own.join(kids, (own["doc_id"] == kids["doc_id"]) & (F.col("parent") == F.col("_p")) & (F.col("_ord") < F.col("ord")), "left")
    place = before.groupBy(own["doc_id"], "node", "parent").agg(F.count("_ord").alias("place"))
    found = wanted.join(place, ["doc_id", "node"], "left").join(depth, ["doc_id", "node"], "left")
    error = o.first_error(F.col("error"), o.refused(F.col("depth").isNull(), "Malformed", "page-not-in-tree"))
    return found.select("doc_id", "node", "parent", "place", "depth", error.alias("error"))


def closure(seeds: DataFrame, edges: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """Rows (doc_id, node): seeds and all that edges (doc_id, src, dst) reach from them. Cycles are fine."""
    known = checkpointed(seeds.select("doc_id", "node").distinct())
    fresh = known
    for _ in range(most_levels):
        step = fresh.join(edges.select("doc_id", F.col("src").alias("node"), "dst"), ["doc_id", "node"])
        step = step.select("doc_id", F.col("dst").alias("node")).where("node is not null").distinct()
        fresh = checkpointed(step.join(known, ["doc_id", "node"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = checkpointed(known.union(fresh))
    raise RuntimeError(f"a closure did not end in {most_levels} levels")


def reach(sources: DataFrame, edges: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """Rows (doc_id, source, node): what each source reaches, itself not included unless a cycle leads back."""
    steps = edges.select("doc_id", F.col("src").alias("node"), "dst").distinct()
    known = checkpointed(
        sources.select("doc_id", F.col("node").alias("source"), "node").join(steps, ["doc_id", "node"])
        .select("doc_id", "source", F.col("dst").alias("node")).distinct()
    )
    fresh = known
    for _ in range(most_levels):
        step = fresh.join(steps, ["doc_id", "node"]).select("doc_id", "source", F.col("dst").alias("node")).distinct()
        fresh = checkpointed(step.join(known, ["doc_id", "source", "node"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = checkpointed(known.union(fresh))
    raise RuntimeError(f"a closure did not end in {most_levels} levels")


#: The deepest nesting of streams that is followed, and the most streams of a document that are read.
MOST_NESTED, MOST_STREAMS = 16, 16_384


def names_used(pages: DataFrame, names: DataFrame, resources: DataFrame, most_nested: int = MOST_NESTED, most_streams: int = MOST_STREAMS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, page, name) that a page's streams use, those of the streams that they name included; and (doc_id, error).

    pages: rows (doc_id, page, stream), a page's own content and its annotations' appearances; names: rows (doc_id, stream, name)
    as the streams' content spells them; resources: rows (doc_id, name, stream), stream null for what is no content, which is
    not followed. A document whose streams nest deeper or are more than the bounds is refused and has no rows.
    """
    links = resources.where("stream is not null").select("doc_id", "name", F.col("stream").alias("_to")).distinct()
    links = checkpointed(names.join(links, ["doc_id", "name"]).select("doc_id", "stream", F.col("_to")).distinct())
    known = fresh = checkpointed(pages.select("doc_id", "page", "stream").distinct())
    for _ in range(most_nested + 1):
        step = fresh.join(links, ["doc_id", "stream"]).select("doc_id", "page", F.col("_to").alias("stream")).distinct()
        fresh = checkpointed(step.join(known, ["doc_id", "page", "stream"], "left_anti"))
        if fresh.isEmpty():
            break
        known = checkpointed(known.union(fresh))
    deep = fresh.select("doc_id").distinct().withColumn("error", o.error("Unsupported", "streams-too-deep"))
    followed = known.join(pages, ["doc_id", "page", "stream"], "left_anti").select("doc_id", "stream").distinct()
    many = followed.groupBy("doc_id").count().where(F.col("count") > most_streams).select("doc_id")
    many = many.join(deep, "doc_id", "left_anti").withColumn("error", o.error("Unsupported", "streams-too-many"))
    wrong = deep.unionByName(many)
    used = known.join(names, ["doc_id", "stream"]).select("doc_id", "page", "name").distinct()
    return used.join(wrong, "doc_id", "left_anti"), wrong


def use_counts(base: DataFrame, edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Rows (doc_id, node, uses, settled): uses = base + sum over parents of uses * refs, to a fixpoint.

    base: rows (doc_id, node, uses); edges: rows (doc_id, src, dst, refs). Sums stay at the largest BIGINT. Where a
    cycle keeps counts growing, settled is false after most_rounds: the count is then a lower bound.
    """
    refs = edges.groupBy("doc_id", "src", "dst").agg(F.sum("refs").alias("refs"))
    nodes = base.select("doc_id", "node", "uses").union(refs.select("doc_id", F.col("dst").alias("node"), F.lit(0).cast("bigint").alias("uses")))
    start = checkpointed(nodes.groupBy("doc_id", "node").agg(F.sum("uses").alias("uses")))
    now, settled = start, False
    for _ in range(most_rounds):
        passed = now.join(refs.withColumnRenamed("src", "node"), ["doc_id", "node"]).select(
            "doc_id", F.col("dst").alias("node"), (F.col("uses").cast("decimal(38,0)") * F.col("refs")).alias("more")
        )
        more = passed.groupBy("doc_id", "node").agg(F.sum(F.least("more", F.lit(o.MOST).cast("decimal(38,0)"))).alias("more"))
        total = F.col("uses") + F.coalesce("more", F.lit(0))
        new = start.join(more, ["doc_id", "node"], "left").select(
            "doc_id", "node", F.least(total, F.lit(o.MOST).cast("decimal(38,0)")).cast("bigint").alias("uses")
        )
        new = checkpointed(new)
        settled = new.join(now, ["doc_id", "node", "uses"], "left_anti").isEmpty()
        now = new
        if settled:
            break
    return now.withColumn("settled", F.lit(settled))


def shared_arrays(pages: DataFrame) -> DataFrame:
    """Rows (doc_id, page_no, num, gen, n_pages): pages whose array other pages have too; a direct array (0, 0) is nobody's.

    pages: rows (doc_id, page_no, num, gen). The identity names the group, and n_pages counts its pages: a row a page, however
    many share it.
    """
    real = pages.where("not (num = 0 and gen = 0)").select("doc_id", "page_no", "num", "gen")
    groups = real.groupBy("doc_id", "num", "gen").agg(F.countDistinct("page_no").alias("n_pages")).where("n_pages > 1")
    return real.join(groups, ["doc_id", "num", "gen"]).select("doc_id", "page_no", "num", "gen", "n_pages")


def pruned_resources(resources: DataFrame, used: DataFrame, known: list[str], kept_keys: tuple[str, ...] = ("ProcSet",)) -> DataFrame:
    """resources (doc_id, page_no, num, gen, category, name) without names that no page sharing the dictionary uses.

    used: rows (doc_id, page_no, name). Unknown categories go, except kept_keys; ExtGState is left to the pools.
    """
    identity = ["doc_id", "num", "gen"]
    sharing = resources.select(*identity, "page_no").distinct()
    wanted = sharing.join(used, ["doc_id", "page_no"]).select(*identity, "name").distinct()
    named = resources.where(F.col("category").isin(known) & (F.col("category") != "ExtGState")).join(wanted, [*identity, "name"], "left_semi")
    whole = resources.where(F.col("category").isin(*kept_keys, "ExtGState"))
    return named.select(resources.columns).union(whole)


def pruned_annotations(annotations: DataFrame, output: DataFrame) -> DataFrame:
    """annotations (doc_id, annotation, page_no, ambiguous, owner, dest, uri, goto, next) that an extract keeps.

    output: rows (doc_id, page_no). On an ambiguous page (a shared array) annotations of pages outside go. A
    destination stays if it leads to an output page; an action if it is a URI or leads to an output page, and has
    no follow-up action. Parent, additional actions and structure parent always go.
    """
    inside = output.select("doc_id", F.col("page_no").alias("_p")).distinct().withColumn("_in", F.lit(True))

    def with_in(df: DataFrame, column: str, to: str) -> DataFrame:
        there = inside.select("doc_id", F.col("_p").alias(column), F.col("_in").alias(to))
        return df.join(there, ["doc_id", column], "left").withColumn(to, F.coalesce(to, F.lit(False)))

    known = with_in(with_in(with_in(annotations, "owner", "_owner"), "dest", "_dest"), "goto", "_goto")
    kept = known.where(~F.col("ambiguous") | F.col("_owner"))
    action = F.col("next").isNull() & (F.col("uri").isNotNull() | F.col("_goto"))
    return kept.select("doc_id", "annotation", "page_no", F.col("_dest").alias("keeps_dest"), action.alias("keeps_action"))


def state_pools(states: DataFrame) -> DataFrame:
    """Graphics-state dictionaries pooled by their own identity, else by their holder's, else alone. Adds `pool`.

    states: rows (doc_id, page_no, num, gen, holder_num, holder_gen).
    """
    own = ~((F.col("num") == 0) & (F.col("gen") == 0))
    held = ~((F.col("holder_num") == 0) & (F.col("holder_gen") == 0))
    pool = (
        F.when(own, F.concat_ws(":", F.lit("own"), "num", "gen"))
        .when(held, F.concat_ws(":", F.lit("holder"), "holder_num", "holder_gen"))
        .otherwise(F.concat_ws(":", F.lit("page"), "page_no"))
    )
    return states.withColumn("pool", pool)


def unused_pool_entries(entries: DataFrame, used: DataFrame) -> DataFrame:
    """Entries (doc_id, page_no, pool, name) that no page of their pool uses; used: rows (doc_id, page_no, name)."""
    pages = entries.select("doc_id", "pool", "page_no").distinct()
    wanted = pages.join(used, ["doc_id", "page_no"]).select("doc_id", "pool", "name").distinct()
    return entries.select("doc_id", "pool", "name").distinct().join(wanted, ["doc_id", "pool", "name"], "left_anti")


def referrers(edges: DataFrame) -> DataFrame:
    """Rows (doc_id, num, sites, held, dest_entries) from edges (doc_id, src, num, site); sums that cannot overflow."""

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")

    return edges.groupBy("doc_id", "num").agg(
        F.count("*").alias("sites"), count(F.col("site") == "held").alias("held"), count(F.col("site") == "dest").alias("dest_entries")
    )


def dangling(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """References (doc_id, src, num, gen) with no object, or only null ones; declared: (doc_id, num, gen, kind, in_stream).

    A reference to an object that the file itself declares only as null, outside object streams, is tolerated.
    Rows (doc_id, src, num, gen, error).
    """
    facts = declared.groupBy("doc_id", "num", "gen").agg(
        F.max(F.when(F.col("kind") != "null", 1).otherwise(0)).alias("real"),
        F.max(F.when(F.col("in_stream"), 1).otherwise(0)).alias("streamed"),
    )
    seen = edges.join(facts, ["doc_id", "num", "gen"], "left")
    error = o.first_error(
        o.refused(F.col("real").isNull(), "Malformed", "dangling-reference"),
        o.refused((F.col("real") == 0) & (F.col("streamed") == 1), "Malformed", "null-in-object-stream"),
    )
    return seen.select("doc_id", "src", "num", "gen", error.alias("error")).where("error is not null")


def fonts_on_pages(page_forms: DataFrame, form_fonts: DataFrame, page_fonts: DataFrame) -> DataFrame:
    """Rows (doc_id, font, pages): fonts of the forms a page reaches, and its own.

    page_forms: (doc_id, page_no, form), already closed over forms; form_fonts: (doc_id, form, font); page_fonts.
    """
    through = page_forms.join(form_fonts, ["doc_id", "form"]).select("doc_id", "font", "page_no")
    return through.union(page_fonts.select("doc_id", "font", "page_no")).groupBy("doc_id", "font").agg(
        F.array_sort(F.collect_set("page_no")).alias("pages")
    )


def parts_on_pages(font_parts: DataFrame, font_pages: DataFrame) -> DataFrame:
    """Rows (doc_id, part, pages): font programs and maps, by the pages of the fonts that hold them."""
    pages = font_parts.join(font_pages, ["doc_id", "font"]).select("doc_id", "part", F.explode("pages").alias("page_no"))
    return pages.groupBy("doc_id", "part").agg(F.array_sort(F.collect_set("page_no")).alias("pages"))


def pages_outside(pages: Column, redacted: Column) -> Column:
    return F.size(F.array_except(pages, redacted))


def wholly_within(pages: Column, redacted: Column) -> Column:
    """Do all pages of a font or part lie among the redacted ones?"""
    return pages_outside(pages, redacted) == 0


def value_refusals(entries: DataFrame) -> DataFrame:
    """Rows (doc_id, num, key, error) of dictionary entries (doc_id, num, key, value) that readers disagree about.

    Judged in this order: a key without a name, a value that is missing, a value that is written as null.
    """
    error = o.first_error(
        o.refused(F.col("key") == "", "Malformed", "empty-key"),
        o.refused(F.coalesce(F.col("value"), F.lit("")) == "", "Malformed", "empty-value"),
        o.refused(F.col("value") == "null", "Unsupported", "null-value"),
    )
    return entries.select("doc_id", "num", "key", error.alias("error")).where("error is not null")


def kept_dependents(annotations: DataFrame, links: DataFrame, removed: DataFrame) -> DataFrame:
    """Kept annotations that still refer to a removed one: a refusal. links: rows (doc_id, src, dst)."""
    kept = annotations.select("doc_id", F.col("annotation").alias("src")).join(
        removed.select("doc_id", F.col("node").alias("src")), ["doc_id", "src"], "left_anti"
    )
    bad = links.join(kept, ["doc_id", "src"], "left_semi").join(removed.select("doc_id", F.col("node").alias("dst")), ["doc_id", "dst"], "left_semi")
    return bad.select("doc_id", "src", "dst")

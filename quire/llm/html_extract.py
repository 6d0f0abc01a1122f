"""HTML extraction: gradient-boosted trees over DOM-node features, decoded along the tree.

A page is parsed into block-level nodes. For each node the trees give the log-odds that its subtree holds main text;
features are the subtree's density (text, links, sentence marks, blocks), its place among siblings and in the page,
depth, tag, and the words of class, id and role attributes of itself and its ancestors. Decoding picks the likeliest
labelling of the whole tree in which a kept node's parent is kept and a node kept without text of its own has a
kept child, by one bottom-up and one top-down pass; so no ancestor and descendant contradict each other.
The kept nodes' text blocks, in page order, are the main text.

The model is trained here: on pages that `sample_page` writes from a seed, whose nodes' labels are known. No table is
read for it, no page is left out of its use, and pages are handled where they lie, without a shuffle.

Rows: a null or empty html gives an empty text. Cut-off pages, unclosed and misnested tags are read as far as they go;
markup that the end cuts off is dropped. A `br` is white space. Pages without main text give an empty text. Repeated
rows are repeated. Other columns pass through; ones named text or n_chars are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .common import table
from .dom import HINT, Node, blocks, features, parse, preorder

MAIN = "data-main"


def sample_page(r: np.random.Generator) -> str:
    """A random page in which the elements that hold main text directly carry the mark MAIN in their tag."""

    def words(n: int) -> str:
        return " ".join("".join(chr(97 + int(c)) for c in r.integers(0, 26, int(r.integers(2, 9)))) for _ in range(max(1, n)))

    def sentence(n: int) -> str:
        return words(n).capitalize() + "."

    def prose(mean: float) -> str:
        n = 1 + int(r.geometric(1 / mean))
        return " ".join(sentence(int(r.integers(1, 18))) for _ in range(n))

    def chance(p: float) -> bool:
        return bool(r.random() < p)

    def pick(*xs):
        return xs[int(r.integers(len(xs)))]

    def attr(*names: str, p: float = 0.75) -> str:
        if not chance(p):
            return ""
        extra = f" {words(1)}" if chance(0.3) else ""
        return f' {pick("class", "class", "id")}="{pick(*names)}{extra}"'

    def links(n: int, wrap: bool = True) -> str:
        items = [f'<a href="/{words(1)}">{words(int(r.integers(1, 4)))}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if wrap else pick(" ", " | ").join(items)

    def menu() -> str:
        body = links(int(r.integers(2, 12)), chance(0.8))
        return f"<nav>{body}</nav>" if chance(0.6) else f'<div{attr("nav", "menu", "navbar", "main-menu", "breadcrumbs", p=1)}>{body}</div>'

    def advert() -> str:
        return f'<{(t := pick("div", "div", "aside", "section"))}{attr("ad", "ads", "advert", "sponsored", "promo", "ad-box", p=1)}>{pick(sentence(8), prose(2), f"<p>{prose(2)}</p>", links(2, False))}</{t}>'

    def notice() -> str:
        if chance(0.15):
            return f"<noscript>{pick('', '<p>')}{prose(1)}</noscript>"
        return f'<div{attr("cookie-notice", "consent", "alert", "notice", "gdpr", "popup", p=1)}>{pick("", "<p>")}{prose(2)} <button>{words(1)}</button></div>'

    def form() -> str:
        return f'<form{attr("search", "subscribe", "newsletter", "login", p=0.5)}>{pick(sentence(5), f"<label>{words(2)}</label>", f"<p>{prose(1)}</p>")}<input name="q"><button>{words(1)}</button></form>'

    def share() -> str:
        return f'<div{attr("share", "social", "tags", "byline", "post-meta", p=1)}>{links(int(r.integers(2, 5)), chance(0.5))}</div>'

    def comments() -> str:
        one = [f'<{(t := pick("div", "li", "article"))}{attr("comment", "reply", p=0.7)}><b>{words(1)}</b><p>{prose(2)}</p></{t}>' for _ in range(int(r.integers(1, 6)))]
        return f'<{(t := pick("section", "div"))}{attr("comments", "discussion", "responses", p=1)}><h3>{words(2)}</h3>{"".join(one)}</{t}>'

    def sidebar() -> str:
        body = "".join(pick(f"<h4>{words(2)}</h4>{links(int(r.integers(2, 8)))}", advert(), f"<p>{prose(1)}</p>", form()) for _ in range(int(r.integers(1, 4))))
        return f"<aside{attr('sidebar', 'widget', 'related')}>{body}</aside>" if chance(0.6) else f'<div{attr("sidebar", "widget-area", "related-posts", "rail", p=1)}>{body}</div>'

    def footer() -> str:
        body = f"{pick('&copy;', 'Copyright', '')} {words(2)} &middot; {pick(sentence(10), prose(2), links(4, False), links(5))}"
        return f"<footer>{pick(body, f'<p>{body}</p>')}</footer>" if chance(0.8) else f'<div{attr("footer", "site-footer", "copyright", p=1)}>{body}</div>'

    def header() -> str:
        return f"<header{attr('header', 'masthead', p=0.4)}>{pick('', f'<a href=/>{words(2)}</a>', f'<div>{words(3)}</div>')}{menu() if chance(0.6) else ''}{form() if chance(0.2) else ''}</header>"

    def article() -> str:
        parts = [f"<h1 {MAIN}>{words(int(r.integers(1, 12)))}</h1>"] if chance(0.85) else []
        mean = pick(1, 2, 4, 8)
        for _ in range(int(r.integers(1, 4)) if chance(0.25) else int(r.integers(3, 25))):
            kind = r.random()
            text = sentence(int(r.integers(1, 4))) if chance(0.15) else prose(mean)
            if chance(0.15):
                text = text.replace(" ", f' <a href="/{words(1)}">{words(1)}</a> ', 1)
            if kind < 0.66:
                parts.append(f"<p {MAIN}>{text}</p>")
            elif kind < 0.76:
                parts.append(f"<p {MAIN}><b>{text}<br>")
            elif kind < 0.82:
                parts.append(f"<h2 {MAIN}>{words(4)}</h2>")
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li {MAIN}>{sentence(int(r.integers(1, 12)))}</li>" for _ in range(int(r.integers(2, 6)))) + "</ul>")
            elif kind < 0.90:
                parts.append(f"<blockquote><p {MAIN}>{text}</p></blockquote>")
            elif kind < 0.92:
                parts.append(f"<pre {MAIN}>{text}</pre>")
            elif kind < 0.94:
                parts.append("<table>" + "".join(f"<tr><td {MAIN}>{words(2)}</td><td {MAIN}>{words(2)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(pick(advert, advert, share, form, sidebar, notice)())
        if chance(0.2):
            parts.append(share())
        if chance(0.1):
            parts.append(comments())
        body = "".join(parts)
        kind = r.random()
        if kind < 0.6:
            return f"<article{attr('post', 'article', 'entry', 'content', p=0.3)}>{body}</article>"
        if kind < 0.75:
            return f'<div{attr("content", "post-body", "article-text", "entry", "story", p=0.9)}>{body}</div>'
        if kind < 0.9:
            return f"<section>{pick(body, f'<div>{body}</div>')}</section>"
        return body

    top = [x() for x, p in ((notice, 0.15), (header, 0.5), (menu, 0.7), (advert, 0.4), (form, 0.1)) if chance(p)]
    middle = [article()]
    if chance(0.35):
        middle.insert(int(r.integers(0, 2)), sidebar())
    if chance(0.25):
        middle.append(comments())
    inner = "".join(middle)
    if chance(0.35):
        inner = pick(f"<main>{inner}</main>", f'<div id="main">{inner}</div>', f"<div><div>{inner}</div></div>")
    bottom = [x() for x, p in ((advert, 0.15), (sidebar, 0.1), (footer, 0.85), (notice, 0.15)) if chance(p)]
    page = f"<html><head><title>{words(3)}</title></head><body>{''.join(top)}{inner}{''.join(bottom)}</body></html>"
    return page[: int(len(page) * r.uniform(0.4, 1))] if chance(0.15) else page


def _labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    HINT["datamainmark"] = [_MARK]
    try:
        nodes = preorder(parse(page.replace(f" {MAIN}>", ' role="datamainmark">')))
    finally:
        del HINT["datamainmark"]
    marked = np.array([_MARK in x.hints for x in nodes])
    for x in nodes:
        x.hints = tuple(h for h in x.hints if h != _MARK)
    y = marked & np.array([bool(blocks(x)) for x in nodes])
    for x in reversed(nodes):
        if x.parent is not None and y[x.order]:
            y[x.parent.order] = True
    return features(nodes), y


_MARK = -1


@functools.lru_cache(maxsize=2)
def trained(pages: int = 500, seed: int = 4) -> dict:
    """The model, from `pages` written pages."""
    r = np.random.default_rng(seed)
    parts = [_labelled(sample_page(r)) for _ in range(pages)]
    return boosting.fit(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]).astype(float))


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept in the likeliest consistent labelling, from log-odds of being kept."""
    keep_log, drop_log = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    m = len(nodes)
    keep, drop = keep_log.copy(), drop_log.copy()
    has_text = [bool(blocks(x)) for x in nodes]
    forced = np.full(m, -1)  # the child kept at least, where none would be by itself
    for i in range(m - 1, -1, -1):
        x, any_kept, cost, at = nodes[i], has_text[i], np.inf, -1
        for c in x.children:
            k = c.order
            drop[i] += drop[k]
            keep[i] += max(keep[k], drop[k])
            if keep[k] > drop[k]:
                any_kept = True
            elif drop[k] - keep[k] < cost:
                cost, at = drop[k] - keep[k], k
        if not any_kept:
            keep[i] = keep[i] - cost if at >= 0 else -np.inf
            forced[i] = at
    out = np.zeros(m, bool)
    out[0] = keep[0] > drop[0]
    for i in range(m):
        if out[i]:
            for c in nodes[i].children:
                out[c.order] = keep[c.order] > drop[c.order] or forced[i] == c.order
    return out


def main_texts(pages: list[str | None], model: dict) -> list[str]:
    trees = [preorder(parse(p)) if p else [] for p in pages]
    full = [t for t in trees if t]
    odds = boosting.log_odds(model, np.concatenate([features(t) for t in full])) if full else np.empty(0)
    out, at = [], 0
    for nodes in trees:
        if not nodes:
            out.append("")
            continue
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(_in_order(nodes[0], kept)))
    return out


def _in_order(root: Node, kept: np.ndarray) -> list[str]:
    """The text blocks of kept nodes, in page order."""
    out: list[str] = []
    todo: list = [root] if kept[root.order] else []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        pieces: list = []
        run = Node(x.tag, None)
        for part in x.parts:
            if isinstance(part, tuple):
                run.parts.append(part)
            else:
                pieces += blocks(run)
                run.parts = []
                if kept[part.order]:
                    pieces.append(part)
        pieces += blocks(run)
        todo += reversed(pieces)
    return out


def extract(pages: DataFrame, html_col: str = "html", chunk: int = 200, chunk_chars: int = 4_000_000, train_pages: int = 500) -> DataFrame:
    """pages with text and n_chars (its code points). Up to `chunk` pages or about `chunk_chars` are in work at once."""
    pages = pages.drop("text", "n_chars")
    shared = pages.sparkSession.sparkContext.broadcast(trained(train_pages))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            sizes = [n or 0 for n in pc.binary_length(batch.column(html_col)).to_pylist()]
            k = 0
            while k < batch.num_rows:
                end, size = k, 0
                while end < batch.num_rows and end - k < chunk and (end == k or size + sizes[end] <= chunk_chars):
                    size += sizes[end]
                    end += 1
                piece = batch.slice(k, end - k)
                k = end
                texts = main_texts(piece.column(html_col).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*piece.schema.names, "text", "n_chars"],
                )

    more = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return pages.mapInArrow(part, T.StructType([*pages.schema.fields, *more]))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html"))
    return extract(pages).drop("html")

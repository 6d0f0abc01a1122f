"""Mixing sources to target weights by soft membership. DataFrame functions only.

1. Classifier. Labelled documents (at most `train_rows`, those with the smallest hash of doc_id) are read as sets of
   hashed words and of levels of the share of odd words (capitals, signs, digits). One aggregate counts, per feature and
   domain, the documents that hold it; features of fewer than `least_docs` documents are left out. A feature speaks for a domain
   if its share there is above the base domain's by `least_z` standard errors and by a factor of `least_ratio`; the
   `most_features` best of them (None: all) are the domain's model (Bernoulli: presence and absence count). Posteriors are
   the normalised exponentials of prior and evidence. These five are parameters of the classifier alone.
2. Rates. Every document d gets a rate r_d >= 0, the expected number of its copies, such that the expected token
   totals of the domains, sum over d of r_d * tokens_d * posterior_dk, match the targets by weighted least squares: half the sum of
   the squared gaps, each over its target. Projected gradients from r = 1: r_d = max(0, r_d - step * sum over k of
   posterior_dk * gap_k / target_k), the gradient in the metric of the tokens. A first step is the inverse of a bound on the
   K x K matrix of products of the posteriors; later ones are Barzilai-Borwein steps, taken back where the squares grow.
   A step is one aggregate over all documents; only K totals and a length reach the driver. A document's rate is state: it is
   stored every few steps, and is the same fold over the steps' K numbers, which is how it is attached to the documents.
   It ends when all gaps are within `tolerance` of the targets' sum, or no rate moves any more; targets that no rates >= 0 meet
   leave the least squares, with a warning of the gaps.
3. Copies: floor(r + u) with u a hash of the document's id.

Targets are weights per domain; the grand total is such that the `anchor` domain keeps its expected tokens.

`thin` is for a corpus in which no document is repeated: rates lie in 0..1 and are probabilities of staying. The same least
squares between both bounds, with targets that rates up to 1 can meet: the anchor is to keep all its tokens, another domain as many
as its weight relative to them, or all where it has fewer. The anchor's gap weighs `anchor_weight` times: what cannot be told from
the anchor's documents (a domain's probability that is spread over all of them) is left, with a warning, rather than paid for
with these.

Rows: a null or empty text has no tokens, the prior as posterior and a rate like others. Documents without a label are
scored like those with one; labels of missing documents are ignored. A null doc_id is hashed like a value. Repeated rows
are documents each. Other columns pass through; ones named like a result column are replaced. Without labelled rows every
posterior is even; a domain without any has no posterior and no target. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import set_apart, stored, table

#: The query's production parameters: domains by label, and the share of tokens each is to have.
DOMAINS = ("clean", "junk", "toxic")
WEIGHTS = {"clean": 0.97, "junk": 0.01, "toxic": 0.02}


def domain_of(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, domain) from labels (doc_id, quality, toxic); rows without both labels are left out."""
    kind = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    return labels.where("quality is not null and toxic is not null").select("doc_id", kind.alias("domain"))


#: Levels, in hundredths, of the share of odd words in a text.
LEVELS = (1, 2, 5, 10, 20, 35, 50, 70, 90)


def plain_words_of(text: Column) -> Column:
    """A text's words without case and signs."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def levels_of(text: Column, tokens: Column) -> Column:
    """The levels that the share of odd words in a text reaches, as features (` odd 50`; no word holds a space)."""
    usual = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?<!\S)\p{L}\p{Ll}*[.,]?(?!\S)"))
    share = F.struct(((tokens - usual) * 100).alias("odd"), F.greatest(tokens, F.lit(1)).alias("all"))
    levels = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(f" odd {k}").alias("f")) for k in LEVELS))
    # the outer transform makes the share a value, which the levels then only compare with
    reached = F.transform(F.array(share), lambda s: F.filter(levels, lambda x: s["odd"] >= x["k"] * s["all"]))
    return F.transform(F.flatten(reached), lambda x: x["f"])


def train(
    docs: DataFrame,
    labelled: DataFrame,
    domains: tuple[str, ...],
    train_rows: int,
    least_docs: int,
    least_z: float,
    least_ratio: float,
    most_features: int | None,
) -> list[tuple[float, dict[str, float]]]:
    """Per domain, against the first: the log-odds of none of its features, and what each one adds."""
    picked = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(*domains))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(train_rows)  # the model's documented bound
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # the empty feature counts the documents themselves
    words = F.array_distinct(F.filter(plain_words_of(F.col("text")), lambda w: w != ""))
    held = F.concat(F.array(F.lit("")), words, levels_of(F.col("text"), tokens_of(F.col("text"))))
    seen = rows.select("domain", F.explode(held).alias("f"))
    counts = seen.groupBy("f").agg(*(F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains)))
    counts = stored(counts.where("n0 + " + " + ".join(f"n{k}" for k in range(1, len(domains))) + f" >= {least_docs} or f = ''"))
    sizes = counts.where("f = ''").first()
    size = [sizes[f"n{k}"] if sizes else 0 for k in range(len(domains))]
    # a domain without labelled documents has no posterior, unless no domain has any
    nothing = [-700.0 if any(size) and not n else 0.0 for n in size]
    out = [(nothing[0], {})]
    for k in range(1, len(domains)):
        p, q = (F.col(f"n{k}") + 0.5) / (size[k] + 1), (F.col("n0") + 0.5) / (size[0] + 1)
        error = F.sqrt(p * (1 - p) / (size[k] + 1) + q * (1 - q) / (size[0] + 1))
        told = counts.where("f <> ''").select("f", p.alias("p"), q.alias("q"), error.alias("e"))
        told = told.where((F.col("p") - F.col("q") >= least_z * F.col("e")) & (F.col("p") >= least_ratio * F.col("q")))
        best = told.orderBy(((F.col("q") - F.col("p")) * F.ln(F.col("p") / F.col("q"))), "f")
        best = best if most_features is None else best.limit(most_features)
        base, weights = nothing[k] or math.log((size[k] + 1) / (size[0] + 1)), {}
        for r in best.collect() if size[k] and size[0] else ():
            absent = math.log((1 - r["p"]) / (1 - r["q"]))
            weights[r["f"]] = math.log(r["p"] / r["q"]) - absent
            base += absent
        out.append((base, weights))
    return out


def posteriors(docs: DataFrame, model: list[tuple[float, dict[str, float]]], text_col: str = "text") -> DataFrame:
    """docs with `posterior`, an array of one probability per domain, and `tokens`."""
    every = sorted({f for _, weights in model for f in weights})
    # a document holds few of the model's words: only these are looked up
    known = F.array(*map(F.lit, every)) if every else F.expr("cast(array() as array<string>)")
    held = F.concat(F.array_intersect(plain_words_of(F.col(text_col)), known), levels_of(F.col(text_col), F.col("tokens")))

    def gathered(weights: dict[str, float]) -> Column:
        if not weights:
            return F.lit(0.0)
        known = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
        return F.aggregate("_f", F.lit(0.0), lambda s, f: s + F.coalesce(F.try_element_at(known, f), F.lit(0.0)))

    def once(df: DataFrame, **columns: Column) -> DataFrame:
        """df with columns that no later expression or pushed-down filter evaluates again: a generator of one row."""
        made = df.withColumn("_once", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
        return made.withColumns({n: F.col(f"_once.{n}") for n in columns}).drop("_once")

    docs = once(docs, tokens=tokens_of(F.col(text_col)))
    docs = once(docs, _f=held)
    logs = [gathered(weights) + base for base, weights in model]
    docs = once(docs, _z=F.array(*logs))
    z = [F.col("_z")[k] for k in range(len(logs))]
    powers = [F.exp(x - F.greatest(F.lit(0.0), *z)) for x in z]
    total = sum(powers[1:], powers[0])
    return docs.withColumn("posterior", F.array(*(x / total for x in powers))).drop("_f", "_z")


def stepped(rate: Column, x: list[Column], step: list, most: float | None) -> Column:
    """A rate after one step, projected on 0 .. most."""
    move = sum((a * (b if isinstance(b, Column) else F.lit(b)) for a, b in zip(x, step, strict=True)), F.lit(0.0))
    moved = F.greatest(F.lit(0.0), rate - move)
    return moved if most is None else F.least(F.lit(most), moved)


def rate_of(x: list[Column], steps: list[list[float]], most: float | None) -> Column:
    """A document's rate, from its K numbers x: the fold of the steps, from 1."""
    if not steps:
        return F.lit(1.0)
    every = F.array(*(F.array(*map(F.lit, step)) for step in steps))
    return F.aggregate(every, F.lit(1.0), lambda r, s: stepped(r, x, [s[k] for k in range(len(x))], most))


#: A rate is stored after so many steps.
KEPT = 5


def fit(
    docs: DataFrame, x: list[Column], gaps_of, scale: list[float], most: float | None, within: float, most_steps: int, stall: float = 1e-12
) -> tuple[list[list[float]], list[float]]:
    """The steps, and the gaps that remain. docs: rows (tokens, ...) that x is read from; gaps_of: gaps from the K totals.

    It also ends where a step lowers the squares by no more than `stall` of them.
    """
    n = len(x)
    rows = docs.select(F.col("tokens").cast("double").alias("t"), *(c.alias(f"x{k}") for k, c in enumerate(x)), F.lit(1.0).alias("r"))
    x, t = [F.col(f"x{k}") for k in range(n)], F.col("t")
    products = [F.sum(t * x[i] * x[j]) for i in range(n) for j in range(n)]
    first = [float(v or 0) for v in rows.agg(*(F.sum(t * c) for c in x), *products).first()]
    totals, gram = first[:n], [first[n + i * n : n + (i + 1) * n] for i in range(n)]
    # no step is shorter than the inverse of the largest row sum of the scaled products, which bounds their largest eigenvalue
    rows_sums = [sum(abs(gram[i][j]) / math.sqrt(scale[i] * scale[j]) for j in range(n)) for i in range(n)]
    least = 1 / max([*rows_sums, 1e-300])
    gaps, length, steps, pending = gaps_of(totals), least, [], []
    square = sum(g * g / s for g, s in zip(gaps, scale, strict=True))
    for _ in range(4 * most_steps):
        if len(steps) >= most_steps or max(map(abs, gaps), default=0.0) <= within:
            break
        step = [length * g / s for g, s in zip(gaps, scale, strict=True)]
        old = F.col("r")
        for past in pending:
            old = stepped(old, x, past, most)
        new = stepped(old, x, step, most)
        got = [float(v or 0) for v in rows.agg(F.sum(t * (new - old) * (new - old)), *(F.sum(t * new * c) for c in x)).first()]
        moved, now = got[0], got[1:]
        then = gaps_of(now)
        squared = sum(g * g / s for g, s in zip(then, scale, strict=True))
        if squared > square and length > least:
            length = least
            continue
        steps.append(step), pending.append(step)
        curve = sum((b - a) * (h - g) / s for a, b, g, h, s in zip(totals, now, gaps, then, scale, strict=True))
        length = max(least, moved / curve) if curve > 0 else least
        done = square - squared <= stall * square
        totals, gaps, square = now, then, squared
        if done:  # as near as the bounds let the rates come
            break
        if len(pending) == KEPT:
            for past in pending:
                rows = rows.withColumn("r", stepped(F.col("r"), x, past, most))
            rows, pending = stored(rows), []
    return steps, gaps


def of_domain(domains: tuple[str, ...]) -> list[Column]:
    return [F.col("posterior")[k] for k in range(len(domains))]


def fit_rates(docs: DataFrame, domains: tuple[str, ...], weights: dict[str, float], anchor: str, tolerance: float, most_steps: int) -> list[list[float]]:
    """The steps of the rates >= 0, from docs (tokens, posterior)."""
    p = of_domain(domains)
    found = docs.agg(*(F.sum(F.col("tokens") * c) for c in p)).first()
    totals = [float(v or 0) for v in found]
    grand = totals[domains.index(anchor)] / weights[anchor]
    if grand <= 1e-9 * sum(totals):
        return []
    # what has next to no tokens at any rates cannot be brought to a target
    target = [weights[d] * grand if s > 1e-12 * grand else None for d, s in zip(domains, totals, strict=True)]

    def gaps_of(now: list[float]) -> list[float]:
        return [0.0 if want is None else have - want for have, want in zip(now, target, strict=True)]

    scale = [want or grand for want in target]
    steps, gaps = fit(docs, p, gaps_of, scale, None, tolerance * grand, most_steps)
    if max(map(abs, gaps)) > tolerance * grand:
        warnings.warn(f"no rates meet the targets: {dict(zip(domains, gaps, strict=True))} tokens too many", stacklevel=2)
    return steps


def with_rates(
    docs: DataFrame,
    weights: dict[str, float],
    domains: tuple[str, ...],
    tolerance: float = 1e-4,
    most_steps: int = 100,
    seed: int = 7,
) -> DataFrame:
    """docs (doc_id, tokens, posterior, ..., stored) with rate and copies."""
    steps = fit_rates(docs.select("tokens", "posterior"), domains, weights, domains[0], tolerance, most_steps)
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    out = docs.withColumn("rate", rate_of(of_domain(domains), steps, None))
    return out.withColumn("copies", F.floor(F.col("rate") + u).cast("long"))


RESULT = ("tokens", "posterior", "rate", "copies")


def classified(
    docs: DataFrame,
    labelled: DataFrame,
    domains: tuple[str, ...],
    train_rows: int = 20_000,
    least_docs: int = 5,
    least_z: float = 4.0,
    least_ratio: float = 3.0,
    most_features: int | None = 64,
) -> DataFrame:
    """docs with tokens and posterior, one probability per domain; the first domain is the base."""
    docs, back = set_apart(docs.drop(*RESULT), "doc_id", "text")
    model = train(docs, labelled, domains, train_rows, least_docs, least_z, least_ratio, most_features)
    return back(posteriors(docs, model), "tokens", "posterior")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str, **classifier) -> DataFrame:
    """docs with tokens, posterior, rate and copies. They are stored with their posteriors rather than classified twice."""
    domains = (anchor, *(d for d in weights if d != anchor))
    return with_rates(stored(classified(docs, labelled, domains, **classifier)), weights, domains)


def fit_thinning(
    docs: DataFrame, domains: tuple[str, ...], weights: dict[str, float], tolerance: float, most_steps: int, anchor_weight: float = 100.0, stall: float = 1e-3
) -> list[list[float]]:
    """The steps of the rates in 0..1, from docs (tokens, posterior); the anchor is the first domain."""
    p = of_domain(domains)
    totals = [float(v or 0) for v in docs.agg(*(F.sum(F.col("tokens") * c) for c in p)).first()]
    anchor = totals[0]
    if anchor <= 1e-9 * sum(totals):
        return []
    target = [anchor, *(min(s, anchor * weights[d] / weights[domains[0]]) for d, s in zip(domains[1:], totals[1:], strict=True))]

    def gaps_of(now: list[float]) -> list[float]:
        return [have - want for have, want in zip(now, target, strict=True)]

    scale = [anchor / anchor_weight, *(max(t, 1e-6 * anchor) for t in target[1:])]
    steps, gaps = fit(docs, p, gaps_of, scale, 1.0, tolerance * anchor, most_steps, stall)
    if max(map(abs, gaps)) > tolerance * anchor:
        warnings.warn(f"no rates meet the targets: {dict(zip(domains, gaps, strict=True))} tokens too many, beside {anchor}", stacklevel=2)
    return steps


def thin(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str, tolerance: float = 1e-4, most_steps: int = 60, seed: int = 7, **classifier
) -> DataFrame:
    """The docs that stay, each at most once, with tokens, posterior and rate."""
    domains = (anchor, *(d for d in weights if d != anchor))
    found = stored(classified(docs, labelled, domains, **classifier))
    steps = fit_thinning(found.select("tokens", "posterior"), domains, weights, tolerance, most_steps)
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return found.withColumn("rate", rate_of(of_domain(domains), steps, 1.0)).where(F.col("rate") + u >= 1)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = stored(classified(docs, domain_of(table(spark, sf_dir, "labels")), DOMAINS).drop("text"))
    found = with_rates(found, WEIGHTS, DOMAINS)
    p = F.col("posterior")
    return found.select("doc_id", "source", "tokens", *(p[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", "copies")

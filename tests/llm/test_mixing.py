import numpy as np
import pytest

from quire.llm import mixing as m

SF = "/root/testdata/sf0.1"


def test_query_meets_targets(spark):
    got = m.op7_mix(spark, SF)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = got.collect()
    p = np.array([[r[f"p_{d}"] for d in m.DOMAINS] for r in rows])
    t, rate = np.array([r.tokens for r in rows]), np.array([r.rate for r in rows])
    totals = (t * rate) @ p
    print("shares before", t @ p / t.sum(), "after", totals / totals.sum())
    assert np.allclose(totals / totals.sum(), [m.WEIGHTS[d] for d in m.DOMAINS], atol=2e-3)
    assert abs(p.sum(1) - 1).max() < 1e-9 and (rate >= 0).all()
    labels = {r.doc_id: r.domain for r in m.domain_of(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    right = [m.DOMAINS[int(np.argmax(x))] == labels[r.doc_id] for r, x in zip(rows, p, strict=True) if r.doc_id in labels]
    lost = [r.copies == 0 for r in rows if labels.get(r.doc_id) == "clean"]
    kept = [r.copies > 0 for r in rows if labels.get(r.doc_id) == "toxic"]
    print("accuracy", np.mean(right), "clean lost", np.mean(lost), "toxic kept", np.mean(kept))
    assert np.mean(right) > 0.9 and np.mean(lost) < 0.02


def dense(t, x, gaps_of, scale, most, within, steps):
    """Projected gradients over dense arrays: a rate per row, the last gaps."""
    t = t.astype(float)
    gram = (x * t[:, None]).T @ x / np.sqrt(np.outer(scale, scale))
    least = length = 1 / np.abs(gram).sum(1).max()
    r = np.ones(len(t))
    totals = (t * r) @ x
    for _ in range(steps):
        gap = gaps_of(totals)
        if np.abs(gap).max() <= within:
            break
        new = np.clip(r - length * x @ (gap / scale), 0, most)
        now = (t * new) @ x
        then = gaps_of(now)
        if (then**2 / scale).sum() > (gap**2 / scale).sum() and length > least:
            length = least
            continue
        curve = ((now - totals) * (then - gap) / scale).sum()
        length = max(least, (t * (new - r) ** 2).sum() / curve) if curve > 0 else least
        r, totals = new, now
    return r, gaps_of(totals)


def sample(spark, n=400):
    r = np.random.default_rng(4)
    p = r.dirichlet([0.5, 0.3, 0.3], n)
    t = r.integers(1, 500, n)
    rows = [(int(a), [float(x) for x in b], k) for k, (a, b) in enumerate(zip(t, p, strict=True))]
    return t, p, spark.createDataFrame(rows, "tokens long, posterior array<double>, k long")


def test_rates_against_dense_projected_gradients(spark):
    """Rate by rate against numpy; the targets are met, or, where no rates meet them, the gradient allows no descent."""
    t, p, frame = sample(spark)
    for weights in ({"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 0.05, "b": 0.05, "c": 0.9}, {"a": 0.85, "b": 0.1, "c": 0.05}):
        steps = m.fit_rates(frame, tuple(weights), weights, "a", 1e-4, 100)
        got = frame.select("k", m.rate_of(m.of_domain(tuple(weights)), steps, None).alias("r")).orderBy("k").collect()
        rate = np.array([x.r for x in got])
        grand = (t @ p)[0] / weights["a"]
        target = grand * np.array(list(weights.values()))
        want, gap = dense(t, p, lambda s, target=target: s - target, target, np.inf, 1e-4 * grand, 100)
        assert np.allclose(rate, want, atol=1e-6) and (rate >= 0).all()
        slope = p @ (((t * rate) @ p - target) / target)  # of half the scaled squares, per token
        assert np.abs(gap).max() <= 1e-4 * grand or (np.abs(slope[rate > 1e-9]).max() < 1e-3 and (slope[rate <= 1e-9] > -1e-3).all())
    assert np.allclose((t * rate) @ p / ((t * rate) @ p).sum(), target / target.sum(), atol=2e-2)


@pytest.mark.parametrize("weights", [{"a": 0.8, "b": 0.15, "c": 0.05}, {"a": 0.97, "b": 0.01, "c": 0.02}])
def test_thinning_against_dense_projected_gradients(spark, weights):
    """Rate by rate against numpy; a domain above its weight comes down towards it, and the anchor keeps its tokens."""
    t, p, frame = sample(spark)
    steps = m.fit_thinning(frame, tuple(weights), weights, 1e-4, 60, stall=0)
    rate = np.array([r.r for r in frame.select("k", m.rate_of(m.of_domain(tuple(weights)), steps, 1.0).alias("r")).orderBy("k").collect()])
    anchor = (t @ p)[0]
    target = np.minimum(t @ p, anchor * np.array(list(weights.values())) / weights["a"])
    scale = target * np.array([0.01, 1, 1])
    want, gap = dense(t, p, lambda s: s - target, scale, 1.0, 1e-4 * anchor, len(steps))
    left = (t * rate) @ p
    print(weights, "steps", len(steps), "before", t @ p, "target", target, "after", left)
    assert np.allclose(rate, want, atol=1e-6) and (rate >= 0).all() and (rate <= 1).all()
    assert left[0] > 0.8 * anchor and (left[1:] < (t @ p)[1:]).all()


def test_what_cannot_be_told_apart_stays(spark):
    """Three of a hundred labels say junk, of texts like all others: no clean document is paid for that."""
    kind = lambda k: "toxic" if k % 20 == 1 else "junk" if k % 33 == 0 else "clean"
    texts = [(k, "vile slur words" if kind(k) == "toxic" else f"plain words {k % 7} of {k % 11} text") for k in range(4000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, kind(k)) for k in range(4000)], "doc_id long, domain string")
    rows = {r.doc_id for r in m.thin(frame, labels, m.WEIGHTS, "clean").collect()}
    kept = {d: sum(k in rows for k in range(4000) if kind(k) == d) / sum(kind(k) == d for k in range(4000)) for d in m.WEIGHTS}
    print(kept)
    assert kept["clean"] > 0.99 and kept["junk"] > 0.95 and 0.6 < kept["toxic"] < 0.9


def test_rows(spark):
    names = ("_f", "_z", "_once", "t", "r", "x0", "f", "n0")
    schema = "doc_id long, text string, source string, rate string, " + ", ".join(f"{c} string" for c in names)
    docs = [(k, "plain words of a text" if k % 2 else "vile slur words", "s", "clash") for k in range(100)]
    docs += [(None, "plain", "s", ""), (200, None, None, ""), (201, "", "s", ""), (1, "plain words of a text", "s", "clash"), (202, "plain " * 100_000, "s", "")]
    frame = spark.createDataFrame([(*d, *names) for d in docs], schema)
    labels = spark.createDataFrame([(k, 1, 1 - k % 2) for k in range(100)] + [(None, 1, 1), (7, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    got = m.mix(frame, m.domain_of(labels), m.WEIGHTS, "clean").collect()
    assert all(tuple(r[c] for c in names) == names for r in got)
    assert len(got) == len(docs) and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in got)
    assert {r.tokens for r in got if r.doc_id in (200, 201)} == {0}
    totals = sum(r.tokens * r.rate * np.array(r.posterior) for r in got)
    assert np.isclose(totals[2] / totals[0], 0.02 / 0.97, rtol=1e-2) and totals[1] < 1e-9  # no junk was labelled
    assert all(r.rate > 0.9 for r in got if r.text == "plain words of a text")
    only = m.mix(frame, m.domain_of(labels.where("toxic = 1 or quality = 0")), m.WEIGHTS, "clean").collect()
    assert all(r.posterior[0] < 1e-9 for r in only)  # nothing clean was labelled, so nothing is
    even = m.mix(frame, m.domain_of(labels.limit(0)), m.WEIGHTS, "clean").collect()
    assert all(np.allclose(r.posterior, 1 / 3) for r in even)
    assert m.mix(spark.createDataFrame([], schema), m.domain_of(labels), m.WEIGHTS, "clean").collect() == []


def test_thinned_totals(spark):
    """A domain under its weight stays whole and costs no clean document; one over it comes down to it."""
    schema = "doc_id long, text string"
    kind = lambda k: "junk" if k % 200 == 0 else "toxic" if k % 4 == 1 else "clean"
    text = {"junk": "buy cheap pills now", "toxic": "vile slur words here", "clean": "plain words of text"}
    frame = spark.createDataFrame([(k, text[kind(k)]) for k in range(8000)], schema)
    labels = spark.createDataFrame([(k, kind(k)) for k in range(8000)], "doc_id long, domain string")
    rows = m.thin(frame, labels, {"clean": 0.9, "junk": 0.02, "toxic": 0.08}, "clean").collect()
    n = {d: sum(kind(r.doc_id) == d for r in rows) for d in text}
    print(n, {d: sum(r.rate for r in rows if kind(r.doc_id) == d) / max(n[d], 1) for d in text})
    assert len({r.doc_id for r in rows}) == len(rows) and all(0 <= r.rate <= 1 for r in rows)
    assert n["clean"] == 5960 and n["junk"] == 40
    assert np.isclose(n["toxic"] / n["clean"], 0.08 / 0.9, rtol=0.1)


def test_pipeline_stage_keeps_its_totals(spark, tmp_path):
    """The stage's own output: clean documents that the unbounded rates would lower for others' copies stay."""
    import corpus_pipeline

    # half of the texts "sale" are clean, half junk; junk lies under its weight, and rates above one would repeat them
    kinds = ["slur" if k % 10 == 1 else "sale" if k % 250 == 0 else "plain" for k in range(5000)]
    labels = [(k, 0 if x == "sale" and k % 500 else 1, int(x == "slur")) for k, x in enumerate(kinds)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(k, x, "en", "s", len(x)) for k, x in enumerate(kinds)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [r.text for r in corpus_pipeline.mixing_stage(spark, frame, str(tmp_path)).collect()]
    print({x: (kinds.count(x), out.count(x)) for x in set(kinds)})
    assert out.count("plain") == kinds.count("plain") and out.count("sale") == kinds.count("sale")
    assert np.isclose(out.count("slur") / len(out), 0.02, rtol=0.2)

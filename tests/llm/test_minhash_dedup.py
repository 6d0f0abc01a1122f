from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import minhash_dedup as m
from quire.llm.common import components, table

SCHEMA = "doc_id long, text string, component_id string"


def brute(docs):
    """Exact components by inverted lists."""
    sets = defaultdict(set)
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] |= {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = defaultdict(list)
    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in seen[s]).items():
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            seen[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def random_text(r, n, words=5000):
    return " ".join(f"w{int(x)}" for x in r.integers(0, words, n))


def edited(r, text, n):
    words = text.split()
    for k in r.integers(0, len(words), n):
        words[k] = f"x{int(r.integers(10**9))}"
    return " ".join(words)


def check(spark, docs, **options):
    got = m.near_duplicates(spark.createDataFrame([(i, t, "clash") for i, t in docs], SCHEMA), **options).collect()
    want = brute(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("options", [{}, {"region_rows": 16, "block_rows": 32}])
def test_against_brute_force(spark, options):
    """Groups of near copies around the threshold, a large one among them; small regions and blocks change nothing."""
    r = np.random.default_rng(1)
    texts = [random_text(r, int(n)) for n in r.integers(1, 400, 60)]
    base = random_text(r, 300)
    texts += [edited(r, base, int(k)) for k in r.integers(0, 7, 150)]
    for _ in range(20):
        b = random_text(r, int(r.integers(60, 300)))
        texts += [b] + [edited(r, b, int(k)) for k in r.integers(0, 5, 3)]
    ids = r.permutation(10 * len(texts))[: len(texts)]
    check(spark, [(int(i), t) for i, t in zip(ids, texts, strict=True)], **options)


def test_hubs_find_the_links_of_large_groups(spark):
    """Groups that no block holds: copies of one text that link to it alone, a chain, and texts alike without a link."""
    r, docs = np.random.default_rng(8), []
    base = random_text(r, 200)
    for k in range(38):  # a run of five words replaced: linked to the base, not to each other
        words = base.split()
        words[5 * k : 5 * k + 5] = [f"y{int(x)}" for x in r.integers(0, 10**9, 5)]
        docs.append(" ".join(words))
    docs.append(base)
    words = random_text(r, 200).split()
    for k in range(60):  # each step links with its neighbours only
        words[3 * k : 3 * k + 3] = [f"z{int(x)}" for x in r.integers(0, 10**9, 3)]
        docs.append(" ".join(words))
    base = random_text(r, 200)
    docs += [edited(r, base, 4) for _ in range(40)]
    ids = r.permutation(10 * len(docs))[: len(docs)]
    data = [(int(i), t) for i, t in zip(ids, docs, strict=True)]
    assert len({c for _, c in brute(data).values()}) < 60
    check(spark, data, block_rows=16, hubs=4)


def test_recall_at_full_depth(spark):
    """Isolated pairs at the threshold are found in regions that are split to full depth as well."""
    r, docs = np.random.default_rng(3), []
    for k in range(600):
        words = [f"w{int(x)}" for x in r.integers(0, 10**6, 66)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:30], "other", *words[31:]]))]  # 57 of 67 in common
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = m.near_duplicates(frame, region_rows=1).where("not kept").count()
    assert found >= 599


def test_rows(spark):
    long = random_text(np.random.default_rng(2), 60_000, 10**6)
    docs = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, long), (8, long + " end")]
    docs += [(9, "Ä b c d e f"), (10, "ä b c d e f"), (11, "one two three four five"), (11, "one two three four five")]
    check(spark, docs)
    null = m.near_duplicates(spark.createDataFrame([(None, "a b"), (1, "a b"), (2, "a b")], "doc_id long, text string"))
    assert {(r.doc_id, r.component_id, r.kept) for r in null.collect()} == {(None, None, True), (1, 1, True), (2, 1, False)}
    assert m.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_over_table(spark):
    sf = "/root/testdata/sf0.001"
    want = brute([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    got = m.op10_minhash_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("most", [1 << 19, 16])
def test_components(spark, monkeypatch, most):
    """In one step, and in rounds of stars where a task contracts few edges at a time."""
    from quire.llm import common

    monkeypatch.setattr(common, "CONTRACTED", most)
    chain = [(k, k + 1) for k in range(100, 160)] + [(1, 2), (2, 1), (3, 3), (9, 5), (5, 7), (7, 9)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {k: 100 for k in range(101, 161)} | {2: 1, 7: 5, 9: 5}

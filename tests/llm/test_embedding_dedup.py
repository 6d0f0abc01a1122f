import math

import numpy as np
import pytest

from quire.llm import embedding_dedup as e
from quire.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label string, node int"


def brute(rows, threshold=0.95):
    """n_links and component per vec_id, by all cosines."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    root = {i: i for i, _ in rows if i is not None}
    links = {i: set() for i in root}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, u) in enumerate(ok):
        for j, v in ok[:k]:
            if i != j and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                links[i].add(j), links[j].add(i)
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(links[i]), find(i)) for i in root}


@pytest.mark.parametrize("block_rows", [512, 16])
def test_against_brute_force(spark, block_rows):
    r = np.random.default_rng(3)
    rows = [v for v in r.standard_normal((150, 32))]
    for n, noise in ((60, 0.1), (20, 0.15), (5, 0.2)):
        rows += list(r.standard_normal(32) + noise * r.standard_normal((n, 32)))
    rows += [rows[3]] * 40 + [rows[4] * 5.0]
    data = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(r.permutation(5000), rows, strict=False)]
    frame = spark.createDataFrame([(*x, "clash", 1) for x in data], SCHEMA)
    got = {r.vec_id: r for r in e.near_duplicates(frame, recall=0.9999, block_rows=block_rows).collect()}
    want = brute(data)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_rows(spark):
    nan, inf = math.nan, math.inf
    data = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0])]
    data += [(8, [1.0, 2.0]), (9, [2.0, 4.0]), (10, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (11, [1e30, 2e30])]
    got = e.near_duplicates(spark.createDataFrame([(*x, "", 0) for x in data], SCHEMA)).collect()
    assert len(got) == len(data)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by == {k: (0, k, True) for k in (1, 2, 3, 4, 5, 6, 10)} | {None: (0, None, True), 7: (3, 7, True)} | {
        k: (3, 7, False) for k in (8, 9, 11)
    }
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    data = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    want = brute(data)
    got = {r.vec_id: (r.n_links, r.component_id) for r in e.op1_embedding_dedup(spark, sf).collect()}
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    print("links found", found, "of", there)
    assert found >= 0.9 * there and all(got[i][0] <= want[i][0] for i in want)

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from quire.llm import line_dedup as d
from quire.llm.common import table
from quire.llm.words import WordHash

SF = "/root/testdata/sf0.001"
few = st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=7)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, least_words):
    """The superfluous lines of each document, every line compared with all earlier ones of like length."""
    lines, gone = [], {}
    for i, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if words := line.encode().lower().split():
                lines.append((i, k, words))
    lines.sort(key=lambda x: x[:2])
    by = {}
    for i, k, words in lines:
        seen = by.get(tuple(words), (i, k)) < (i, k)
        if not seen and len(words) >= least_words - 1:
            for n in (len(words) - 1, len(words), len(words) + 1):
                for other, place in by.items():
                    if len(other) == n and min(n, len(words)) >= least_words and place < (i, k) and d.within_one(words, list(other)):
                        seen = True
        if seen:
            gone.setdefault(i, set()).add(k)
        by.setdefault(tuple(words), (i, k))
    return gone


@given(few, few)
def test_within_one(a, b):
    assert d.within_one(a, b) == (distance(a, b) <= 1)


@given(few, few)
def test_keys_lose_no_pair(a, b):
    seen = WordHash()
    x, y = seen.of(a), seen.of(b)
    if distance(a, b) <= 1 and a != b and min(len(a), len(b)) > 1:
        assert set(d.half_keys(a)) & set(d.half_keys(b))
        u, v = d.variants(x).tolist(), d.variants(y).tolist()
        assert u[0] in v[1:] or v[0] in u[1:] or any(p == q for p, q in zip(u[1:], v[1:], strict=False))


def check(spark, docs, least_words):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: set(r.lines) for r in d.duplicate_lines(frame, least_words).collect()}
    assert got == brute(docs, least_words)


def test_against_brute_force(spark):
    r = np.random.default_rng(6)
    base = [[f"w{int(x)}" for x in r.integers(0, 300, int(n))] for n in r.integers(1, 14, 25)]
    docs = []
    for i in r.permutation(60):
        lines = []
        for _ in range(int(r.integers(0, 8))):
            words = list(base[int(r.integers(len(base)))])
            for _ in range(int(r.integers(0, 3))):
                at, kind = int(r.integers(len(words))), int(r.integers(3))
                words[at : at + (kind > 0)] = [f"x{int(r.integers(4))}"] if kind < 2 else []
                words = words or ["w"]
            lines.append(" ".join(words))
        docs.append((int(i), "\n".join(lines)))
    check(spark, docs, 8)
    check(spark, docs, 3)


def test_query_over_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = brute(docs, 8)
    got = {r.doc_id: r for r in d.op2_line_dedup(spark, SF).collect()}
    for i, text in docs:
        lines = [x for k, x in enumerate((text or "").split("\n")) if k not in want.get(i, ())]
        assert got[i].text == "\n".join(lines) and got[i].n_removed == len(want.get(i, ()))


def test_rows(spark):
    schema = "doc_id long, text string, n_lines string, first int"
    line = "one two three four five six seven eight nine"
    docs = [(2, f"{line}\n\n{line}", "", 1), (1, line.replace("five", "FIVE!"), "", 1), (3, None, "", 1), (4, "", "", 1), (5, "\n \n", "", 1)]
    docs += [(None, "short line", "", 1), (6, "Short  line", "", 1), (7, "short", "", 1), (7, "short", "", 1), (8, "\n".join(f"line {k} " + "z " * 9 for k in range(5000)), "", 1)]
    got = {r.doc_id: r for r in d.dedup_lines(spark.createDataFrame(docs, schema)).collect()}
    assert got[1].text == line.replace("five", "FIVE!") and got[2].text == "" and (got[2].n_lines, got[2].n_removed) == (3, 2)
    assert got[3].text is None and got[4].text == "" and got[5].text == "\n \n"
    assert got[None].text == "short line" and got[6].text == "" and got[7].text == "short"
    assert got[8].text == "line 0 " + "z " * 9 and got[8].first == 1
    assert d.dedup_lines(spark.createDataFrame([], schema)).collect() == []


def test_documents_without_an_id_of_their_own(spark):
    """Two null ids, and two texts under one id, are documents each: no line goes for another document's copy."""
    line = "one two three four five six seven eight nine"
    docs = [(None, "alpha\nbeta"), (None, "gamma\nalpha"), (1, "delta\nepsilon"), (1, "zeta\ndelta"), (2, "eta\ntheta"), (2, "eta\niota")]
    docs += [(3, f"kappa\n{line}"), (3, f"lambda\n{line} ten"), (4, "mu"), (4, "mu")]
    out = d.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    left = sorted(x for r in out for x in r.text.split("\n") if x)
    assert len(out) == len(docs) and sum(r.n_removed for r in out) == 4
    assert len([x for x in left if x.startswith("one two")]) == 1
    want = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "mu"]
    assert sorted(x for x in left if not x.startswith("one two")) == sorted(want)

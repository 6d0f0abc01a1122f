from collections import Counter
from pathlib import Path

import numpy as np

from quire.llm import token_counts as t
from quire.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(lengths):
    n, out = np.array(lengths), {}
    for limit in set(lengths):
        kept = int(np.minimum(n, limit).sum())
        out[limit] = (int((n == limit).sum()), int((n <= limit).sum()), int((n > limit).sum()), kept, int(n.sum()) - kept)
    return out


def check(hist, lengths):
    want = brute(lengths)
    rows = t.limits(hist).collect()
    assert {r.context_limit: (r.n_docs, r.docs_within, r.docs_cut, r.tokens_kept, r.tokens_cut) for r in rows} == want
    assert all(abs(r.quantile - r.docs_within / len(lengths)) < 1e-12 and r.total_tokens == sum(lengths) for r in rows)


def test_query_over_table(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(str(Path(t.VOCABULARY).with_name("byte_bpe_50k.json")))  # the same vocabulary, another library
    other.encode_special_tokens = True
    texts = [r.text or "" for r in table(spark, SF, "documents").collect()]
    lengths = [len(x.ids) for x in other.encode_batch(texts, add_special_tokens=False)]
    rows = t.op3_token_counts(spark, SF).collect()
    assert {r.context_limit: r.n_docs for r in rows} == Counter(lengths)
    assert {r.context_limit: r.tokens_kept for r in rows} == {k: v[3] for k, v in brute(lengths).items()}


def test_rows(spark):
    docs = [(None, "a"), ("", "a"), ("<|endoftext|>", "a"), ("x" * 50_000, "a"), ("one two", None), ("one two", None), ("word " * 30_000, "a")]
    frame = spark.createDataFrame(docs, "text string, n_tokens string")
    lengths = [r.n_tokens for r in t.with_lengths(frame).collect()]
    assert sorted(lengths)[:2] == [0, 0] and len(lengths) == 7 and max(lengths) >= 30_000
    hist = t.histogram(frame)
    check(hist, lengths)
    got = {r.context_limit: (r.tokens_kept, r.docs_cut) for r in t.totals_at(hist, [0, 1, 7, 10**9]).collect()}
    assert got == {k: (sum(min(k, n) for n in lengths), sum(n > k for n in lengths)) for k in (0, 1, 7, 10**9)}
    half = {r.share: r.n_tokens for r in t.quantiles(hist, [0.5, 1.0]).collect()}
    assert half == {0.5: sorted(lengths)[3], 1.0: max(lengths)}
    empty = t.histogram(spark.createDataFrame([], frame.schema))
    assert t.limits(empty).collect() == [] and [tuple(r) for r in t.totals_at(empty, [5]).collect()] == [(5, 0, 0)]

import zlib

import numpy as np

from quire.llm import quality as q

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = q.op9_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    good, bad = s[y == 1], s[y == 0]
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    right = np.mean([r.predicted == r.quality for r in rows])
    print("held-out AUC", auc, "accuracy", right, "of", len(rows), "rejected clean", np.mean(good < q.ACCEPT))
    assert auc > 0.95 and right > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.limit(500).collect())


def test_scores_against_the_forward_pass(spark):
    """What a text's look-ups add up to is the softmax of the layer over the mean of its vectors."""
    docs = [r for r in spark.read.parquet(f"{SF.replace('0.1', '0.001')}/documents.parquet").select("doc_id", "text").collect()]
    seen, rows = q.WordHash(), []
    for k, r in enumerate(docs[:60]):
        ids, counts = np.unique(q.features((r.text or "").encode(), seen), return_counts=True)
        rows.append((k % 2, ids, counts))
    parts = q.learn(rows, epochs=2)
    model = parts.table @ (parts.layer[1] - parts.layer[0]), float(parts.bias[1] - parts.bias[0])
    frame = spark.createDataFrame([(r.doc_id, r.text) for r in docs] + [(-1, ""), (-2, None)], "doc_id long, text string")
    for r in q.score(frame, model).collect():
        ids = q.features((r.text or "").encode(), seen) if r.text else []
        v = parts.table[ids].astype(float).mean(0) if len(ids) else np.zeros(q.DIM)
        z = parts.layer @ v + parts.bias
        assert abs(r.score - np.exp(z[1]) / np.exp(z).sum()) < 1e-5


def test_training_pairs_are_bounded(spark):
    frame = spark.createDataFrame([(k, f"good text {k}" if k % 2 else f"BAD!!! {k}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int")
    calls = []
    real, q.fit = q.fit, lambda rows, seed=9: calls.append(sum(len(r[1]) for r in rows)) or real(rows, seed)
    try:
        q.train(frame, labels, most_pairs=4000)
    finally:
        q.fit = real
    assert 1000 < calls[0] < 6000


def test_rows(spark):
    schema = "doc_id long, text string, score string"
    good, bad = "a calm line of plain words here", "$$$ BUY!!! %%% NOW!!! ###"
    docs = [(k, good if k % 2 else bad, "clash") for k in range(60)]
    docs += [(None, good, ""), (100, None, ""), (101, "", ""), (102, good * 20_000, ""), (1, good, "clash")]
    frame = spark.createDataFrame(docs, schema)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (7, None), (999, 0)], "doc_id long, quality int")
    got = q.score(frame, q.train(frame, labels)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score > 0.6 for r in got if r.text and r.text.startswith(good))
    assert all(r.score < 0.4 for r in got if r.text == bad)
    assert {r.score for r in got if r.doc_id in (100, 101)} == {next(r.score for r in got if r.doc_id == 100)}
    none = q.train(frame, labels.limit(0))
    assert {r.score for r in q.score(frame, none).collect()} == {0.5}
    empty = spark.createDataFrame([], schema)
    assert q.score(empty, q.train(empty, labels)).collect() == []

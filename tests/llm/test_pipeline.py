from collections import Counter

import corpus_pipeline as p
from quire.llm import decontaminate, minhash_dedup, quality

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        new = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "shard":
            assert new.columns == columns and new.exceptAll(docs).count() == 0
        if name == "near_dedup":
            want = {r.doc_id for r in minhash_dedup.near_duplicates(docs).where("kept").collect()}
            assert {r.doc_id for r in new.collect()} == want
        if name == "decontaminate":
            found = decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert found.where("contaminated").count() == docs.count() - new.count() > 0
        print(name, docs.count(), new.count())
        docs = new
    sizes = Counter(r["shard"] for r in docs.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) > 0.6 * before


def test_rows(spark):
    """Which rows stay of nulls, empty texts, repeated rows and texts that share a doc_id, in every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (None, None, "en", "s", None), (1, "", "en", "s", 0), (2, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11)]
    rows += [(3, "a plain line of words", "en", "s", 21), (3, "another plain line of words", "en", "s", 27), (4, "A b c d e f", "en", "s", 11)]
    frame, sf = spark.createDataFrame(rows, schema), "/root/testdata/sf0.001"
    model = quality.train(frame, spark.read.parquet(f"{sf}/labels.parquet"))
    accepted = [tuple(r)[:5] for r in quality.score(frame, model).collect() if r.score >= quality.ACCEPT]
    want = {
        "quality": accepted,
        "near_dedup": [r for k, r in enumerate(rows) if k not in (4, 7)],  # the repeated row, and the later of two near copies
        "decontaminate": rows,  # nothing here stands in the benchmark
        "mix": rows,  # nothing junk or toxic was labelled, so no domain is above its weight
        "shard": rows,
    }
    for name, stage in p.STAGES:
        out = stage(spark, frame, sf).collect()
        assert Counter(tuple(r)[:5] for r in out) == Counter(want[name]), name
        assert stage(spark, spark.createDataFrame([], schema), sf).collect() == [], name


def test_run(spark):
    assert p.run(spark, "/root/testdata/sf0.001").count() > 100

"""Quality classifier: supervised subword embeddings.

A text's features are its words, its pairs of adjacent words and its byte 3-, 4- and 5-grams, each hashed to one of
65,536 rows of an embedding table. The document's vector is the mean of its features' vectors; a softmax layer gives
the class. Embeddings and layer are learned together by stochastic gradient descent in numpy, document by document.
For scoring, every row collapses to one number (its contribution to the log-odds), so a text of any length is scored
by table look-ups over the whole text.

The model is fitted on at most `train_rows` labelled documents, the ones with the smallest hash of doc_id; that bound
is the only one but for memory: if these have more than `most_pairs` (feature, count) pairs in all, the share of them that
keeps within it is taken, by the same hash. Features are computed where the documents lie, and at most 65,536 pairs a
document reach the driver. Of several texts under one doc_id, one is learned from. Labels, doc_id and every column other than the text stay out of the features.

Rows: null, empty and very long texts are scored like any other (a text without features by the layer's bias alone).
Labels that are null, or whose document is missing, are ignored; repeated documents are scored each. Without any
labelled row the score is 0.5 everywhere. Other columns pass through; one named `score` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table
from .words import WordHash

ROWS, DIM, EPOCHS, RATE = 1 << 16, 16, 12, 2.0
GRAMS = (3, 4, 5)
#: Fixed values of the query's contract.
FOLDS, ACCEPT = 5, 0.3


def features(text: bytes, seen: WordHash) -> np.ndarray:
    """Row numbers of all features of a text."""
    mask = np.uint64(ROWS - 1)
    words = seen.of(text.split())
    parts = [(words >> np.uint64(40)) & mask]
    if len(words) > 1:
        with np.errstate(over="ignore"):
            pair = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
        parts.append((pair >> np.uint64(44)) & mask)
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    gram = raw
    for n in range(2, max(GRAMS) + 1):
        if len(raw) < n:
            break
        gram = gram[: len(raw) - n + 1] * np.uint32(0x01000193) + raw[n - 1 :]
        if n in GRAMS:
            parts.append((gram * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(16))
    return np.concatenate([p.astype(np.uint16) for p in parts])


class Parts(NamedTuple):
    table: np.ndarray  # a vector per feature row
    layer: np.ndarray  # a vector per class
    bias: np.ndarray


def learn(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 9, epochs: int = EPOCHS) -> Parts:
    """Embeddings and softmax layer from (label, feature rows, counts), one document a step."""
    r = np.random.default_rng(seed)
    table = r.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, at = epochs * len(rows), 0
    for _ in range(epochs):
        for k in r.permutation(len(rows)):
            label, ids, counts = rows[k]
            rate = np.float32(RATE * (1 - at / steps))
            at += 1
            share = counts.astype(np.float32)
            share /= max(1, share.sum())
            own = table[ids]
            v = share @ own if len(ids) else np.zeros(DIM, np.float32)
            z = layer @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ layer
            layer -= rate * p[:, None] * v[None, :]
            bias -= np.float32(0.05) * rate * p
            own -= rate * share[:, None] * back[None, :]
            table[ids] = own
    return Parts(table, layer, bias)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 9) -> tuple[np.ndarray, float]:
    """From (label, feature rows, counts): each row's contribution to the log-odds of label 1, and the bias."""
    if not rows:
        return np.zeros(ROWS, np.float32), 0.0
    table, layer, bias = learn(rows, seed)
    return table @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = WordHash()
    for batch in batches:
        ids, counts = [], []
        for x in batch.column("text"):
            i, c = np.unique(features(x.as_buffer().to_pybytes() if x.is_valid else b"", seen), return_counts=True)
            c = c * min(1, 65_535 / c.max(initial=1))  # only the counts' ratios matter
            ids.append(i.astype(np.uint16).tobytes()), counts.append(np.ceil(c).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
            ["doc_id", "label", "ids", "counts"],
        )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = 4000, most_pairs: int = 40_000_000):
    """A model from the labelled rows outside the held-out fold; label values are 0 and 1."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    rows = rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows)  # the model's documented bound
    picked = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("doc_id", "label", "text")
    counted = picked.mapInArrow(_counted, "doc_id long, label int, ids binary, counts binary")
    # repeated documents count once, so no more rows than labels reach the driver, and one partition at a time
    once = counted.groupBy("doc_id", "label").agg(F.min(F.struct("ids", "counts")).alias("f")).select("doc_id", "label", "f.*")
    once = stored(once)
    pairs = once.agg(F.sum(F.octet_length("ids") / 2)).first()[0] or 0
    if pairs > most_pairs:
        share = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) / float(1 << 20)
        once = once.where(share < most_pairs / pairs)
    found = [
        (r["doc_id"], r["label"], np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["counts"], np.uint16))
        for r in once.toLocalIterator()
    ]
    found.sort(key=lambda r: r[:2])
    return fit([r[1:] for r in found])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """docs with `score`, the probability of label 1. No shuffle."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        seen = WordHash()
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for k, x in enumerate(batch.column(text_col)):
                if x.is_valid and (text := x.as_buffer().to_pybytes()):
                    z[k] += float(table[features(text, seen)].mean(dtype=np.float64))
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

    return docs.mapInArrow(part, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"),
    )

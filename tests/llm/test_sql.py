"""The registered queries of the subpackage against their SQL, on the smallest tables and on odd rows."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quire.llm.queries import QUERIES, SQL
from quire.plans.compare import mismatch

SF = "/root/testdata/sf0.001"
LINE = "one two three four five six seven eight nine"
#: Null, empty and blank texts, rows without an id, repeated rows, lines and texts a word apart, upper case, no ASCII.
TEXTS = [
    (None, f"{LINE}\nfoo"), (0, None), (1, ""), (2, " \t\n\x0b"), (3, f"{LINE.upper()}\nfoo\n\nbar"), (4, f"{LINE} ten\nbar"),
    (4, f"{LINE} ten\nbar"), (5, "Füße und Öl\nFüße und öl"), (6, LINE.replace("five", "fünf") + "\n" + LINE.replace(" five", "")),
    (7, " ".join(f"w{k}" for k in range(60))), (8, " ".join(f"W{k}" for k in range(61))), (9, " ".join(f"w{k}" for k in range(1, 62))),
    (10, "a b"), (11, "A\tb"), (12, "eight words are just enough to be compared\neight words are just enough to be compared again"),
]
VECTORS = [
    (0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 0.0]),
    (7, [2.0, 0.0]), (8, [1.0, 0.2]), (9, [1.0, 0.5]), (10, [-1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0, 0.0]), (None, [1.0, 0.0]),
]


def _written(folder, docs, vectors):
    documents = {"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([x for _, x in docs], pa.string())}
    pq.write_table(pa.table(documents), folder / "documents.parquet")
    numbers = pa.array([x for _, x in vectors], pa.list_(pa.float32()))
    embeddings = {"vec_id": pa.array([i for i, _ in vectors], pa.int64()), "embedding": numbers}
    pq.write_table(pa.table(embeddings), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, name):
    assert mismatch(QUERIES[name](spark, SF), SQL[name], SF) is None


@pytest.mark.parametrize("name", ["op1_embedding_dedup", "op2_line_dedup", "op10_minhash_dedup"])
def test_odd_rows_equal_sql(spark, tmp_path, name):
    folder = _written(tmp_path, TEXTS, VECTORS)
    assert mismatch(QUERIES[name](spark, folder), SQL[name], folder) is None


@pytest.mark.parametrize("name", ["op1_embedding_dedup", "op2_line_dedup", "op10_minhash_dedup"])
def test_empty_tables_agree(spark, tmp_path, name):
    folder = _written(tmp_path, [], [])
    assert mismatch(QUERIES[name](spark, folder), SQL[name], folder) == "no rows"

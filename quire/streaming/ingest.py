"""Optional streaming shells: ingestion of document files, and a breaker that counts crashes in a sliding window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Fixed values of the breaker: its window in seconds and the most respawns in it.
WINDOW_S, MOST_RESPAWNS = 60, 3
FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def ingest(spark: SparkSession, folder: str, to: str, checkpoints: str, glob: str = "*") -> int:
    """Every file of the folder that earlier calls have not taken goes to parquet once; returns the rows there now."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).load(folder)
    rows = files.select(F.xxhash64("path").alias("doc_id"), "path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), "content")
    query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoints).trigger(availableNow=True).start(to)
    query.awaitTermination()
    return spark.read.parquet(to).count()


def breaker(crashes: DataFrame, key: str = "worker", ts: str = "ts") -> DataFrame:
    """crashes with `recent`, those of the same worker in the window up to and with this one, and `open`."""
    at = F.col(ts).cast("timestamp").cast("double")
    window = Window.partitionBy(key).orderBy(at).rangeBetween(-WINDOW_S, 0)
    return crashes.withColumn("recent", F.count("*").over(window)).withColumn("open", F.col("recent") > MOST_RESPAWNS)


def crash_windows(crashes: DataFrame, key: str = "worker", ts: str = "ts", late: str = "2 minutes") -> DataFrame:
    """The same as a streaming aggregate: crashes per worker and sliding window, late rows up to a watermark."""
    marked = crashes.withWatermark(ts, late)
    return marked.groupBy(key, F.window(ts, f"{WINDOW_S} seconds", f"{WINDOW_S // 6} seconds")).agg(F.count("*").alias("crashes"))

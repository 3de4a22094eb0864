"""Streams of events: sessions, windowed counts and a watched state. The batch forms are in ``operators``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_stream(spark, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key that end after ``gap`` without an event; state is dropped ``late`` after it."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("since"), F.col("session_window.end").alias("until"), "n")


def windowed_counts(events: DataFrame, key: str, time: str, width: str, late: str) -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("since"), "n")


def upsert_batches(stream: DataFrame, path: str, keys: list[str], checkpoint: str, buckets: int = 64):
    """Keeps the newest row of each key (by ``ts``, then ``event_id``, however rows arrive) in a table of ``buckets`` parts by the keys' hash; a micro-batch rewrites the parts its keys fall in.

    A batch writes its parts under its own number, so one that is run again writes the same folders and counts nothing
    twice. Of each part the two versions before the batch stay, for readers that are under way; older ones are deleted.
    """
    from lodestrata.operators.relational import distinct_on

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # at most ``buckets``
        versions = _parts(spark, path)
        standing = [f"{path}/{max(n for n in numbers if n < number)}/bucket={b}" for b, numbers in versions.items() if b in touched and min(numbers) < number]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*standing)) if standing else batch
        whole = distinct_on(rows, keys, [F.desc("ts"), F.desc("event_id")])
        whole.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{number}")
        for b, numbers in versions.items():
            for old in sorted(n for n in numbers if n < number)[:-2]:
                _delete(spark, f"{path}/{old}/bucket={b}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark, path: str) -> dict[int, list[int]]:
    """Numbers of the micro-batches that wrote each bucket."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/*/bucket=*")
    out: dict[int, list[int]] = {}
    for found in folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or []:
        part = found.getPath()
        out.setdefault(int(part.getName().removeprefix("bucket=")), []).append(int(part.getParent().getName()))
    return out


def _delete(spark, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def latest_batch(spark, path: str, schema) -> DataFrame:
    """The table that ``upsert_batches`` keeps under ``path``: the newest version of every bucket."""
    parts = [f"{path}/{max(numbers)}/bucket={b}" for b, numbers in _parts(spark, path).items()]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)

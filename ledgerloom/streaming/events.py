"""Windows and duplicates over a stream of events; the same plans run over a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.spool import Spool


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The files of a table as a stream, with ``ts`` as a time in UTC."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and values of each type in windows side by side."""
    return _windowed(events.withWatermark("ts", late), F.window("ts", width))


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 day") -> DataFrame:
    """Events and values of each type in overlapping windows."""
    return _windowed(events.withWatermark("ts", late), F.window("ts", width, step))


def _windowed(events: DataFrame, window) -> DataFrame:
    out = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "17 minutes", late: str = "1 day") -> DataFrame:
    """Each user's sessions: events until none comes for ``gap``."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss.SSS").alias("start"), "n")


def first_of_each(events: DataFrame, *keys: str, late: str = "1 day") -> DataFrame:
    """Events without repeats of the keys; state is dropped behind the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def run_to_table(spark: SparkSession, stream: DataFrame, *keys: str) -> DataFrame:
    """What a stream gives once all its files are read, as a table in the shared folder.

    With ``keys`` the stream runs in update mode, so state behind the watermark is dropped, and the last update of
    each key counts; without, rows are appended.  Every batch has a folder of its own that a replay overwrites,
    and the offsets' checkpoint lies beside them, so a lost driver resumes where it stopped and doubles nothing.
    """
    spool = Spool(spark, "stream")
    target = f"{spool.root}/table"
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    mode = "update" if keys else "append"
    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{spool.root}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(schema.add("batch", "long")).option("basePath", target).parquet(target)
    if not keys:
        return rows.drop("batch")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def incremental(
    spark: SparkSession,
    stream: DataFrame,
    resolve: Callable[[DataFrame], DataFrame],
    target: str,
    key: str | None = None,
    touched: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Resolve each arriving batch together with what is known, as ``foreachBatch``; returns the last resolution.

    Rows are kept under ``target/rows/batch=N`` and resolutions under ``target/resolved/batch=N``, and the offsets
    beside them.  A batch that is replayed, also by another process, finds what it found and overwrites its own.
    ``touched`` picks from (known rows, batch) the known rows that the batch can change: only these are resolved
    again, and what was found for the others, told apart by ``key``, is carried over.
    """

    def before(what: str, number: int | None = None) -> list[str]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{what}")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        numbers = sorted(int(f.getPath().getName().partition("=")[2]) for f in files.listStatus(folder)) if files.exists(folder) else []
        return [f"{target}/{what}/batch={n}" for n in numbers if number is None or n < number]

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        batch = spark.read.schema(stream.schema).parquet(f"{target}/rows/batch={number}")
        earlier, resolved = before("rows", number), before("resolved", number)
        known = spark.read.schema(stream.schema).parquet(*earlier) if earlier else batch.limit(0)
        again = touched(known, batch) if touched else known
        out = resolve(again.unionByName(batch))
        if touched and resolved:
            fresh = again.select(key).unionByName(batch.select(key)).distinct()
            out = out.unionByName(spark.read.parquet(resolved[-1]).join(fresh, key, "left_anti"))
        out.write.mode("overwrite").parquet(f"{target}/resolved/batch={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{target}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(before("resolved")[-1])

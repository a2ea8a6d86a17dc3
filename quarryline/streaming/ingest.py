"""Incremental ingestion: new files become new rows once, however often the job runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarryline.operators.relational import inserted


#: Parts by key hash of the target of an ingest; a batch reads those of its own keys only.
PARTS = 64


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there; an error in looking is raised, not taken for absence."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ingest(spark: SparkSession, source: str, schema: str, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Rows of new Parquet files of source appended to target unless their key is there; ends when all files are read.

    The target is parted by the hash of its keys (_part), so a batch is compared with the parts it touches.
    """

    def add(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))
        if exists(session, target):
            touched = [r["_part"] for r in rows.select("_part").distinct().collect()]  # at most PARTS numbers
            there = session.read.parquet(target).filter(F.col("_part").isin(touched)).select(*keys)
        else:
            there = rows.limit(0).select(*keys)
        inserted(there, rows, keys).write.mode("append").partitionBy("_part").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resumable(spark: SparkSession, todo: DataFrame, done: str, key: str, run: Callable[[DataFrame], DataFrame], manifest: dict[str, str], most_errors: int = 3) -> DataFrame:
    """Results of todo that a run recorded under done, after running what is not recorded yet.

    run gives a row per item with an error column, null for success; only successes count as done, and
    errors are kept under done/errors. A run whose manifest differs from the recorded one is refused, and
    so is one that stopped most_errors times.
    """
    notes = f"{done}/manifest"
    if exists(spark, notes):
        said = {r["name"]: r["value"] for r in spark.read.json(notes).collect()}
        if said != manifest:
            raise ValueError(f"the recorded run differs in {sorted(k for k in {*said, *manifest} if said.get(k) != manifest.get(k))}")
    else:
        spark.createDataFrame(list(manifest.items()), "name string, value string").coalesce(1).write.json(notes)
    failed = spark.read.json(f"{done}/errors") if exists(spark, f"{done}/errors") else None
    if failed is not None and failed.select("attempt").distinct().count() >= most_errors:
        raise RuntimeError(f"the run stopped {most_errors} times")
    there = spark.read.parquet(f"{done}/results") if exists(spark, f"{done}/results") else None
    open_ = todo if there is None else todo.join(there.select(key), key, "left_anti")
    out = run(open_).persist()
    out.filter("error is null").drop("error").write.mode("append").parquet(f"{done}/results")
    bad = out.filter("error is not null").select(key, "error")
    if not bad.isEmpty():
        attempt = 1 if failed is None else failed.agg(F.max("attempt")).first()[0] + 1
        bad.withColumn("attempt", F.lit(attempt)).write.mode("append").json(f"{done}/errors")
    out.unpersist()
    return spark.read.parquet(f"{done}/results")


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events per type and window with their summed value; ts orders them, later ones than `late` are dropped in a stream."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events less than gap apart."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("session_start"), "events")

"""References that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def drop_repeats(requests: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Streamed requests (ts, ref_hash, ...) without those whose hash came within the time to live: state is kept per
    hash until the watermark passes it."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["ref_hash"])


def drop_repeats_batch(requests: DataFrame, ttl_seconds: int = 3600, tie: str = "request_id") -> DataFrame:
    """The same over a table: a request counts as a repeat if the one before it with its hash is at most the time to
    live away. (The stream measures from the first request kept, a table from the request before.)"""
    w = Window.partitionBy("ref_hash").orderBy("ts", tie)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    return requests.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > ttl_seconds * 1_000_000)).drop("_gap")


def commit(results: DataFrame, batch_id: int, sink: str) -> None:
    """Write a batch's results as the partition ``batch_id`` of a Parquet table. A batch that runs again, as after a failure
    between its output and the stream's own log, replaces what it wrote before, so no row is there twice."""
    results.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")


def answered(requests: DataFrame, stored: DataFrame | None, resolve: Callable[[DataFrame], DataFrame], ttl_seconds: int = 3600) -> DataFrame:
    """Requests (request_id, ts, ref_hash, ...) with their results: ``result``, ``resolved_ts`` and ``cached``.

    A request whose hash was resolved at most the time to live ago is answered from ``stored`` (ref_hash, resolved_ts,
    result), by its latest entry. Of the others one request of each hash, the first, is resolved and answers all of them.
    ``resolve`` maps requests to (request_id, result); what it has no result for is answered by NULL. Null hashes are
    never equal, so that each is resolved on its own.
    """
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("resolved_ts").cast("timestamp"))
    rows = requests.withColumn("_key", F.coalesce(F.concat(F.lit("h"), "ref_hash"), F.concat(F.lit("r"), F.col("request_id").cast("string"))))
    if stored is None:
        known = rows.select("request_id", "_key", "ts").where("false").select("request_id", F.lit(None).cast("timestamp").alias("resolved_ts"), F.lit(None).cast("string").alias("result"))
    else:
        entries = stored.where("ref_hash is not null").select(F.concat(F.lit("h"), "ref_hash").alias("_key"), "resolved_ts", "result")
        hits = rows.select("request_id", "_key", "ts").join(entries, "_key").where((age >= 0) & (age <= ttl_seconds * 1_000_000))
        known = hits.groupBy("request_id").agg(F.max(F.struct("resolved_ts", "result")).alias("e")).select("request_id", "e.*")
    missing = rows.join(known.select("request_id"), "request_id", "left_anti")
    first = missing.groupBy("_key").agg(F.min(F.struct("ts", "request_id")).alias("f")).select("_key", F.col("f.ts").alias("resolved_ts"), F.col("f.request_id").alias("request_id"))
    found = resolve(missing.drop("_key").join(first.select("request_id"), "request_id", "left_semi")).select("request_id", "result")
    fresh = first.join(found, "request_id", "left").drop("request_id")
    old = requests.join(known, "request_id").withColumn("cached", F.lit(True))
    new = missing.join(fresh, "_key").drop("_key").withColumn("cached", F.lit(False))
    return old.unionByName(new)


def answer_stream(requests: DataFrame, resolve: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, ttl_seconds: int = 3600, **trigger) -> StreamingQuery:
    """Answer streamed requests into ``sink``, which is also the cache: a batch looks its hashes up in what earlier batches
    have resolved within the time to live. A batch that runs again reads the same earlier batches and replaces its own
    rows, so it gives the same answers."""
    spark = requests.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        stored = None
        if batch_id:
            oldest = batch.agg(F.min(F.col("ts").cast("timestamp"))).first()[0]
            kept = spark.read.parquet(sink).where((F.col("batch_id") < batch_id) & ~F.col("cached"))
            stored = kept if oldest is None else kept.where(F.col("resolved_ts") >= F.lit(oldest) - F.make_interval(secs=F.lit(ttl_seconds)))
        commit(answered(batch, stored, resolve, ttl_seconds), batch_id, sink)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def resolve_stream(requests: DataFrame, resolve: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Resolve each micro-batch against static catalogs with the batch functions into its own partition of ``sink``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        commit(resolve(batch), batch_id, sink)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

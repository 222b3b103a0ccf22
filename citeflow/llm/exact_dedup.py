"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of every task, merged, name the digests that may be frequent; one more pass counts these
exactly. The verified winners (at most ``counters`` rows, about 60 bytes each) are broadcast, and their rows are settled
on the map side. Only the remaining digests are shuffled, and none of their groups exceeds ``rows / counters``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch, text_or_empty

COUNTERS = 256


def normalised(name: str = "text"):
    """The text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(name), SPACES, " ")


def misra_gries(counts: dict, items: list, k: int) -> None:
    """Add ``items`` to a summary of at most ``k`` counters; an item left out has at most ``n / (k + 1)`` of all."""
    for x in items:
        if x in counts:
            counts[x] += 1
        elif len(counts) < k:
            counts[x] = 1
        else:
            for y in [y for y, c in counts.items() if c == 1]:
                del counts[y]
            for y in counts:
                counts[y] -= 1


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            misra_gries(counts, batch.column(0).to_pylist(), k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"])

    return run


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> list[bytes]:
    """At most ``counters`` digests, among them each that holds over ``rows / counters`` rows (after verifying).

    The tasks' summaries are added up by digest; of the sums the ``counters + 1`` largest reach the driver, and the
    smallest of these is taken off the others (the usual merge of such summaries).
    """
    sums = digests.select("digest").mapInArrow(_summaries(counters), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "digest").limit(counters + 1).collect()
    least = top[counters]["n"] if len(top) > counters else 0
    return [bytes(r["digest"]) for r in top[:counters] if r["n"] > max(1, least)]


def winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Exact (digest, win_id, win_uid, win_size) of the frequent digests: at most ``counters`` rows. Rows of ``digests``
    (doc_id, digest, uid) that share the smallest id, or have none, are told apart by uid."""
    found = heavy_digests(digests, counters)
    heavy = digests.where(F.col("digest").isin(found)) if found else digests.where("false")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("w")
    return heavy.groupBy("digest").agg(first, F.count("*").alias("win_size")).select("digest", F.col("w.doc_id").alias("win_id"), F.col("w.uid").alias("win_uid"), "win_size")


def _first(digest: str = "digest") -> Window:
    return Window.partitionBy(digest).orderBy(F.col("doc_id").asc_nulls_last())


def dedup_report(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space became one space. The row with the
    smallest doc_id stays; a null doc_id comes after all others; of repeated rows (same id, equal text) exactly one
    stays. A null text counts as empty, and all empty texts are equal. Other columns are not read, an empty table
    gives no rows. A text is read whole by its task and leaves it as a digest, however long it is.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest"))
    slim = Scratch(spark).keep(slim.withColumn("uid", F.monotonically_increasing_id()), "digests")
    tagged = slim.join(F.broadcast(winners(slim, counters)), "digest", "left")
    whole = Window.partitionBy("digest")
    rest = tagged.where("win_size is null").select(
        "doc_id",
        F.min("doc_id").over(whole).alias("keep_id"),
        F.count("*").over(whole).alias("group_size"),
        (F.row_number().over(_first()) == 1).alias("kept"),
        "digest",
    )
    frequent = tagged.where("win_size is not null").select(
        "doc_id", F.col("win_id").alias("keep_id"), F.col("win_size").alias("group_size"), (F.col("uid") == F.col("win_uid")).alias("kept"), "digest"
    )
    return rest.unionAll(frequent).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called. Rules of ``dedup_report``."""
    digest = F.unhex(F.sha2(normalised(), 256)).alias("digest")
    slim = Scratch(docs.sparkSession).keep(docs.select("doc_id", digest).withColumn("uid", F.monotonically_increasing_id()), "digests")
    rows = docs.select("doc_id", digest, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    tagged = rows.join(F.broadcast(winners(slim, counters)), "digest", "left")
    left = tagged.where(F.col("win_size").isNull() | F.col("doc_id").eqNullSafe(F.col("win_id")))
    return left.withColumn("place", F.row_number().over(_first())).where("place = 1").select("row.*")

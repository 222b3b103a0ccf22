"""Batch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT_COLUMNS = ["doc_id", "pos", "ref_id", "type", "formatted", "report", "verification", "csl_json", "bibtex", "status", "error"]


def numbered(results: DataFrame) -> DataFrame:
    """(doc_id, n, line): '[n] reference' in input order."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return results.withColumn("n", n).select("doc_id", "n", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "formatted").alias("line"))


def write_numbered(results: DataFrame, path: str) -> None:
    """Text lines 'doc_id<TAB>[n] reference', in order within a document; each file holds a range of documents."""
    rows = numbered(results).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n")
    rows.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "line")).write.text(path)


def result_rows(results: DataFrame) -> DataFrame:
    return results.select(*[c for c in RESULT_COLUMNS if c in results.columns])


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "error").alias("errors"))


def _joined(rows: DataFrame, entry: Column, sep: str, name: str) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("x")))), lambda s: s["x"])
    return rows.groupBy("doc_id").agg(F.array_join(texts, sep).alias(name))


def preview(results: DataFrame, n: int = 10, chars: int = 200) -> DataFrame:
    """(doc_id, preview): the first ``n`` references with the start of their reports (a report, so limited)."""
    entry = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), "formatted", F.lit("\n"), F.left("report", F.lit(chars)))
    return _joined(results.where(F.col("pos") <= n), entry, "\n\n", "preview")


def report_document(results: DataFrame) -> DataFrame:
    """(doc_id, document): one Markdown text per document with original, processed and report of each reference."""
    entry = F.concat(
        F.lit("## Reference "), F.col("pos").cast("string"), F.lit("\n\n**Original:** "), "reference", F.lit("\n\n**Processed:** "), "formatted", F.lit("\n\n"), F.coalesce("report", F.lit(""))
    )
    return _joined(results, entry, "\n\n", "document")


def with_status(df: DataFrame, error: Column, skipped: Column) -> DataFrame:
    """Adds status and error; a failed row keeps its reference with a mark and doesn't end the batch."""
    failed = error.isNotNull()
    return (
        df.withColumn("error", error)
        .withColumn("status", F.when(failed, "error").when(skipped, "skipped").otherwise("success"))
        .withColumn("formatted", F.when(failed, F.concat("reference", F.lit(" [ERROR]"))).when(skipped, F.col("reference")).otherwise(F.col("formatted")))
    )

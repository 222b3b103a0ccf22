"""Screening references for retractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from .lookup import by_title
from .segment import extract_references

# Relations of a retracted work.
RELATIONS = ["is-retracted-by", "has-retraction"]


def retraction_mark(relation: Column, update_to: Column) -> Column:
    """'relation', 'update-to' or NULL for a catalog record."""
    dois = F.filter(F.coalesce(update_to, F.array().cast("array<struct<DOI:string,type:string,source:string,updated:string>>")), lambda u: u["type"] == "retraction")
    return F.when(relation.isin(RELATIONS), "relation").when(F.size(dois) > 0, "update-to")


def check_retractions(titles: DataFrame, works: DataFrame, k: int = 5, at_least: float = 0.5) -> DataFrame:
    """(ref_id, is_retracted, reason, title, update_dois): the first of a title's ``k`` nearest works that bears a
    retraction mark. ``works`` has cand_key, title, doi_key, relation and update_to."""
    catalog = works.withColumn("source", F.lit("crossref"))
    hits = by_title(titles, catalog, at_least, k, variants=False)
    marked = hits.withColumn("reason", retraction_mark(F.col("relation"), F.col("update_to"))).where("reason is not null")
    dois = F.array_join(F.transform("update_to", lambda u: F.coalesce(u["DOI"], F.lit("unknown"))), ", ")
    first = marked.groupBy("ref_id").agg(F.min_by(F.struct("reason", "title", F.when(F.col("reason") == "update-to", dois).alias("update_dois")), "rank").alias("m"))
    return titles.select("ref_id").join(first, "ref_id", "left").select("ref_id", F.col("m").isNotNull().alias("is_retracted"), "m.reason", "m.title", "m.update_dois")


def retracted_only(titles: DataFrame, works: DataFrame, **how) -> DataFrame:
    """The variant that filters the catalog first: (ref_id, titles) of references that any retracted work is near."""
    bad = works.where(retraction_mark(F.col("relation"), F.col("update_to")).isNotNull()).withColumn("source", F.lit("crossref"))
    hits = by_title(titles, bad, k=5, variants=False, **how)
    return hits.groupBy("ref_id").agg(F.array_join(F.array_sort(F.collect_set("title")), "; ").alias("titles"))


def split_by_retraction(titles: DataFrame, works: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(retracted, others): the semi join and its complement."""
    bad = retracted_only(titles, works, **how)
    return titles.join(bad, "ref_id", "left_semi"), titles.join(bad, "ref_id", "left_anti")


def screen_documents(docs: DataFrame, works: DataFrame, **how) -> DataFrame:
    """(doc_id, n_references, n_retracted, flagged): references of each document that are retracted."""
    refs = extract_references(docs).withColumn("ref_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("pos").cast("string"))).withColumn("title", F.coalesce(F.nullif(F.regexp_extract("reference", "\"([^\"]{3,})\"", 1), F.lit("")), F.col("reference")))
    checked = check_retractions(refs.select("ref_id", "title"), works, **how)
    rows = refs.join(checked.select("ref_id", "is_retracted"), "ref_id")
    flagged = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_retracted"), F.struct("pos", "reference")))), lambda s: s["reference"]), "\n")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_references"), F.count_if("is_retracted").alias("n_retracted"), flagged.alias("flagged"))


def screen_folder(spark: SparkSession, path: str, works: DataFrame, **how) -> DataFrame:
    """``screen_documents`` over the .docx files below a folder; files that can't be read give no references."""
    texts = files.read_docx(files.read_binary(spark, path, "*.docx"), keep_blank=True).where("error is null")
    return screen_documents(texts.select(F.col("path").alias("doc_id"), "text"), works, **how)

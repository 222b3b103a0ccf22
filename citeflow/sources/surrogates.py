"""Bibliographic tables derived from the driver's order tables: references, candidates, reference strings, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import SOURCES

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_BY_LINE = ["crossref", "openalex", "semanticscholar", "ieeexplore", "pubmed", "arxiv"]
assert sorted(_BY_LINE) == sorted(SOURCES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: a record found for the order, from the source of its line number. Lines are dealt by
    ``ref_id`` itself and numbered before texts are made of them: joins and groups by reference that follow need no other
    shuffle, and the one shuffle moves columns of the tables."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey")).join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey"))
    rows = rows.selectExpr("l_orderkey AS ref_id", *_ORDER, "p_name", "p_brand", "p_type", "p_size", "s_name")
    rows = rows.selectExpr("*", f"row_number() OVER (PARTITION BY ref_id ORDER BY {', '.join(_ORDER)}) AS cand_ord")
    sources = ", ".join(f"'{s}'" for s in _BY_LINE)
    return rows.selectExpr(
        "ref_id",
        "cand_ord",
        f"coalesce(get(array({sources}), cast(l_linenumber AS int) - 1), 'other') AS source",
        "p_name AS title",
        "array(concat('Anna Maria ', s_name), concat('J.-P. ', substr(p_name, 1, 5))) AS authors",
        "concat_ws(' ', p_brand, p_type) AS journal_name",
        "concat('B. ', p_brand) AS journal_abbrev",
        "cast(l_suppkey AS string) AS volume",
        "cast(cast(l_quantity AS int) % 12 AS string) AS issue",
        "CASE WHEN l_partkey % 3 = 0 THEN cast(l_partkey AS string) ELSE concat(cast(l_partkey AS string), CASE WHEN l_partkey % 3 = 1 THEN '-' ELSE '–' END, cast(l_partkey + cast(l_quantity AS bigint) AS string)) END AS pages",
        "cast(year(l_shipdate) AS string) AS year",
        "cast(month(l_shipdate) AS string) AS month",
        "CASE WHEN ref_id % 2 = 0 AND l_linenumber IN (1, 2, 4) THEN concat('10.1000/', cast(ref_id AS string)) WHEN l_partkey % 5 = 0 THEN concat('10.2000/', cast(l_partkey AS string)) END AS doi",
        "CASE WHEN l_linenumber = 1 THEN if(p_size % 2 = 0, 'journal-article', 'proceedings-article') END AS cr_type",
        "l_linenumber = 2 AND p_size % 3 = 0 AS oa_is_proceedings",
        "CASE WHEN l_linenumber = 3 THEN array('JournalArticle', if(p_size % 4 = 0, 'Conference', 'Review')) END AS s2_types",
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: a parsed reference whose title is near that of the first candidate, if there is one."""
    first = candidates(spark, sf_dir).where("cand_ord = 1").selectExpr("ref_id AS k", "title AS t", "authors AS a", "journal_name AS j", "pages AS p")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).join(first, F.expr("o_orderkey = k"), "left")
    seven = ", ".join(f"concat('{x}. Author', cast(c_nationkey AS string))" for x in "ABCDEFG")
    return rows.selectExpr(
        "o_orderkey AS ref_id",
        "CASE WHEN t IS NULL THEN concat('untitled work ', cast(o_orderkey AS string)) WHEN o_orderkey % 3 = 0 THEN t WHEN o_orderkey % 3 = 1 THEN concat(upper(t), '.') ELSE concat(t, ' revisited') END AS title",
        f"CASE o_orderkey % 4 WHEN 0 THEN a WHEN 1 THEN array(concat(initcap(lower(c_mktsegment)), ' van Dyk', cast(c_nationkey AS string)), 'Lee, Mary-Ann', 'Kim Jr., Q.') WHEN 2 THEN array({seven}) END AS authors",
        "CASE WHEN o_orderkey % 5 = 0 THEN j ELSE concat('Journal of ', c_mktsegment) END AS journal_name",
        "cast(NULL AS string) AS journal_abbrev",
        "cast(o_custkey AS string) AS volume",
        "substr(o_orderpriority, 1, 1) AS issue",
        r"CASE WHEN o_orderkey % 2 = 0 THEN regexp_extract(p, r'^(\d+)', 1) ELSE p END AS pages",
        "cast(year(o_orderdate) AS string) AS year",
        "CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'MMM') ELSE cast(month(o_orderdate) AS string) END AS month",
        "CASE WHEN o_orderkey % 4 = 0 THEN concat('https://doi.org/10.1000/', cast(o_orderkey AS string)) WHEN o_orderkey % 2 = 0 THEN concat('doi:10.1000/', cast(o_orderkey AS string)) END AS doi",
        "o_custkey AS doc_id",
    )


def reference_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, ref_id, reference): a formatted line for each reference, in order within its customer's list."""
    parts = [
        "concat('A. Author', cast(ref_id % 7 AS string), ' and B. Writer', cast(ref_id % 5 AS string))",
        """concat('"', title, ',"')""",
        "concat('*', journal_name, '*')",
        "concat('vol. ', volume)",
        "concat('no. ', issue)",
        "CASE WHEN pages <> '' THEN concat('pp. ', pages) END",
        "year",
        "CASE WHEN ref_id % 2 = 0 THEN concat('doi: 10.1000/', cast(ref_id AS string)) WHEN ref_id % 9 = 0 THEN concat('arXiv:2101.', lpad(cast(ref_id % 100000 AS string), 5, '0'), 'v2') END",
    ]
    return references(spark, sf_dir).selectExpr("doc_id", "row_number() OVER (PARTITION BY doc_id ORDER BY ref_id) AS pos", "ref_id", f"concat(concat_ws(', ', {', '.join(parts)}), '.') AS reference")


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text): each customer's reference list in one of three layouts, under a heading."""
    lines = reference_strings(spark, sf_dir).groupBy("doc_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, reference))), s -> s.reference) AS lines"))
    marked = r"array_join(transform(lines, (x, i) -> concat('[', cast(i + 1 AS string), '] ', x)), '\r\n')"
    layout = rf"CASE doc_id % 3 WHEN 0 THEN concat('Body text\nReferences\r\n', {marked}) WHEN 1 THEN array_join(lines, '\n\n\n') ELSE array_join(lines, '\n') END"
    ext = "element_at(array('.txt', '.TEX', '.docx', '.doc', '.png', ''), cast(doc_id % 6 + 1 AS int))"
    return lines.selectExpr("doc_id", f"concat('in/file', cast(doc_id AS string), {ext}) AS path", f"{layout} AS text")

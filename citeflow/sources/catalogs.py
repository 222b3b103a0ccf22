"""Catalog records of each source in one shape. A source is a raw schema and a function from the raw row to a record;
``SOURCES_BY_NAME`` may be extended by the caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import doi_key, given, text, words
from ..schemas import FIELDS

_DATE = "struct<`date-parts`:array<array<int>>>"
RAW = {
    "crossref": "title array<string>, author array<struct<given:string,family:string>>, `container-title` array<string>, `short-container-title` array<string>, "
    f"volume string, issue string, page string, DOI string, type string, URL string, issued {_DATE}, `published-print` {_DATE}, `published-online` {_DATE}, "
    "relation map<string,string>, `update-to` array<struct<DOI:string,type:string,source:string,updated:string>>, update array<struct<DOI:string,type:string,source:string,updated:string>>",
    "openalex": "id string, display_name string, title string, doi string, authorships array<struct<author:struct<display_name:string>>>, host_venue struct<display_name:string,abbrev:string>, "
    "biblio struct<volume:string,issue:string,first_page:string,last_page:string>, publication_year int, from_publication_date string",
    "semanticscholar": "paperId string, title string, venue string, year int, authors array<struct<name:string>>, externalIds struct<DOI:string>, doi string, "
    "publicationVenue struct<name:string>, publicationTypes array<string>",
    "pubmed": "uid string, title string, sorttitle string, fulljournalname string, source string, elocationid string, volume string, issue string, pages string, pubdate string, authors array<struct<name:string>>",
    "arxiv": "id string, title string, published string, author array<struct<name:string>>",
    "ieeexplore": "title string, htmlTitle string, publication_title string, volume string, issue string, start_page string, end_page string, publication_year string, doi string, "
    "html_url string, pdf_url string, authors struct<authors:array<struct<full_name:string,preferred_name:string>>>",
}


def raw_schema(source: str) -> T.StructType:
    return T.StructType.fromDDL(RAW[source])


def _names(a: Column, f) -> Column:
    return F.filter(F.transform(F.coalesce(a, F.array()), lambda x: text(f(x))), lambda n: n != "")


def crossref(r: Column) -> dict[str, Column]:
    first = lambda f: given(F.get(r[f], F.lit(0)))
    day = F.get(F.coalesce(*[F.when(F.size(r[d]["date-parts"]) > 0, r[d]["date-parts"]) for d in ("issued", "published-print", "published-online")]), F.lit(0))
    full = lambda a: F.concat_ws(" ", a["given"], a["family"])
    return {
        "title": first("title"), "authors": _names(r["author"], full), "journal_name": first("container-title"),
        "journal_abbrev": first("short-container-title"), "volume": given(r["volume"]), "issue": given(r["issue"]), "pages": given(r["page"]),
        "doi": given(r["DOI"]), "year": F.get(day, F.lit(0)).cast("string"), "month": F.get(day, F.lit(1)).cast("string"),
        "conference_name": F.when(given(r["type"]) == "proceedings-article", first("container-title")), "url": given(r["URL"]), "cr_type": given(r["type"]),
    }


def openalex(r: Column) -> dict[str, Column]:
    venue, a, b = given(r["host_venue"]["display_name"]), given(r["biblio"]["first_page"]), given(r["biblio"]["last_page"])
    proceedings = F.coalesce(F.contains(F.lower(venue), F.lit("proceedings")), F.lit(False))
    return {
        "title": F.coalesce(given(r["display_name"]), given(r["title"])), "authors": _names(r["authorships"], lambda x: x["author"]["display_name"]),
        "journal_name": venue, "journal_abbrev": given(r["host_venue"]["abbrev"]), "volume": given(r["biblio"]["volume"]), "issue": given(r["biblio"]["issue"]),
        "pages": F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit("-"), b)).otherwise(a), "doi": given(r["doi"]),
        "year": F.coalesce(r["publication_year"].cast("string"), F.nullif(F.left(r["from_publication_date"], F.lit(4)), F.lit(""))),
        "conference_name": F.when(proceedings, venue), "oa_is_proceedings": proceedings,
    }


def semanticscholar(r: Column) -> dict[str, Column]:
    return {
        "title": given(r["title"]), "authors": _names(r["authors"], lambda a: a["name"]), "journal_name": F.coalesce(given(r["venue"]), given(r["publicationVenue"]["name"])),
        "doi": F.coalesce(given(r["externalIds"]["DOI"]), given(r["doi"])), "year": r["year"].cast("string"), "s2_types": F.transform(r["publicationTypes"], text),
    }


def pubmed(r: Column) -> dict[str, Column]:
    return {
        "title": F.coalesce(given(r["title"]), given(r["sorttitle"])), "authors": _names(r["authors"], lambda a: a["name"]),
        "journal_name": F.coalesce(given(r["fulljournalname"]), given(r["source"])), "journal_abbrev": given(r["source"]),
        "doi": given(F.replace(r["elocationid"], F.lit("doi:"), F.lit(""))), "volume": given(r["volume"]), "issue": given(r["issue"]), "pages": given(r["pages"]),
        "year": F.get(words(r["pubdate"]), F.lit(0)),
    }


def arxiv(r: Column) -> dict[str, Column]:
    """From an Atom entry: the entry's own title, all names, the year of publication."""
    return {
        "title": given(r["title"]), "authors": _names(r["author"], lambda a: a["name"]), "journal_name": F.lit("arXiv"), "journal_abbrev": F.lit("arXiv"),
        "year": F.nullif(F.regexp_extract(r["published"], r"^(\d{4})", 1), F.lit("")), "arxiv_id": F.nullif(F.regexp_extract(r["id"], r"(\d{4}\.\d{4,5})", 1), F.lit("")),
    }


def ieeexplore(r: Column) -> dict[str, Column]:
    a, b = given(r["start_page"]), given(r["end_page"])
    return {
        "title": F.coalesce(given(r["title"]), given(r["htmlTitle"])), "authors": _names(r["authors"]["authors"], lambda x: F.coalesce(given(x["full_name"]), x["preferred_name"])),
        "journal_name": given(r["publication_title"]), "volume": given(r["volume"]), "issue": given(r["issue"]),
        "pages": F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit("-"), b)).otherwise(F.coalesce(a, b)), "year": given(r["publication_year"]), "doi": given(r["doi"]),
    }


SOURCES_BY_NAME: dict[str, Callable[[Column], dict[str, Column]]] = {
    "crossref": crossref, "openalex": openalex, "semanticscholar": semanticscholar, "pubmed": pubmed, "arxiv": arxiv, "ieeexplore": ieeexplore,
}

_EXTRA = {"cr_type": "string", "oa_is_proceedings": "boolean", "s2_types": "array<string>", "arxiv_id": "string"}


def normalise(raw: DataFrame, source: str) -> DataFrame:
    """A table with a ``raw`` struct of the source's schema (other columns stay) -> source, record fields and keys.
    Records with neither title nor DOI are dropped."""
    got = SOURCES_BY_NAME[source](F.col("raw"))
    cols = [F.lit(source).alias("source")]
    cols += [got.get(f, F.lit(None)).cast("array<string>" if f == "authors" else "string").alias(f) for f in FIELDS]
    cols += [got.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in _EXTRA.items()]
    rest = [c for c in raw.columns if c not in ("raw", "source", *FIELDS, *_EXTRA)]
    out = raw.select(*rest, *cols, F.col("raw"))
    return out.withColumn("doi_key", doi_key("doi")).where("title is not null or doi_key is not null")


def read_json(spark, path: str, source: str) -> DataFrame:
    """A dump of JSON records, one a line."""
    rows = spark.read.schema(raw_schema(source)).json(path)
    return normalise(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("raw")), source)


def read_atom(spark, path: str) -> DataFrame:
    """A feed of Atom entries."""
    rows = spark.read.schema(raw_schema("arxiv")).option("rowTag", "entry").xml(path)
    return normalise(rows.select(F.struct("*").alias("raw")), "arxiv")


def from_json_column(df: DataFrame, column: str, source: str) -> DataFrame:
    return normalise(df.withColumn("raw", F.from_json(column, raw_schema(source))).drop(column), source)


def from_mixed_json(df: DataFrame, column: str) -> DataFrame:
    """Payloads of several sources in one table (source, a column of JSON) -> the columns of ``normalise`` in one pass, without
    a union of its sources; rows of sources that aren't known are dropped."""
    known = list(SOURCES_BY_NAME)
    raw = df.select("*", *[F.from_json(F.when(F.col("source") == s, F.col(column)), raw_schema(s)).alias(f"_{s}") for s in known]).drop(column)
    kinds = {**{f: "array<string>" if f == "authors" else "string" for f in FIELDS}, **_EXTRA}

    def record(s: str) -> Column:
        got = SOURCES_BY_NAME[s](F.col(f"_{s}"))
        return F.struct(*[got.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in kinds.items()])

    one = F.when(F.col("source") == known[0], record(known[0]))
    for s in known[1:]:
        one = one.when(F.col("source") == s, record(s))
    rest = [c for c in df.columns if c not in (column, *kinds)]
    # exploded, so that conditions on the record don't parse a payload again
    rows = raw.where(F.col("source").isin(known)).select(*rest, F.inline(F.array(one)))
    return rows.withColumn("doi_key", doi_key("doi")).where("title is not null or doi_key is not null")


def retraction_notices(catalog: DataFrame, n: int | None = None) -> DataFrame:
    """Updates of works whose notice says retraction: title, doi, update_doi, update_source, updated; the first ``n``
    works by DOI if given (a report)."""
    raw = F.col("raw")
    rows = catalog.where(F.exists(F.coalesce(raw["update-to"], F.array()), lambda u: u["type"] == "retraction"))
    if n is not None:
        rows = rows.orderBy("doi").limit(n)
    rows = rows.select("title", "doi", F.explode_outer(F.coalesce(raw["update-to"], raw["update"])).alias("u"))
    return rows.select("title", "doi", F.coalesce("u.DOI", F.lit("Unknown DOI")).alias("update_doi"), F.coalesce("u.source", F.lit("Unknown source")).alias("update_source"), F.coalesce("u.updated", F.lit("Unknown date")).alias("updated"))

"""Documents from files, and recorded model output."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import stripped

TEXT_EXTENSIONS = ["txt", "bbl", "tex"]
ALLOWED = [*TEXT_EXTENSIONS, "docx"]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def route(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects) of a table with a path: rejects have a reason."""
    ext = extension(F.col("path"))
    rows = files.withColumn("ext", ext).withColumn(
        "reason",
        F.when(F.col("ext") == "doc", "Legacy .doc is not supported; save as .docx").when(F.col("ext") == "pdf", "Text of .pdf files must be extracted before").when(~F.col("ext").isin(ALLOWED), F.concat(F.lit("Unsupported file type: ."), "ext")),
    )
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes; what can't be decoded is left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def read_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")


def read_texts(files: DataFrame) -> DataFrame:
    """(path, text) of text files."""
    return files.where(extension(F.col("path")).isin(TEXT_EXTENSIONS)).select("path", decoded(F.col("content")).alias("text"))


def docx_paragraphs(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return ["".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")) for p in root.iter(f"{_W}p")]


def read_docx(files: DataFrame, keep_blank: bool = False) -> DataFrame:
    """(path, text, error) of .docx files: paragraphs joined by line breaks, blank ones left out unless asked for. A
    file that can't be read has a null text and an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch.path, batch.content):
                try:
                    out.append((path, docx_paragraphs(content), None))
                except Exception as e:  # one unreadable file doesn't end the batch
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "paragraphs", "error"])

    rows = files.where(extension(F.col("path")) == "docx").select("path", "content").mapInPandas(run, "path string, paragraphs array<string>, error string")
    kept = F.col("paragraphs") if keep_blank else F.filter("paragraphs", lambda p: stripped(p) != "")
    return rows.select("path", F.array_join(kept, "\n").alias("text"), "error")


def concatenated(files: DataFrame) -> DataFrame:
    """(doc_id, text, error) of parts (doc_id, file_ord, text): trimmed, blank ones dropped, a blank line between."""
    own = F.array_sort(F.collect_list(F.when(stripped("text") != "", F.struct("file_ord", stripped("text").alias("t")))))
    rows = files.groupBy("doc_id").agg(F.array_join(F.transform(own, lambda s: s["t"]), "\n\n").alias("text"))
    return rows.withColumn("error", F.when(F.col("text") == "", "No text found."))


def pasted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects) of rows with a text."""
    blank = stripped("text") == ""
    return rows.where(~blank), rows.where(blank).withColumn("reason", F.lit("No text provided."))


def corpus_dump(files: DataFrame, extensions: list[str], skip: list[str]) -> DataFrame:
    """(path, entry): name and content of files with given extensions outside given folders; a note for binary ones."""
    parts = F.split("path", "/")
    own = files.where(extension(F.col("path")).isin(extensions) & ~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in skip])))
    body = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise("[BINARY FILE - CONTENT NOT READ]")
    return own.select("path", F.concat(F.element_at(parts, -1), F.lit(":\n"), body, F.lit("\n\n")).alias("entry"))


_DECODER = json.JSONDecoder()


def first_object(s: str | None) -> str | None:
    """The first object inside a string: the first place of a brace from which JSON can be read."""
    at = s.find("{") if s else -1
    while at >= 0:
        try:
            return s[at : _DECODER.raw_decode(s, at)[1]]
        except (ValueError, RecursionError):
            at = s.find("{", at + 1)
    return None


def _balanced_batch(s: pd.Series) -> pd.Series:
    return s.map(first_object)


def _balanced(s: Column) -> Column:
    return F.pandas_udf(_balanced_batch, "string")(s)


def lenient_json(raw: Column) -> Column:
    """The JSON object in a model's raw output, as a string: the whole if it is one, else the first inside it. Only
    the latter goes to Python."""
    s = stripped(raw)
    whole = F.startswith(s, F.lit("{")) & F.try_parse_json(s).isNotNull()
    return F.when(F.coalesce(whole, F.lit(False)), s).otherwise(_balanced(F.when(~F.coalesce(whole, F.lit(False)), s)))


def coerced(raw: Column, schema: str) -> Column:
    """Known fields of the JSON object, by a schema; NULL if there is no object."""
    return F.from_json(lenient_json(raw), schema)

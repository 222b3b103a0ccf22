"""Splitting documents into references."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import bound, stripped

# Patterns that segmentation must agree on.
MARKER = r"^\s*(?:\[\d+\]|\d+\.|[-•])"
KEY = r"(?i)\b10\.\d{4,9}/\S+\b|https?://\S+|\b(?:19|20)\d{2}\b"
AUTHOR_LIKE = r"^([A-Z][a-z]+|[A-Z]\.)[^\n]{0,60}\b([A-Z][a-z]+|[A-Z]\.)"
HEADING = "REFERENCES|References|Bibliography"
VENUE_LIKE = r"Proc\.|Proceedings|IEEE"


def newlines(t: Column) -> Column:
    """One kind of line break, at most one blank line in a row, outer white space gone."""
    return F.regexp_replace(F.regexp_replace(stripped(t), r"\r\n?", "\n"), r"\n{3,}", "\n\n")


def lines(t: Column) -> Column:
    return F.transform(F.split(newlines(t), "\n"), stripped)


def is_marker(line: Column) -> Column:
    return line.rlike(MARKER)


def has_marker(ls: Column) -> Column:
    return F.exists(ls, is_marker)


def strip_marker(line: Column) -> Column:
    return F.regexp_replace(line, MARKER + r"\s*", "")


def split_marked(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, reference): a reference from each marker line on; text before the first is one of its own.
    Gaps and islands over numbered lines, so that a document's length doesn't matter."""
    rows = docs.select("doc_id", F.posexplode(lines(F.col("text"))).alias("n", "line")).where("line <> ''")
    upto = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("part", F.sum(is_marker(F.col("line")).cast("int")).over(upto)).withColumn("line", F.when(is_marker(F.col("line")), strip_marker(F.col("line"))).otherwise(F.col("line")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"])
    found = rows.groupBy("doc_id", "part").agg(stripped(F.array_join(texts, " ")).alias("reference")).where("reference <> ''")
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("part")).alias("pos"), "reference")


def _sliced(texts: Column, starts: Column) -> Column:
    """A reference from each start to the next, those that aren't blank."""
    part = lambda s, k: stripped(F.array_join(F.slice(texts, s, F.coalesce(F.get(starts, k + 1), F.size(texts) + 1) - s), " "))
    return F.filter(F.transform(starts, part), lambda r: r != "")


def cut_marked(ls: Column) -> Column:
    """The same as an array expression, in linear time: the lines that start a reference are found first, then each
    reference is one slice."""

    def cut(own: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: (i == 1) | is_marker(own[i - 1]))
        bare = F.transform(own, lambda x: F.when(is_marker(x), strip_marker(x)).otherwise(x))
        return bound(F.struct(bare.alias("texts"), starts.alias("at")), lambda p: _sliced(p["texts"], p["at"]))

    own = F.filter(ls, lambda x: x != "")
    return bound(own, lambda o: F.when(F.size(o) == 0, F.array().cast("array<string>")).otherwise(cut(o)))


def paragraphs(t: Column) -> Column:
    return F.filter(F.transform(F.split(newlines(t), r"\n\s*\n"), stripped), lambda p: p != "")


def looks_new(line: Column) -> Column:
    """Whether a line may start a reference."""
    return line.rlike(AUTHOR_LIKE) | ((F.length(line) < 140) & F.endswith(line, F.lit("."))) | line.rlike(VENUE_LIKE)


def cut_by_cues(t: Column) -> Column:
    """One block of text: a new reference where a line may start one and the last two lines of the current one hold a
    DOI, URL or year. In linear time: each line is looked at once and each reference is one slice.

    No fold is needed to know which line starts a reference. If the line before holds a key, a line that may start one
    does. Else it takes a key in the line before that, in the same reference: the line between must not have started one,
    and as a key stands before it, it did so just if it may.
    """
    own = F.filter(lines(t), lambda x: x != "")

    def starts(marks: Column) -> Column:
        new, key = (lambda i: F.get(marks, i - 1)["new"]), (lambda i: F.get(marks, i - 1)["key"])
        begins = lambda i: new(i) & (key(i - 1) | ((i > 2) & key(i - 2) & ~new(i - 1)))
        return F.filter(F.sequence(F.lit(1), F.size(marks)), lambda i: (i == 1) | F.coalesce(begins(i), F.lit(False)))

    def cut(texts: Column) -> Column:
        # keys hold no white space, so none spans two lines
        marks = F.transform(texts, lambda x: F.struct(looks_new(x).alias("new"), x.rlike(KEY).alias("key")))
        return bound(F.struct(texts.alias("texts"), bound(marks, starts).alias("at")), lambda p: _sliced(p["texts"], p["at"]))

    found = bound(own, lambda o: F.when(F.size(o) > 0, cut(o)))
    return bound(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(stripped(t))))


def references_of(t: Column) -> Column:
    """A document's references as an array: by markers, else by blank lines, else by cues; none if blank."""
    parts = paragraphs(t)
    return F.when(stripped(t) == "", F.array().cast("array<string>")).when(has_marker(lines(t)), cut_marked(lines(t))).when(F.size(parts) > 1, parts).otherwise(cut_by_cues(t))


def split_references(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, reference) of documents (doc_id, text), positions from 1. Narrow: no shuffle."""
    rows = docs.select("doc_id", F.posexplode(references_of(F.col("text"))).alias("pos", "reference"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("pos"), "reference")


def extract_references(docs: DataFrame, longer_than: int = 10) -> DataFrame:
    """(doc_id, pos, reference): the numbered entries after a reference heading."""
    after = F.regexp_extract("text", rf"(?s)^.*?(?:{HEADING})(.*)$", 1)
    entries = F.filter(F.transform(F.split(after, r"\n\s*\d+\.\s+|\n\s*\[\d+\]\s+"), stripped), lambda r: F.length(r) > longer_than)
    rows = docs.where(F.col("text").rlike(HEADING)).select("doc_id", F.posexplode(entries).alias("pos", "reference"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("pos"), "reference")


def line_count(t: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(F.coalesce(t, F.lit("")), r"\r?\n"), lambda x: stripped(x) != ""))


class SplitReferences:
    """``references_of`` as a table function for SQL; text by text in Python, so tables had better use the former."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        own = re.sub(r"\n{3,}", "\n\n", re.sub(r"\r\n?", "\n", (text or "").strip()))
        rows = [r for line in own.split("\n") if (r := line.strip())]
        parts = [p for part in re.split(r"\n\s*\n", own) if (p := part.strip())]
        if any(re.match(MARKER, r) for r in rows):
            found: list[list[str]] = []
            for r in rows:
                if re.match(MARKER, r) or not found:
                    found.append([])
                found[-1].append(re.sub(MARKER + r"\s*", "", r))
            parts = [" ".join(f).strip() for f in found]
        elif len(parts) == 1:
            found = [[]]
            for r in rows:
                cue = re.search(AUTHOR_LIKE, r) or (len(r) < 140 and r.endswith(".")) or re.search(VENUE_LIKE, r)
                if cue and re.search(KEY, " ".join(found[-1][-2:])):
                    found.append([])
                found[-1].append(r)
            parts = [" ".join(f) for f in found]
        yield from enumerate((p for p in parts if p), 1)


def register(spark: SparkSession, name: str = "split_references") -> None:
    """Make ``name(text)`` a table function (pos, reference) of a session's SQL."""
    spark.udtf.register(name, F.udtf(SplitReferences, returnType="pos int, reference string"))

"""Column sets that the stages share. A record is a struct of text fields and an author list; absent values are NULL."""

from __future__ import annotations

# Field names, in the orders that results must agree on.
TEXT_FIELDS = [
    "title", "journal_name", "journal_abbrev", "conference_name", "volume", "issue", "pages", "year", "month", "doi",
    "publisher", "location", "edition", "isbn", "url",
]
#: Order in which fields are rewritten, logged and listed.
FIELDS = [
    "title", "authors", "journal_name", "journal_abbrev", "volume", "issue", "pages", "doi", "year", "month",
    "conference_name", "publisher", "location", "edition", "isbn", "url",
]
VOTED = [f for f in TEXT_FIELDS if f not in ("year",)]
MATCHED = ["title", "authors", "year", "journal_name", "volume", "issue", "pages", "doi"]
ALWAYS = ["title", "authors", "year", "month", "doi"]
LOCKED = ["doi", "year", "month", "title", "authors", "pages", "journal_name", "journal_abbrev", "conference_name", "volume", "issue"]
CHECKS = ["title", "authors", "journal_name", "journal_abbrev", "year", "month", "volume", "issue", "pages", "doi", "presence"]

RECORD = "struct<" + ",".join(f"{f}:{'array<string>' if f == 'authors' else 'string'}" for f in FIELDS) + ">"
CHANGE = "array<struct<round:int,step:string,field:string,old:string,new:string,by:string>>"

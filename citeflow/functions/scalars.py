"""Scalar functions of reference cleaning, as Spark column expressions.

An absent value is NULL or blank; functions that return text give '' for it, as rendering expects, unless noted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and codes that results must agree on.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
#: source: (order, matches of a title lookup, answers to a DOI, vote weight, score weight, trusted, label)
SOURCES = {
    "crossref": (1, 5, True, "1.00", "0.12", True, "Crossref"),
    "openalex": (2, 5, True, "0.80", "0.08", True, "OpenAlex"),
    "semanticscholar": (3, 5, True, "0.60", "0.06", False, "Semantic Scholar"),
    "ieeexplore": (4, 3, True, "1.20", "0.16", True, "IEEE Xplore"),
    "pubmed": (5, 1, False, "0.55", "0.05", False, "PubMed"),
    "arxiv": (6, 1, False, "0.40", "0.03", False, "arXiv"),
}
OTHER_VOTE = "0.20"
LABELS = {
    "doi-agreement": "DOI agreement",
    "consensus": "Consensus",
    "normalize": "Normalization",
    "verify/llm": "LLM suggestion",
    "nlm": "NLM Catalog",
}
YEAR_PRIORITY = ["ieeexplore", "crossref", "openalex", "semanticscholar", "pubmed", "arxiv"]


def text(x: Column | str) -> Column:
    """The value with white space trimmed and collapsed, '' if absent."""
    return F.trim(F.regexp_replace(F.coalesce(_col(x).cast("string"), F.lit("")), r"(?U)\s+", " "))


def given(x: Column | str) -> Column:
    """``text``, but NULL if blank."""
    return F.nullif(text(x), F.lit(""))


def comparable(x: Column | str) -> Column:
    """Lower case, punctuation as spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(x).cast("string"), F.lit(""))), r"(?U)\W+", " "))


def stripped(x: Column | str) -> Column:
    """Trimmed only."""
    return F.regexp_replace(F.coalesce(_col(x).cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column) -> Column:
    """The same value, such that later projections read it instead of repeating its expression. Unlike a lambda it is
    compiled, with all that the value is made of."""
    return F.element_at(F.array(value), 1)


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def words(x: Column) -> Column:
    parts = F.split(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "), " ")  # split compiles its pattern at each call
    return F.filter(parts, lambda w: w != "")  # array_remove looks its ordering up for each entry


# ---- authors


def author_list(x: Column | str) -> Column:
    """Authors of one string: split at commas, ampersands and 'and'; a leading 'and' goes, and a part that is only
    initials returns to the surname before it."""
    parts = F.filter(F.transform(F.split(F.coalesce(_col(x), F.lit("")), r",\s*|\s+&\s+| and "), lambda p: F.regexp_replace(text(p), r"^and\s+", "")), lambda p: p != "")
    start = F.array().cast("array<string>")

    def add(acc: Column, p: Column) -> Column:
        bare = p.rlike(r"^(?:[A-Z]\.[ -]?)+$") & (F.size(acc) > 0) & ~F.contains(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), F.lit(","))
        glued = F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(", "), p)
        return F.when(bare, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(glued))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(parts, start, add)


def author_list_raw(x: Column | str) -> Column:
    """Plain splitting, parts as they come."""
    return F.filter(F.transform(F.split(F.coalesce(_col(x), F.lit("")), r",\s*|\s+&\s+| and "), text), lambda p: p != "")


def clean_authors(a: Column) -> Column:
    return F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), text), lambda p: p != "")


def _bare(w: Column) -> Column:
    return F.lower(F.regexp_replace(w, r"\.+$", ""))


def _suffix(w: Column) -> Column:
    plain = F.regexp_replace(w, r"\.+$", "")
    return F.concat(F.upper(F.left(plain, F.lit(1))), F.lower(F.substr(plain, F.lit(2))), F.lit("."))


def _letter(w: Column) -> Column:
    return F.concat_ws("", F.upper(F.left(w, F.lit(1))), F.lit("."))  # in lambdas concat looks its type up for each row


def _but_last(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def _initials(given_names: Column) -> Column:
    """Given names (an array) as initials, one string."""

    def one(w: Column) -> Column:
        parts = F.transform(F.filter(F.split(w, "-"), lambda h: h != ""), _letter)
        return (
            F.when(F.contains(w, F.lit("-")), F.array_join(parts, "-"))
            .when(w.rlike(r"^[A-Za-z]\.$"), F.upper(w))
            .when(_bare(w).isin(SUFFIXES), _suffix(w))
            .otherwise(_letter(w))
        )

    return F.array_join(F.transform(given_names, one), " ")


def initials(names: Column) -> Column:
    """Given names as initials, one string."""
    return _initials(words(names))


def _formatted(names: Column) -> Column:
    """Cleaned names (an array), each formatted. Each step's values are bound before the next."""

    def split(n: Column) -> Column:
        comma = F.contains(n, F.lit(","))
        return F.struct(n.alias("n"), comma.alias("comma"), words(F.when(comma, F.substring_index(n, ",", 1)).otherwise(n)).alias("w"))

    def parts(s: Column) -> Column:
        n, comma, w = s["n"], s["comma"], s["w"]
        last = F.when(comma, w).otherwise(F.slice(w, -1, 1))
        first = F.when(comma, words(F.substr(n, F.instr(n, ",") + 1))).otherwise(_but_last(w))
        return F.struct(n.alias("n"), ((n == "") | (~comma & ~F.contains(n, F.lit(" ")))).alias("alone"), last.alias("last"), _initials(first).alias("first"))

    def line(p: Column) -> Column:
        tail = F.try_element_at(p["last"], F.lit(-1))
        has = F.coalesce(_bare(tail).isin(SUFFIXES), F.lit(False))
        whole = F.when(has, F.concat(p["first"], F.lit(" "), F.array_join(_but_last(p["last"]), " "), F.lit(", "), _suffix(tail))).otherwise(F.concat(p["first"], F.lit(" "), F.array_join(p["last"], " ")))
        return F.when(p["alone"], p["n"]).otherwise(F.regexp_replace(whole, r"^[, ]+|[, ]+$", ""))

    return F.transform(F.transform(F.transform(names, split), parts), line)


def format_author(name: Column) -> Column:
    """'Last, Given' or 'Given Last' as 'G. Last', a suffix after a comma; a single word stays."""
    return _formatted(F.array(text(name)))[0]


def format_authors(a: Column, cleaned: bool = False) -> Column:
    """One name, up to six with a final 'and', from seven on the first with et al. Names that are ``cleaned`` (as in a record)
    aren't cleaned again, and of seven or more only the first is formatted."""

    def few(items: Column) -> Column:
        n = F.size(items)
        most = F.concat(F.array_join(_but_last(items), ", "), F.lit(", and "), F.try_element_at(items, F.lit(-1)))
        return F.when(n == 0, "").when(n == 1, items[0]).otherwise(most)

    def line(names: Column) -> Column:
        many = F.size(names) >= 7
        shown = F.when(many, F.slice(names, 1, 1)).otherwise(names)
        return F.concat(bound(_formatted(shown), few), F.when(many, F.lit(" *et al.*")).otherwise(F.lit("")))

    return bound(F.coalesce(a, F.array().cast("array<string>")) if cleaned else clean_authors(a), line)


def _key_of(toks: Column, spelled: bool) -> Column:
    """The key of a name's words."""
    last = F.try_element_at(toks, F.lit(-1))
    letters = F.filter(_but_last(toks), lambda w: w.rlike(r"^\p{L}") if spelled else w.rlike(r"^\p{L}") & ((F.length(w) == 1) | F.endswith(w, F.lit("."))))
    short = F.transform(letters, _letter) if spelled else letters
    surname = F.when(last.rlike(r"^\p{L}"), last).otherwise("")
    return F.when(F.size(toks) == 0, "").when(F.lower(last).isin("al.", "et", "et."), "").otherwise(F.lower(F.trim(F.concat_ws(" ", short, surname))))


def author_key(name: Column, spelled: bool = True) -> Column:
    """Initials and surname in lower case, '' for 'et al.'; with ``spelled=False`` only names already given as
    initials count."""
    return bound(words(name), lambda toks: _key_of(toks, spelled))


def author_keys(a: Column, spelled: bool = True) -> Column:
    toks = F.transform(F.coalesce(a, F.array().cast("array<string>")), words)
    return F.filter(F.transform(toks, lambda t: _key_of(t, spelled)), lambda k: k != "")


def record_author_keys(a: Column) -> Column:
    """``author_keys`` of a record's authors, which are trimmed and have single spaces. Plain letters go through a few patterns
    over all names at once, a line each, which are compiled; other lists go name by name."""
    line = F.lower(F.array_join(a, "\n"))
    for pattern, new in (
        (r"(?md)^(?:.* )?(?:al\.|et\.?)$", ""),  # et al.
        (r"(?md)(?<![^ \n])[^a-z \n][^ \n]* ", ""),  # given names that don't start with a letter
        (r"(?md)(?<![^ \n])([a-z])[^ \n]* ", r"$1. "),
        (r"(?md)(?: |^)[^a-z \n][^ \n]*$| $", ""),  # a surname that doesn't
    ):
        line = F.regexp_replace(line, pattern, new)
    plain = F.octet_length(F.array_join(a, "")) == F.length(F.array_join(a, ""))
    return F.when(a.isNull(), F.array().cast("array<string>")).when(plain, F.array_remove(F.split(line, "\n"), "")).otherwise(author_keys(a))


def surnames(a: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(F.try_element_at(words(x), F.lit(-1))))))


def record_surnames(a: Column) -> Column:
    """``surnames`` of a record's authors, which are trimmed and have single spaces."""
    return F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(F.substring_index(x, " ", -1))))


# ---- identifiers, pages, dates


def doi_key(x: Column | str) -> Column:
    """A DOI to compare by: lower case, no scheme, host or 'doi:', no trailing punctuation; NULL if absent."""
    bare = F.regexp_replace(F.lower(text(x)), r"^(?:https?://)?(?:dx\.)?(?:doi\.org/)?(?:doi:\s*)?", "")
    return F.nullif(F.regexp_replace(bare, r"[.,;]+$", ""), F.lit(""))


def doi_link(x: Column | str) -> Column:
    d = F.regexp_replace(F.lower(text(x)), r"^(?:https://doi\.org/)?\s*", "")
    d = F.trim(F.regexp_replace(F.regexp_replace(d, r"^(?:http://doi\.org/)?\s*", ""), r"^(?:doi:)?\s*", ""))
    d = F.trim(F.regexp_replace(d, r"https?://|doi\.org/", ""))
    return F.when(d == "", "").otherwise(F.concat(F.lit("https://doi.org/"), d))


def dashed(p: Column | str) -> Column:
    return F.translate(text(p), "—–", "--")


def pages_norm(p: Column | str) -> Column:
    """(pages, is_eloc): dashes plain; text with letters and no dash is an article number."""
    s = dashed(p)
    return F.struct(s.alias("pages"), (~F.contains(s, F.lit("-")) & s.rlike("[A-Za-z]")).alias("is_eloc"))


def numbers(p: Column | str) -> Column:
    return F.regexp_extract_all(dashed(p), F.lit(r"(\d+)"), F.lit(1))


def first_number(p: Column | str) -> Column:
    return F.regexp_extract(dashed(p), r"(\d+)", 1)


def _plain(n: Column) -> Column:
    """A digit string without leading zeros, to compare as a number of any length."""
    return F.regexp_replace(n, r"^0+(?=\d)", "")


def pages_richness(p: Column | str) -> Column:
    """2 for a range with two ends, 1 for one number, else 0."""
    return richness(dashed(p), numbers(p))


def richness(plain: Column, n: Column) -> Column:
    """``pages_richness`` of pages with plain dashes and their numbers."""
    two = F.contains(plain, F.lit("-")) & (F.size(n) >= 2)
    return F.when(two & (_plain(F.get(n, F.lit(0))) != _plain(F.get(n, F.lit(1)))), 2).when(F.size(n) == 1, 1).otherwise(0)


def is_single_page(p: Column | str) -> Column:
    return text(p).rlike(r"^\d+$")


def is_page_range(p: Column | str) -> Column:
    return F.contains(dashed(p), F.lit("-")) & (F.size(numbers(p)) >= 2)


def pages_field(p: Column | str) -> Column:
    """Two numbers as a range with an en dash, one number alone, else as it is."""
    n = F.regexp_extract_all(stripped(p), F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(n) == 2, F.array_join(n, "–")).when(F.size(n) == 1, n[0]).otherwise(stripped(p))


def month_number(m: Column | str) -> Column:
    """A month's number for its English short name or number, else the value as it is."""
    s = text(m)
    short = F.lower(F.regexp_replace(s, r"^[. ]+|[. ]+$", ""))
    names = F.create_map(*[F.lit(x) for i, n in enumerate(MONTHS) for x in (n.lower(), str(i + 1))], F.lit("sept"), F.lit("9"))
    return F.coalesce(F.element_at(names, short), F.when(short.rlike(r"^(?:0?[1-9]|1[0-2])$"), _plain(short)), s)


def month_name(m: Column | str) -> Column:
    n = month_number(m)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(MONTHS) for x in (str(i + 1), n)]), n), n)


def year_of(y: Column | str) -> Column:
    """The first year from 1800 to 2099 that stands alone, or ''."""
    return F.regexp_extract(text(y), r"(?U)\b(1[89]\d{2}|20\d{2})\b", 1)


def year_window(y: Column | str) -> Column:
    """The first four digits from 1800 to 2100 anywhere, or ''."""

    def first(s: Column) -> Column:
        spots = F.when(F.length(s) >= 4, F.sequence(F.lit(1), F.greatest(F.length(s) - 3, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        windows = F.transform(spots, lambda i: F.substr(s, i, F.lit(4)))
        return F.coalesce(F.get(F.filter(windows, lambda w: F.coalesce(F.when(w.rlike(r"^\d{4}$"), w.try_cast("int")).between(1800, 2100), F.lit(False))), F.lit(0)), F.lit(""))

    return F.transform(F.array(text(y)), first)[0]


def year_prefix(y: Column | str) -> Column:
    """The number that the first four characters are, or NULL."""
    s = F.left(stripped(y), F.lit(4))
    return F.when(s.rlike(r"^\d{1,4}$"), s.cast("int"))


def is_plausible_year(y: Column | str, as_of_year: int) -> Column:
    return F.coalesce(year_prefix(y).between(1800, as_of_year + 1), F.lit(False))


# ---- free text. The patterns of ``parse_reference``.


def parse_reference(r: Column | str) -> Column:
    """Title, authors and numbers of a reference string, by patterns: a struct, absent parts NULL."""
    r = _col(r)
    title = F.coalesce(F.nullif(F.regexp_extract(r, r"“([^”]{3,})”|\"([^\"]{3,})\"", 1), F.lit("")), F.nullif(F.regexp_extract(r, r"“([^”]{3,})”|\"([^\"]{3,})\"", 2), F.lit("")))
    before = F.regexp_extract(r, r"^([\s\S]*?)(?:“[^”]{3,}”|\"[^\"]{3,}\")", 1)
    part = lambda p, i=1: F.nullif(F.regexp_extract(r, p, i), F.lit(""))
    return F.struct(
        F.nullif(stripped(title), F.lit("")).alias("title"),
        F.when(title.isNotNull(), author_list(F.regexp_replace(before, r"[,\s]+$", ""))).alias("authors"),
        part(r"(?i)(10\.\d{4,9}/[^\s,;]+)").alias("doi"),
        part(r"(?i)(?:arxiv:)?\s*(\d{4}\.\d{4,5})(?:v\d+)?").alias("arxiv_id"),
        F.translate(part(r"(?i)pp\.?\s*([\d–—\-]+)"), "—–", "--").alias("pages"),
        part(r"(?i)\bvol(?:\.\s*|\s+)([0-9A-Za-z]+)").alias("volume"),
        part(r"(?i)\bno(?:\.\s*|\s+)([0-9A-Za-z]+)").alias("issue"),
        part(r"\b((?:19|20)\d{2})\b").alias("year"),
    )


def title_variants(t: Column | str) -> Column:
    """The title, its part before a colon or dash if six characters or more, its first 180 characters if longer."""
    s = text(t)
    head = F.split(s, r"\s*[:\-–—]\s*", 2)[0]
    return F.when(s == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.array_compact(F.array(s, F.when(F.length(head) >= 6, head), F.when(F.length(s) > 180, F.left(s, F.lit(180))))))
    )


def listed(xs: Column) -> Column:
    """Distinct non-blank values, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(xs, lambda x: x.isNotNull() & (x != "")))), ", ")


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def bibtex_escape(s: Column) -> Column:
    """Special characters escaped in one pass over the text: a private mark stands for backslashes meanwhile."""
    out = F.replace(s, F.lit("\\"), F.lit("\x01"))
    for c in "{}&%$#_":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return F.replace(out, F.lit("\x01"), F.lit("\\textbackslash{}"))


def final_line(s: Column) -> Column:
    one = text(s)
    return F.when((one == "") | F.endswith(one, F.lit(".")), one).otherwise(F.concat(one, F.lit(".")))


def sanitised(s: Column) -> Column:
    """A recorded line with stray spaces and page lists put right."""
    # The patterns and their order, as results must agree.
    out = F.regexp_replace(F.regexp_replace(s, r"\s+,", ","), r"\s+\.", ".")
    out = F.regexp_replace(out, r"\bpp\.\s*(?=[,.](?:\s|$))", "")
    return text(F.regexp_replace(out, r"\bpp\.\s*(\d+)[\s,]+(\d+)", "pp. $1–$2"))


def is_reasonable(s: Column) -> Column:
    return F.coalesce((F.length(s) >= 20) & s.rlike(r"[\"*]|doi\.org/|http"), F.lit(False))


# ---- sources


def by_source(source: Column, which: int, default: str, kind: str = "string") -> Column:
    """A value of the ``SOURCES`` table for a source column."""
    table = F.create_map(*[x for s, v in SOURCES.items() for x in (F.lit(s), F.lit(str(v[which])).cast(kind))])
    return F.coalesce(F.element_at(table, F.lower(source)), F.lit(default).cast(kind))


def vote_weight(source: Column) -> Column:
    """Exact decimals, so that equal sums tie."""
    return by_source(source, 3, OTHER_VOTE, "decimal(6,2)")


def score_weight(source: Column) -> Column:
    return by_source(source, 4, "0", "double")


def is_trusted(source: Column) -> Column:
    return F.coalesce(F.lower(source).isin([s for s, v in SOURCES.items() if v[5]]), F.lit(False))


def label(source: Column) -> Column:
    names = {s: v[6] for s, v in SOURCES.items()} | LABELS
    table = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    return F.coalesce(F.element_at(table, F.lower(source)), F.nullif(source, F.lit("")), F.lit("Unknown"))

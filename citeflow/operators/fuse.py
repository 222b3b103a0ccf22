"""Fusing a reference's candidates into one record with provenance.

Candidates are rows (ref_id, cand_ord, source, fields); every tie goes to the smaller ``cand_ord``. All votes of all
fields are one unpivot, one aggregation and one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import (
    YEAR_PRIORITY, author_keys, bound, clean_authors, dashed, doi_key, first_number, given, is_page_range, is_plausible_year,
    is_single_page, is_trusted, month_number, once, pages_richness, record_author_keys, richness, text, vote_weight, year_of,
)
from ..functions.similarity import overlap, similarity, word_set
from ..schemas import FIELDS, MATCHED, RECORD, VOTED
from .match import NEAREST, compared, prepared

#: Title similarities: of one cluster, and of a matching field.
SAME_TITLE, SAME_TITLE_AS_BEST = 0.92, 0.93


def with_fields(df: DataFrame) -> DataFrame:
    """The table with every field of a record, absent ones NULL."""
    return df.selectExpr("*", *[f"cast(NULL AS {'array<string>' if f == 'authors' else 'string'}) AS {f}" for f in FIELDS if f not in df.columns])


#: ``given`` and ``clean_authors`` of a column as SQL: one call for a whole record instead of some for each field.
_TRIMMED = "nullif(trim(regexp_replace(cast({} AS string), r'(?U)\\s+', ' ')), '')"
_PEOPLE = r"filter(transform(authors, a -> trim(regexp_replace(a, r'(?U)\s+', ' '))), a -> a <> '')"


def present(entries: list[tuple[str, str]], kind: str) -> str:
    """SQL of an array of the entries (condition, value) whose condition holds. Unlike ``array_compact``, which is a lambda, it
    is compiled, with all that the values are made of."""
    return f"concat({', '.join(f'if({when}, array({value}), cast(array() AS {kind}))' for when, value in entries)})"


def record(df: DataFrame) -> Column:
    """The fields as one struct: texts trimmed, blank ones and empty author lists NULL. Later stages rely on this."""
    values = [f"get(filter(array({_PEOPLE}), p -> size(p) > 0), 0)" if f == "authors" else _TRIMMED.format(f) for f in FIELDS]
    struct = ", ".join(f"'{f}', {v}" for f, v in zip(FIELDS, values))
    return F.expr(f"element_at(array(cast(named_struct({struct}) AS {RECORD})), 1)")


def candidate(df: DataFrame, words: Column | None = None, doi: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``m`` to rows with cand_ord, source and a record ``c``: what clusters need of a candidate, computed once, under
    short names, as they name it often: its place, source, weight in hundredths, trust, title words and DOI (given ones
    are taken), and what is asked for besides."""
    parts = {
        "o": F.col("cand_ord").cast("int"),
        "s": F.col("source"),
        "w": (vote_weight(F.col("source")) * 100).cast("int"),
        "sure": is_trusted(F.col("source")),
        "words": word_set(F.col("c.title")) if words is None else words,
        "dk": doi_key("c.doi") if doi is None else doi,
        "c": F.col("c"),
        **(extra or {}),
    }
    more = {"k": F.col("cluster")} if "cluster" in df.columns else {}
    return df.withColumn("m", F.when(F.col("cand_ord").isNotNull(), F.struct(*[v.alias(k) for k, v in {**parts, **more}.items()])))


def voter(m: Column, as_of_year: int) -> list[Column]:
    """What votes need of a candidate besides, computed for members of the best cluster only: author keys, plausible year,
    the source's rank for years, pages with plain dashes, their numbers and the first one."""
    prio = F.array_position(F.array(*[F.lit(s) for s in YEAR_PRIORITY]), F.lower(m["s"]))
    pages = F.when(m["c"]["pages"].isNotNull(), dashed(m["c"]["pages"]))
    return [
        record_author_keys(m["c"]["authors"]).alias("norm"),
        bound(year_of(m["c"]["year"]), lambda y: F.when(is_plausible_year(y, as_of_year), y)).alias("yr"),
        F.when(prio > 0, prio).otherwise(99).cast("int").alias("prio"),
        bound(pages, lambda p: F.struct(p.alias("plain"), F.regexp_extract_all(p, F.lit(r"(\d+)"), F.lit(1)).alias("n"))).alias("pages"),
    ]


def gathered(cands: DataFrame, mode: str = "jaccard") -> DataFrame:
    """(ref_id, own): each reference's candidates (``candidate``) as one array in their order. One shuffle by reference;
    all that follows is narrow. Candidates of a reference are few, by the limits of the lookups."""
    rows = with_fields(cands)
    rows = clustered(rows.select("ref_id", "cand_ord", "source", "title", record(rows).alias("c")), mode)
    return candidate(rows).groupBy("ref_id").agg(F.array_sort(F.collect_list("m")).alias("own"))


def clustered(cands: DataFrame, mode: str) -> DataFrame:
    """Adds ``cluster`` where it can't be told by expressions (``numbered`` tells it else)."""
    return cands if mode == "jaccard" else cands.join(_cluster_by_pairs(cands, mode), ["ref_id", "cand_ord"], "left")


# of sets of n and m words, min(n, m) at most are shared, and max(n, m) at least are in their union
_NEAR = f"size(w) > 0 AND size(m.words) > 0 AND least(size(w), size(m.words)) >= {SAME_TITLE} * greatest(size(w), size(m.words)) AND size(array_intersect(w, m.words)) >= {SAME_TITLE} * size(array_union(w, m.words))"
_PLACE = f"array_position(transform(acc.leads, w -> {_NEAR}), true)"
_NEXT = "named_struct('leads', if(at > 0, acc.leads, concat(acc.leads, array(m.words))), 'at', concat(acc.at, array(cast(if(at > 0, at, size(acc.leads) + 1) AS int))))"
_START = "named_struct('leads', cast(array() AS array<array<string>>), 'at', cast(array() AS array<int>))"


def numbered(df: DataFrame, mode: str = "jaccard") -> DataFrame:
    """Adds ``at``: the cluster of each candidate of ``own``. Greedy leader clustering in candidate order: a candidate
    joins the first cluster whose first title is similar enough."""
    fold = f"aggregate(own, {_START}, (acc, m) -> transform(array({_PLACE}), at -> {_NEXT})[0]).at"
    return df.withColumn("at", F.expr(fold if mode == "jaccard" else "transform(own, m -> m.k)"))


def _sum(of: str) -> str:
    return f"aggregate({of}, 0, (t, h) -> t + h.w)"


def _groups(rows: str, key: str, out: str) -> str:
    """SQL of the largest struct ``out`` (of a key and its members hs) over the keys of an array; NULL keys have none."""
    keys = f"array_distinct(filter(transform({rows}, h -> {key}), k -> k IS NOT NULL))"
    return f"array_max(transform({keys}, k -> transform(array(filter({rows}, h -> {key} = k)), hs -> {out})[0]))"


_AGREE = _groups("ms", "h.dk", "named_struct('n', size(hs), 'f', -hs[0].o, 'd', k, 'sure', exists(hs, h -> h.sure))")
_SCORED = f"named_struct('score', if(a.n >= 2 OR a.sure, 10000, {_sum('ms')}), 'f', -ms[0].o, 'cluster', c, 'agreed', if(a.n >= 2 OR a.sure, a.d, NULL))"


def ranked(df: DataFrame) -> DataFrame:
    """Adds ``top`` (score in hundredths, f, cluster, agreed): the best cluster. A DOI that two members or a trusted source hold scores
    100, else the sum of vote weights; ties go to the cluster that was seen first."""
    one = f"transform(array(filter(own, (m, i) -> at[i] = c)), ms -> transform(array({_AGREE}), a -> {_SCORED})[0])[0]"
    alone = "named_struct('score', if(m.sure AND m.dk IS NOT NULL, 10000, m.w), 'f', -m.o, 'cluster', at[i], 'agreed', if(m.sure, m.dk, NULL))"  # the same for clusters of one
    return df.withColumn("top", F.expr(f"if(array_max(at) = size(own), array_max(transform(own, (m, i) -> {alone})), array_max(transform(sequence(1, array_max(at)), c -> {one})))"))


def voted(df: DataFrame, members: str, as_of_year: int = 2025) -> DataFrame:
    """Adds ``votes`` (a struct for each of VOTED: w, r, z, f, v, s), ``people`` (best.raw, best.s) and ``years`` (y, s) over an
    array of candidates, and ``voters``, these with what votes are made of. Rules of ``vote_fields``, ``vote_authors`` and
    ``best_years``. Values that differ in all entries are groups of one: then the entries themselves are compared. One
    candidate alone has its own values, without lambdas."""
    df = df.withColumn("_v", F.transform(members, lambda m: F.struct(*[m[k].alias(k) for k in ("o", "s", "w", "c")], *voter(m, as_of_year))))
    more = lambda m: F.struct(*[m[k].alias(k) for k in ("o", "s", "w", "c", "norm", "yr", "prio")], F.coalesce(richness(m["pages"]["plain"], m["pages"]["n"]), F.lit(0)).alias("rich"), F.coalesce(F.get(m["pages"]["n"], F.lit(0)), F.lit("")).alias("start"))
    df = df.withColumn("voters", F.transform("_v", more)).drop("_v")
    entry = lambda f: f"transform(filter(voters, m -> m.c.{f} IS NOT NULL), m -> named_struct('w', m.w, 'r', {'m.rich' if f == 'pages' else '0'}, 'z', {'length(m.c.pages)' if f == 'pages' else '0'}, 'f', -m.o, 'v', m.c.{f}, 's', m.s))"
    heaviest = "array_max(transform(hs, h -> named_struct('w', h.w, 'f', h.f, 's', h.s))).s"
    plurality = _groups("es", "h.v", f"named_struct('w', {_sum('hs')}, 'r', hs[0].r, 'z', hs[0].z, 'f', hs[0].f, 'v', k, 's', {heaviest})")
    plurality = f"if(size(es) = 1 OR size(array_distinct(transform(es, e -> e.v))) = size(es), array_max(es), {plurality})"
    spelled = "array_max(transform(hs, h -> named_struct('n', size(h.c.authors), 'o', -h.o, 'raw', h.c.authors, 's', h.s)))"
    people = _groups("voters", "if(size(h.norm) > 0, h.norm, NULL)", f"named_struct('w', {_sum('hs')}, 'f', -hs[0].o, 'best', {spelled})")
    years = _groups("voters", "if(h.yr IS NULL, NULL, struct(h.prio AS p, h.yr AS y))", "named_struct('p', -k.p, 'n', size(hs), 'f', -hs[0].o, 'y', k.y)")
    h = "voters[0]"
    own = lambda f: f"if({h}.c.{f} IS NOT NULL, named_struct('w', {h}.w, 'r', {f'{h}.rich' if f == 'pages' else '0'}, 'z', {f'length({h}.c.pages)' if f == 'pages' else '0'}, 'f', -{h}.o, 'v', {h}.c.{f}, 's', {h}.s), NULL)"
    own_people = f"if(size({h}.norm) > 0, named_struct('w', {h}.w, 'f', -{h}.o, 'best', named_struct('n', size({h}.c.authors), 'o', -{h}.o, 'raw', {h}.c.authors, 's', {h}.s)), NULL)"
    own_year = f"if({h}.yr IS NOT NULL, named_struct('p', -{h}.prio, 'n', 1, 'f', -{h}.o, 'y', {h}.yr), NULL)"
    either = lambda one, many: f"if(size(voters) = 1, {one}, {many})"
    votes = either(f"array({', '.join(map(own, VOTED))})", f"transform(array({', '.join(map(entry, VOTED))}), es -> {plurality})")
    return df.selectExpr("*", f"{votes} AS votes", f"{either(own_people, people)} AS people", f"{either(own_year, years)} AS years")


_RANK = f"array({', '.join(repr(s) for s in YEAR_PRIORITY)})"
#: The winner's value and source of each field after ``voted``.
WINNERS = {f: (f"votes[{i}].v", f"votes[{i}].s") for i, f in enumerate(VOTED)} | {"authors": ("people.best.raw", "people.best.s"), "year": ("years.y", f"if(years.y IS NULL, NULL, coalesce(get({_RANK}, -years.p - 1), 'consensus'))")}


def fused(df: DataFrame, as_of_year: int = 2025) -> DataFrame:
    """Adds ``fused`` (a record) and ``fused_by`` (a map of field and source) to rows with ``own``, ``at`` and ``top``: the
    votes of the best cluster; its agreed DOI; a single page widened by the longest range of the cluster that starts
    with it."""
    rows = voted(df.withColumn("ms", F.expr("filter(own, (m, i) -> at[i] = top.cluster)")), "ms", as_of_year)
    page = F.expr(WINNERS["pages"][0])
    rows = rows.withColumn("start", F.when(pages_richness(page) == 1, first_number(page)))
    rows = rows.withColumn("span", F.expr("array_max(transform(filter(voters, m -> m.rich = 2 AND m.start = start), m -> named_struct('z', length(m.c.pages), 'o', -m.o, 'r', m.c.pages, 's', m.s)))"))
    value = {f: v for f, (v, _) in WINNERS.items()} | {"doi": f"coalesce(top.agreed, {WINNERS['doi'][0]})", "pages": f"coalesce(span.r, {WINNERS['pages'][0]})"}
    by = {f: s for f, (_, s) in WINNERS.items()} | {"doi": f"if(top.agreed IS NOT NULL, 'doi-agreement', {WINNERS['doi'][1]})", "pages": f"coalesce(span.s, {WINNERS['pages'][1]})"}
    entries = present([(f"{value[f]} IS NOT NULL", f"struct('{f}' AS k, {by[f]} AS v)") for f in FIELDS], "array<struct<k:string,v:string>>")
    struct = f"cast(named_struct({', '.join(f"'{f}', {value[f]}" for f in FIELDS)}) AS {RECORD})"
    keep = [c for c in df.columns if c not in ("at",)]
    return rows.selectExpr(*keep, f"if(top IS NULL, NULL, element_at(array({struct}), 1)) AS fused", f"map_from_entries({entries}) AS fused_by")


def cluster_titles(cands: DataFrame, mode: str = "jaccard") -> DataFrame:
    """(ref_id, cand_ord, cluster) of ``numbered``, for rows with a title; a source isn't needed."""
    cands = cands if "source" in cands.columns else cands.withColumn("source", F.lit(None).cast("string"))
    rows = numbered(gathered(cands.select("ref_id", "cand_ord", "source", "title"), mode), mode)
    return rows.select("ref_id", F.explode(F.arrays_zip(F.expr("transform(own, m -> m.o) AS cand_ord"), F.col("at"))).alias("z")).select("ref_id", F.col("z.cand_ord"), F.col("z.at").alias("cluster"))


def _cluster_by_pairs(cands: DataFrame, mode: str) -> DataFrame:
    """The same fold over a matrix of similar pairs, for similarities that run outside expressions."""
    a = cands.select("ref_id", F.col("cand_ord").alias("i"), F.col("title").alias("x"))
    b = cands.select("ref_id", F.col("cand_ord").alias("j"), F.col("title").alias("y"))
    pairs = a.join(b, "ref_id").where("i > j").withColumn("near", similarity(F.col("x"), F.col("y"), mode, SAME_TITLE) >= SAME_TITLE)
    near = pairs.where("near").groupBy("ref_id", F.col("i").alias("cand_ord")).agg(F.collect_set("j").alias("like"))
    own = cands.select("ref_id", "cand_ord").join(near, ["ref_id", "cand_ord"], "left")
    own = own.groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("cand_ord", F.coalesce("like", F.array().cast("array<int>")).alias("like")))).alias("own"))
    start = F.struct(F.array().cast("array<int>").alias("leads"), F.array().cast("array<struct<cand_ord:int,cluster:int>>").alias("out"))

    def place(acc: Column, c: Column) -> Column:
        at = F.array_position(F.transform(acc["leads"], lambda x: F.array_contains(c["like"], x)), True)
        cluster = F.when(at > 0, at).otherwise(F.size(acc["leads"]) + 1).cast("int")
        new = F.array(c["cand_ord"].cast("int"))
        return F.struct(
            F.when(at > 0, acc["leads"]).otherwise(F.concat(acc["leads"], new)).alias("leads"),
            F.concat(acc["out"], F.array(F.struct(c["cand_ord"].cast("int").alias("cand_ord"), cluster.alias("cluster")))).alias("out"),
        )

    return own.select("ref_id", F.explode(F.aggregate("own", start, place)["out"]).alias("o")).select("ref_id", "o.*")


def _top(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def top_clusters(cands: DataFrame, mode: str = "jaccard") -> DataFrame:
    """(ref_id, cluster, score, agreed): each reference's best cluster, by ``ranked``."""
    rows = ranked(numbered(gathered(cands.select("ref_id", "cand_ord", "source", "title", "doi"), mode), mode))
    return rows.selectExpr("ref_id", "top.cluster", "cast(cast(top.score AS decimal(12,2)) / 100 AS decimal(12,2)) AS score", "top.agreed")


def vote_fields(cands: DataFrame, keys: list[str], fields: list[str] = VOTED) -> DataFrame:
    """(keys, field, value, weight, source): weighted plurality of each field's non-blank values. Ties of pages go to
    the richer, then the longer, then all ties to the value seen first. ``source`` is the heaviest that gave it."""
    pairs = ", ".join(f"named_struct('field', '{f}', 'value', {_TRIMMED.format(f)})" for f in fields)
    own = cands.select(*keys, "cand_ord", "source", vote_weight(F.col("source")).alias("w"), F.expr(f"explode(array({pairs}))").alias("p"))
    own = own.select(*keys, "cand_ord", "source", "w", "p.field", "p.value").where("value is not null")
    sums = own.groupBy(*keys, "field", "value").agg(
        F.sum("w").alias("weight"), F.min("cand_ord").alias("first"), F.max_by("source", F.struct(F.col("w"), -F.col("cand_ord"))).alias("source")
    )
    rich = F.when(F.col("field") == "pages", pages_richness("value")).otherwise(0)
    size = F.when(F.col("field") == "pages", F.length("value")).otherwise(0)
    return _top(sums, [*keys, "field"], F.desc("weight"), rich.desc(), size.desc(), F.asc("first")).select(*keys, "field", "value", "weight", "source")


def pivoted(fields: list[str]) -> list[Column]:
    """Aggregates that turn votes (field, value) back into columns."""
    return [F.expr(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}") for f in fields]


def vote_authors(cands: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, authors, weight, source): plurality of author lists by initials and surnames; of the winner's spellings
    the longest list, the first on equal length."""
    own = cands.select(*keys, "cand_ord", "source", clean_authors(F.col("authors")).alias("raw"), author_keys(F.col("authors")).alias("norm"), vote_weight(F.col("source")).alias("w"))
    sums = own.where(F.size("norm") > 0).groupBy(*keys, "norm").agg(
        F.sum("w").alias("weight"), F.min("cand_ord").alias("first"), F.max_by(F.struct("raw", "source"), F.struct(F.size("raw"), -F.col("cand_ord"))).alias("best")
    )
    return _top(sums, keys, F.desc("weight"), F.asc("first")).select(*keys, F.col("best.raw").alias("authors"), "weight", F.col("best.source").alias("source"))


def best_years(cands: DataFrame, keys: list[str], as_of_year: int) -> DataFrame:
    """(keys, year, source): the most frequent plausible year of the source that ranks first; where no ranked source
    has any, the most frequent of all, as 'consensus'."""
    place = F.array_position(F.array(*[F.lit(s) for s in YEAR_PRIORITY]), F.lower("source"))
    own = cands.select(*keys, "cand_ord", year_of("year").alias("year"), F.when(place > 0, place).otherwise(99).alias("prio"))
    counts = own.where(is_plausible_year("year", as_of_year)).groupBy(*keys, "prio", "year").agg(F.count("*").alias("n"), F.min("cand_ord").alias("first"))
    best = _top(counts, keys, F.asc("prio"), F.desc("n"), F.asc("first"))
    return best.select(*keys, "year", F.coalesce(F.get(F.array(*[F.lit(s) for s in YEAR_PRIORITY]), F.col("prio").cast("int") - 1), F.lit("consensus")).alias("source"))


def longest_ranges(cands: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, range, source): per first page, the longest page range, the first on equal length."""
    own = cands.where(pages_richness("pages") == 2).select(*keys, "cand_ord", "source", text("pages").alias("range"), first_number("pages").alias("start"))
    best = F.max_by(F.struct("range", "source"), F.struct(F.length("range"), -F.col("cand_ord"))).alias("b")
    return own.groupBy(*keys, "start").agg(best).select(*keys, "start", "b.range", F.col("b.source").alias("range_source"))


def consensus(cands: DataFrame, as_of_year: int = 2025, mode: str = "jaccard") -> DataFrame:
    """(ref_id, record fields, provenance map): the fused record of each reference's best cluster."""
    rows = fused(ranked(numbered(gathered(cands, mode), mode)), as_of_year)
    return rows.select("ref_id", "fused.*", F.col("fused_by").alias("provenance"))


def with_matching(df: DataFrame, mode: str = "jaccard", known: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``matching``: the fields in which ``ex`` and ``best`` both have a value and agree; none without a best. What they are
    compared by stays in columns that ``verify`` takes (``COMPARED``); of these, ``known`` ones are given."""
    ex, best = F.col("ex"), F.col("best")
    keys = {}
    for side, r in (("ex", ex), ("best", best)):
        keys |= {f"{side}_author_keys": record_author_keys(r["authors"]), f"{side}_title_words": word_set(r["title"]), f"{side}_doi_key": doi_key(r["doi"])}
    rows = df.select("*", *[v.alias(k) for k, v in {**keys, **(known or {})}.items()])
    near = overlap(F.col("ex_title_words"), F.col("best_title_words")) if mode == "jaccard" else similarity(ex["title"], best["title"], mode, SAME_TITLE_AS_BEST)
    same = {f: f"ex.{f} = best.{f}" for f in MATCHED} | {
        "authors": "size(ex_author_keys) > 0 AND ex_author_keys = best_author_keys",
        "title": f"_near >= {SAME_TITLE_AS_BEST}",
        "doi": "ex_doi_key = best_doi_key",
    }
    return rows.withColumn("_near", near).selectExpr(*df.columns, *keys, f"{present([(same[f], repr(f)) for f in MATCHED], 'array<string>')} AS matching")


#: What ``with_matching`` leaves for ``verify``.
COMPARED = [f"{side}_{k}" for side in ("ex", "best") for k in ("author_keys", "title_words", "doi_key")]


def select_best(refs: DataFrame, cands: DataFrame, as_of_year: int = 2025, mode: str = "jaccard") -> DataFrame:
    """(ref_id, ex, best, matching, provenance, trusted): the consensus where its DOI is the reference's own; else the
    best-scored candidate, or the one with the nearest title (0.95), if trustworthy; else no best record.

    Besides, ``spans`` (start, z, o, range, range_source: the candidates' page ranges that hold the page of the reference or of
    the best record, with their first pages and lengths, so that the largest of a start is the longest, the first on equal
    length), ``sources`` of the candidates, and ``COMPARED``."""
    refs, cands = with_fields(refs), with_fields(cands)
    ex = prepared(refs.select("ref_id", record(refs).alias("ex")), "ex", "a", mode)
    found = clustered(cands.select("ref_id", "cand_ord", "source", "title", record(cands).alias("c")), mode).drop("title")
    rows = compared(ex.join(prepared(found, "c", "b", mode), "ref_id", "left"), mode, ("a_doi", "a_title", "b_doi", "b_title"))
    rows = candidate(rows, F.col("b_title"), F.col("b_doi"), {"score": F.col("score"), "near": F.col("near"), "fit": F.col("sure")})
    # the best of each kind by its place; the record itself is taken from the array, if it is wanted
    place = lambda by: F.max(F.when(F.col("cand_ord").isNotNull(), F.struct(F.col(by).alias("by"), (-F.col("cand_ord").cast("int")).alias("f"), F.col("sure").alias("fit"))))
    out = rows.groupBy("ref_id").agg(F.first(F.struct("ex", "a_doi", "a_title")).alias("a"), F.array_sort(F.collect_list("m")).alias("all"), place("score").alias("scored"), place("near").alias("titled"))
    # votes count only where the fused DOI, which some candidate holds, is the reference's own
    out = out.withColumn("own", F.expr("if(exists(all, m -> contains(m.dk, a.a_doi)), all, slice(all, 1, 0))"))
    out = fused(ranked(numbered(out, mode)), as_of_year)
    by_doi = F.coalesce(doi_key(F.col("fused")["doi"]) == F.col("a.a_doi"), F.lit(False))
    at = F.when(F.col("scored.fit"), -F.col("scored.f")).when((F.col("titled.by") >= NEAREST) & F.col("titled.fit"), -F.col("titled.f"))
    holds = lambda m: F.contains(m["c"]["pages"], F.col("ex.pages")) | F.contains(m["c"]["pages"], F.when(F.col("by_doi"), F.col("fused.pages")).otherwise(F.col("one.c.pages")))
    ranges = F.transform(F.filter("all", lambda m: holds(m) & (pages_richness(m["c"]["pages"]) == 2)), lambda m: F.struct(first_number(m["c"]["pages"]).alias("start"), F.length(m["c"]["pages"]).alias("z"), (-m["o"]).alias("o"), m["c"]["pages"].alias("range"), m["s"].alias("range_source")))
    out = out.select("ref_id", "a.*", "all", "fused", "fused_by", F.expr("array_distinct(filter(transform(all, m -> m.s), s -> s IS NOT NULL))").alias("sources"), by_doi.alias("by_doi"), F.when(~by_doi, at).alias("at"))
    out = out.withColumn("one", F.expr("if(at IS NULL, NULL, filter(all, m -> m.o = at)[0])"))
    out = out.withColumn("spans", ranges).drop("all", "at")
    year = year_of("one.c.year")
    out = out.select("*", F.when(is_plausible_year(year, as_of_year), year).alias("one_year"), (F.size(record_author_keys(F.col("one.c.authors"))) > 0).alias("named"))
    special = {"authors": "if(named, one.c.authors, NULL)", "doi": "one.dk", "year": "one_year"}
    single = ", ".join(f"'{f}', {special.get(f, f'one.c.{f}')}" for f in FIELDS)
    best = f"CASE WHEN by_doi THEN fused WHEN one.c IS NOT NULL THEN cast(named_struct({single}) AS {RECORD}) END"
    more = ["spans", "sources"]
    out = out.selectExpr("ref_id", "ex", f"element_at(array({best}), 1) AS best", "by_doi", "fused_by", "one.s AS source", "a_doi", "a_title", *more)
    source = {f: "'doi-agreement'" if f == "doi" else "source" for f in FIELDS}
    entries = present([(f"best.{f} IS NOT NULL", f"struct('{f}' AS k, {source[f]} AS v)") for f in FIELDS], "array<struct<k:string,v:string>>")
    told = F.expr(f"CASE WHEN by_doi THEN fused_by WHEN best IS NOT NULL THEN map_from_entries({entries}) END")
    known = {"ex_doi_key": F.col("a_doi"), "ex_title_words": F.col("a_title")}
    out = with_matching(out.select("ref_id", "ex", "best", told.alias("provenance"), "a_doi", "a_title", *more), mode, known)
    return out.select("ref_id", "ex", "best", "matching", "provenance", F.col("best").isNotNull().alias("trusted"), *COMPARED, *more)


# Type names that sources use.
TYPES = {
    "journal-article": "journal article",
    "paper-conference": "conference paper",
    "proceedings-article": "conference paper",
    "book-chapter": "book chapter",
    "book": "book",
    "dataset": "dataset",
    "standard": "standard",
    "report": "technical report",
    "thesis": "thesis",
}


def reconcile_types(refs: DataFrame, cands: DataFrame) -> DataFrame:
    """(ref_id, type): plurality of the sources' types and of a ``type_vote`` column of ``refs`` if it has one, which
    counts as seen first; ties to the type seen first, 'other' without votes."""
    known = F.create_map(*[F.lit(x) for p in TYPES.items() for x in p])
    cr = given("cr_type")
    s2 = F.transform(F.coalesce("s2_types", F.array().cast("array<string>")), F.lower)
    like = lambda word, kind: F.when(F.exists(s2, lambda t: F.contains(t, F.lit(word))), kind)
    votes = (
        F.when(F.col("source") == "crossref", F.array(F.coalesce(F.element_at(known, cr), cr)))
        .when(F.col("source") == "openalex", F.array(F.when(F.col("oa_is_proceedings"), "conference paper")))
        .when(F.col("source") == "semanticscholar", F.array(like("conference", "conference paper"), like("journal", "journal article"), like("book", "book")))
        .when(F.col("source") == "arxiv", F.array(F.lit("preprint")))
    )
    own = cands.select("ref_id", "cand_ord", F.posexplode(F.array_compact(votes)).alias("at", "type"))
    if "type_vote" in refs.columns:
        own = own.unionByName(refs.select("ref_id", F.lit(0).alias("cand_ord"), F.lit(0).alias("at"), F.lower(given("type_vote")).alias("type")).where("type is not null"))
    counts = own.groupBy("ref_id", "type").agg(F.count("*").alias("n"), F.min(F.struct("cand_ord", "at")).alias("first"))
    best = _top(counts, ["ref_id"], F.desc("n"), F.asc("first"))
    return refs.select("ref_id").join(best.select("ref_id", "type"), "ref_id", "left").select("ref_id", F.coalesce("type", F.lit("other")).alias("type"))


def enrich(ex: Column, best: Column) -> Column:
    """Blank fields filled from the best record, a single page widened to a range that starts with it, the month as a
    number."""

    def value(f: str) -> Column:
        if f == "authors":
            return F.coalesce(ex[f], best[f])
        v = F.coalesce(ex[f], best[f])
        if f == "pages":
            return F.when(widens(v, best[f]), best[f]).otherwise(v)
        return F.when(v.isNotNull(), month_number(v)) if f == "month" else v

    return once(F.struct(*[value(f).alias(f) for f in FIELDS]).cast(RECORD))


def widens(page: Column, other: Column) -> Column:
    """Whether ``other`` is a range that starts at the single page ``page``."""
    return F.coalesce(is_single_page(page) & is_page_range(other) & (first_number(page) == first_number(other)), F.lit(False))

"""Registered queries over the driver's tables, by operator group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.similarity import sorted_words
from ..operators import fuse, lookup, match, render, repair, screen, segment, sinks, verify
from ..schemas import CHANGE, FIELDS
from ..sources import catalogs, files
from ..sources.surrogates import bundles, candidates, reference_strings, references, table
from ..streaming import online

AS_OF = 2025


def _text(a: "F.Column") -> "F.Column":
    return F.array_join(a, "|")


def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: weighted votes on every field and the best year of each order's candidates, as a journal reference."""
    rows = fuse.voted(fuse.gathered(candidates(spark, sf_dir)), "own", AS_OF)
    names = [*fuse.VOTED, "authors", "year"]
    rows = rows.selectExpr("ref_id", *[f"{fuse.WINNERS[f][0]} AS {f}" for f in names], f"{fuse.WINNERS['year'][1]} AS year_source")
    line = render.format_reference(F.col("r"), F.lit("journal article"))
    rows = rows.withColumn("r", fuse.record(fuse.with_fields(rows)))
    return rows.select("ref_id", "title", "journal_name", "journal_abbrev", "volume", "issue", "pages", "month", "doi", "year", "year_source", line.alias("formatted"))


def field_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field's winner with weight and source (weights, ties, page richness)."""
    cands = fuse.with_fields(candidates(spark, sf_dir))
    return fuse.vote_fields(cands, ["ref_id"]).select("ref_id", "field", "value", F.col("weight").cast("double").alias("weight"), "source")


def author_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fuse.vote_authors(candidates(spark, sf_dir), ["ref_id"])
    return got.select("ref_id", _text(F.col("authors")).alias("authors"), F.col("weight").cast("double").alias("weight"), "source")


def year_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.best_years(candidates(spark, sf_dir), ["ref_id"], AS_OF)


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.longest_ranges(candidates(spark, sf_dir), ["ref_id"])


def title_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.cluster_titles(candidates(spark, sf_dir))


def cluster_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = fuse.top_clusters(candidates(spark, sf_dir))
    return tops.select("ref_id", "cluster", F.col("score").cast("double").alias("score"), F.col("agreed").alias("doi"))


def consensus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fuse.consensus(candidates(spark, sf_dir), AS_OF)
    by = F.col("provenance")
    return got.select(
        "ref_id", "title", _text(F.col("authors")).alias("authors"), "journal_name", "journal_abbrev", "volume", "issue", "pages", "year", "month", "doi",
        *[by[f].alias(f"{f}_by") for f in ("title", "authors", "pages", "year", "doi")],
    )


def _pairs(spark: SparkSession, sf_dir: str, mode: str = "jaccard") -> DataFrame:
    """Prepared references against each of their candidates."""
    refs, cands = fuse.with_fields(references(spark, sf_dir)), fuse.with_fields(candidates(spark, sf_dir))
    left = match.prepared(refs.select("ref_id", fuse.record(refs).alias("r")), "r", "a", mode).drop("r")
    right = match.prepared(cands.select("ref_id", "cand_ord", "source", fuse.record(cands).alias("r")), "r", "b", mode).drop("r")
    return right.join(left, "ref_id")


def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = match.compared(_pairs(spark, sf_dir))
    return rows.select("ref_id", "cand_ord", F.round("near", 6).alias("title_sim"), F.round("place", 6).alias("venue_sim"), "score", F.col("sure").alias("trusted"))


def title_token_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda df, side: df.withColumn(f"{side}_title_line", sorted_words(S.given("title")))
    left, right = line(references(spark, sf_dir), "a").select("ref_id", "a_title_line"), line(candidates(spark, sf_dir), "b")
    rows = right.select("ref_id", "cand_ord", "b_title_line").join(left, "ref_id")
    return rows.select("ref_id", "cand_ord", F.round(match.near("title", "token_sort"), 6).alias("similarity"))


def selected_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fuse.select_best(references(spark, sf_dir), candidates(spark, sf_dir), AS_OF)
    b = F.col("best")
    return got.select("ref_id", "trusted", b["title"].alias("title"), b["year"].alias("year"), b["doi"].alias("doi"), b["pages"].alias("pages"), b["volume"].alias("volume"), _text(b["authors"]).alias("authors"), _text(F.col("matching")).alias("matching"))


def reconciled_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir).withColumn("type_vote", F.when(F.col("ref_id") % 10 == 0, F.lit("Book")))
    return fuse.reconcile_types(refs, candidates(spark, sf_dir))


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with their best records, as ``select_best`` gives them."""
    return fuse.select_best(references(spark, sf_dir), candidates(spark, sf_dir), AS_OF)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chosen(spark, sf_dir).select("ref_id", fuse.enrich(F.col("ex"), F.col("best")).alias("r"))
    return rows.select("ref_id", *[F.col("r")[f].alias(f) for f in ("title", "journal_name", "journal_abbrev", "volume", "issue", "pages", "year", "month", "doi")], _text(F.col("r")["authors"]).alias("authors"))


def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = verify.verify(_chosen(spark, sf_dir), AS_OF)
    s = F.col("suggestions")
    warned = _text(verify.warnings(F.col("ex"), F.lit("journal article")))
    return got.select("ref_id", _text(F.col("matching")).alias("matching"), *[F.col(f"verification.{f}").alias(f"ok_{f}") for f in verify.CHECKS], "ver_score", *[s[f].alias(f"new_{f}") for f in ("title", "authors", "journal_name", "year", "month", "volume", "pages", "doi")], warned.alias("warnings"))


def loop_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress marks and the exit rule, over states that the order keys give."""
    got = verify.verify(_chosen(spark, sf_dir), AS_OF)
    k = F.col("ref_id")
    got = got.withColumn("last_score", (k % 12 - 1).cast("int")).withColumn("stagnation", (k % 2).cast("int")).withColumn("hops", (k % 13).cast("int")).withColumn("attempts", (k % 4).cast("int")).withColumn("changed", k % 3 == 0)
    got = verify.guards(got.withColumn("fp_history", F.array().cast("array<string>")))
    return got.select("ref_id", "ver_score", "stagnation", "looped", "hops", F.size("fp_history").alias("seen"), verify.should_exit().alias("done"))


def input_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("  \n")).otherwise(F.col("text")).alias("reference"), F.when(F.col("doc_id") % 5 == 0, F.col("lang") == "en").alias("verdict"))
    ok = verify.is_reference(F.col("reference"), F.col("verdict"))
    return rows.select("doc_id", ok.alias("is_reference"), verify.skip_message(ok, F.col("reference")).alias("message"))


def journal_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    journals = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(S.comparable(F.concat_ws(" ", "r_name", "n_name")).alias("name_norm"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.left("r_name", F.lit(3)), F.lit(". N. "), F.col("n_nationkey").cast("string"))).alias("iso_abbrev"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    rows = customer.select(k.alias("ref_id"), F.when(k % 6 == 0, F.lit(" ")).when(k % 6 == 1, F.lit("Unknown Journal")).otherwise(F.concat_ws(" ", "r_name", "n_name")).alias("journal_name"), F.when(k % 2 == 0, F.lit("Abbr.")).alias("journal_abbrev"))
    return verify.check_abbreviation(rows, journals)


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verify.verify(_chosen(spark, sf_dir), AS_OF).withColumn("attempts", F.lit(0)).withColumn("changed", F.lit(False)).withColumn("changes", F.array().cast(CHANGE))
    return repair.apply_corrections(rows)


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _corrected(spark, sf_dir)
    return got.select("ref_id", *[F.col("ex")[f].alias(f) for f in ("title", "journal_name", "volume", "issue", "pages", "year", "month", "doi")], _text(F.col("ex")["authors"]).alias("authors"), "changed", "attempts")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an inner explode gets a filter on the size of the log, which is pushed below all that the log is made of and computed twice
    return _corrected(spark, sf_dir).select("ref_id", F.posexplode_outer("changes").alias("n", "c")).where("n is not null").select("ref_id", "n", "c.*")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _corrected(spark, sf_dir)
    k = F.col("ref_id")
    own = references(spark, sf_dir).select("ref_id", F.lit(1).alias("round"), F.concat(F.lit("Patched "), k.cast("string")).alias("title"), F.lit("Dec.").alias("month"), F.when(k % 2 == 0, F.lit("Berlin")).alias("location"), F.when(k % 3 == 0, F.lit("1999-01")).alias("year"))
    own = fuse.with_fields(own)
    done = repair.apply_patches(got, own.select("ref_id", "round", fuse.record(own).alias("patch")))
    return done.select("ref_id", *[F.col("ex")[f].alias(f) for f in ("title", "year", "month", "location", "pages", "doi")], "changed")


def repair_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded loop; the lookup returns each order's candidates again in every round."""
    cands = candidates(spark, sf_dir)
    done, _ = repair.repair(references(spark, sf_dir), lambda refs: cands.join(refs.select("ref_id"), "ref_id", "left_semi"), AS_OF, with_candidates=False)
    return done.select("ref_id", "attempts", "ver_score", F.col("best").isNotNull().alias("trusted"), F.size("changes").alias("n_changes"), F.col("ex")["title"].alias("title"), F.col("ex")["pages"].alias("pages"), F.col("ex")["doi"].alias("doi"))


def formatted_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["journal article", "conference paper", "preprint", "book", "book chapter", "dataset"]
    refs = _styled(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("ref_id") % 6 + 1).cast("int"))
    rows = refs.select("ref_id", kind.alias("type"), fuse.record(refs).alias("r"))
    return rows.select("ref_id", "type", render.format_reference(F.col("r"), F.col("type")).alias("formatted"))


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ref_id")
    rows = references(spark, sf_dir).withColumn("conference_name", F.when(k % 4 == 1, F.lit("Proc. of Things"))).withColumn("publisher", F.when(k % 3 != 0, F.lit("Press & Co"))).withColumn("location", F.when(k % 5 != 0, F.lit("Berlin")))
    rows = rows.withColumn("edition", F.when(k % 7 == 0, F.lit("2nd"))).withColumn("isbn", F.when(k % 2 == 0, F.lit("978-3"))).withColumn("url", F.when(k % 2 == 1, F.lit("https://x.org/a_b")))
    return fuse.with_fields(rows.withColumn("pages", F.when(k % 11 == 0, F.lit("e1234")).otherwise(F.col("pages"))))


_KIND = ["journal article", "conference paper", "book", "book chapter", "thesis", "technical report", "dataset"]


def csl_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _styled(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(x) for x in _KIND]), (F.col("ref_id") % 7 + 1).cast("int"))
    rows = refs.select("ref_id", fuse.record(refs).alias("r"), kind.alias("kind")).select("ref_id", render.csl_json(F.col("r"), F.col("kind")).alias("js"))
    read = "type string, title string, author array<struct<family: string, given: string>>, `container-title` string, page string, URL string, DOI string, issued struct<`date-parts`: string>"
    rows = rows.select("ref_id", F.from_json("js", read).alias("o"))  # one reading for all members
    first = F.get("o.author", F.lit(0))
    return rows.select("ref_id", "o.type", "o.title", first["family"].alias("family"), first["given"].alias("given"), F.col("o.container-title").alias("container"), "o.page", F.col("o.URL").alias("url"), F.col("o.DOI").alias("doi"), F.col("o.issued.date-parts").alias("issued"))


def bibtex_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _styled(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(x) for x in _KIND]), (F.col("ref_id") % 7 + 1).cast("int"))
    rows = refs.select("ref_id", fuse.record(refs).alias("r"), kind.alias("kind"))
    return rows.select("ref_id", render.bibtex(F.col("r"), F.col("kind")).alias("bibtex"))


def recorded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _styled(spark, sf_dir)
    k = F.col("ref_id")
    line = F.when(k % 3 == 0, F.concat(F.lit('A. B,  "'), "title", F.lit('" , pp. 12, 19 , pp. .'))).when(k % 3 == 1, F.lit("too short"))
    rows = refs.select("ref_id", fuse.record(refs).alias("r"), line.alias("line"))
    rows = rows.select("ref_id", "r", "line", render.format_reference(F.col("r"), F.lit("journal article")).alias("ruled"))
    out, source = render.with_recorded_line(F.col("line"), F.col("ruled"))
    return rows.select("ref_id", out.alias("formatted"), source.alias("format_source"), render.prompt_payload(F.col("r"), F.lit("journal article")).alias("payload"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verify.verify(_corrected(spark, sf_dir), AS_OF)
    ex, best, p = F.col("ex"), F.col("best"), F.col("provenance")
    return rows.select(
        "ref_id",
        render.overview(F.lit("journal article"), ex, best, p, F.col("sources")).alias("overview"),
        render.verification_lines(F.col("matching"), F.col("verification")).alias("fields"),
        render.correction_lines(F.col("changes"), p).alias("corrections"),
        render.provenance_lines(ex, best, p, F.col("changes")).alias("provenance"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ref_id").cast("string")
    links = render.raw_links(F.col("source"), F.col("doi"), {"url": F.concat(F.lit("https://pub.org/"), k), "html_url": F.concat(F.lit("https://lib.org/"), k), "id": F.concat(F.lit("https://oa.org/W"), k), "paperId": k, "uid": F.col("volume")})
    cands = candidates(spark, sf_dir).withColumn("links", links)
    return render.evidence_links(cands, references(spark, sf_dir))


def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    t = F.col("text")
    return rows.select("conv_id", "turn", S.text(t).alias("clean"), S.comparable(t).alias("comparable"), S.stripped(F.concat(F.lit(" \t"), t, F.lit("\n"))).alias("safe"), segment.line_count(t).alias("lines"), _text(S.author_list_raw(t)).alias("parts"))


def scalar_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("authors")
    return references(spark, sf_dir).select("ref_id", S.format_authors(a).alias("ieee"), _text(S.author_keys(a)).alias("keys"), _text(S.author_keys(a, False)).alias("short_keys"), _text(F.array_sort(S.surnames(a))).alias("surnames"))


def scalar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).withColumn("pages", F.when(F.col("ref_id") % 17 == 0, F.concat(F.lit("e"), "pages")).otherwise(F.col("pages")))
    p = "pages"
    return rows.select("ref_id", "cand_ord", S.pages_norm(p)["pages"].alias("pages"), S.pages_norm(p)["is_eloc"].alias("is_eloc"), S.pages_richness(p).alias("richness"), S.is_single_page(p).alias("single"), S.is_page_range(p).alias("is_range"), S.first_number(p).alias("first"), S.pages_field(p).alias("shown"))


def scalar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = references(spark, sf_dir)
    y = F.when(F.col("ref_id") % 5 == 0, F.concat(F.lit("Nov. "), "year")).when(F.col("ref_id") % 5 == 1, F.concat(F.lit("x12"), "year", F.lit("b"))).when(F.col("ref_id") % 5 == 2, F.lit("0021")).otherwise(F.col("year"))
    return rows.select("ref_id", S.month_number("month").alias("month"), S.month_name("month").alias("month_name"), S.year_of(y).alias("year"), S.year_window(y).alias("window"), S.is_plausible_year(y, AS_OF).alias("plausible"))


def scalar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = references(spark, sf_dir)
    title = F.concat_ws(": ", "title", F.when(F.col("ref_id") % 2 == 0, F.repeat(F.lit("word & more_ "), 20)))
    return rows.select("ref_id", S.doi_key("doi").alias("doi_key"), S.doi_link("doi").alias("link"), _text(S.title_variants(title)).alias("variants"), S.bibtex_escape(F.concat(F.lit("\\"), title)).alias("escaped"))


def source_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    rows = candidates(spark, sf_dir).groupBy("ref_id").agg(F.sum(S.vote_weight(s)).cast("double").alias("votes"), F.round(F.sum(S.score_weight(s)), 6).alias("score"), F.bool_or(S.is_trusted(s)).alias("trusted"), S.listed(F.collect_list(S.label(s))).alias("labels"))
    return rows


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque state fingerprints: equal states, equal values."""
    r = references(spark, sf_dir)
    return r.select("ref_id", S.fingerprint(F.col("doi"), F.col("title"), F.col("year")).alias("fp"))


def parsed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.parse_reference("reference")
    rows = reference_strings(spark, sf_dir).select("ref_id", p.alias("p"))
    return rows.select("ref_id", "p.title", _text(F.col("p.authors")).alias("authors"), "p.doi", "p.arxiv_id", "p.pages", "p.volume", "p.issue", "p.year")


def marked_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.split_marked(bundles(spark, sf_dir))


def paragraph_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bundles(spark, sf_dir).select("doc_id", segment.has_marker(segment.lines(F.col("text"))).alias("marked"), F.posexplode(segment.paragraphs(F.col("text"))).alias("pos", "reference"))
    return rows.select("doc_id", "pos", "reference", "marked", segment.looks_new(F.col("reference")).alias("looks_new"))


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.split_references(bundles(spark, sf_dir))


def extracted_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.extract_references(bundles(spark, sf_dir))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).withColumn("cand_key", F.concat_ws("-", F.col("ref_id").cast("string"), F.col("cand_ord").cast("string")))
    rows = rows.withColumn("arxiv_id", F.when(F.col("source") == "arxiv", F.concat(F.lit("2101."), F.lpad((F.col("ref_id") % 100_000).cast("string"), 5, "0"))))
    return rows.withColumn("doi_key", S.doi_key("doi")).drop("ref_id", "cand_ord")


def doi_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.by_doi(references(spark, sf_dir), _catalog(spark, sf_dir)).select("ref_id", "source", "cand_key", "title")


def arxiv_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = parsed_references(spark, sf_dir)
    return lookup.by_arxiv_id(refs, _catalog(spark, sf_dir)).select("ref_id", "source", "cand_key", "title")


def _first_line(text: str = "text") -> "F.Column":
    return F.trim(F.split(text, "\n")[0])


def _first_lines_found(spark: SparkSession, sf_dir: str, *how, **more) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    works = docs.select(F.col("doc_id").cast("string").alias("cand_key"), F.lit("crossref").alias("source"), _first_line().alias("title"), F.lit(None).cast("string").alias("doi_key"))
    got = lookup.by_title(docs.select(F.col("doc_id").alias("ref_id"), _first_line().alias("title")), works, *how, **more)
    return got.select("ref_id", "variant", "source", "cand_key", "sim", "rank")


def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's first line against all documents' first lines as titles, each variant's best five."""
    return _first_lines_found(spark, sf_dir)


def title_lookup_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in token-sort mode, by the edits between the sorted words: all pairs of 0.9 or more."""
    return _first_lines_found(spark, sf_dir, 0.9, mode="token_sort")


def gathered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOI and arXiv finds in order, then one per source and DOI or title."""
    refs, strings, catalog = references(spark, sf_dir), parsed_references(spark, sf_dir), _catalog(spark, sf_dir)
    all_ = lookup.gather(lookup.by_arxiv_id(strings, catalog), lookup.by_doi(refs, catalog))
    return lookup.dedup(all_.withColumn("key", F.col("cand_key")).select("ref_id", "cand_ord", "source", "doi", "title", "key"))


def recorded_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded outputs joined by stage and round, read leniently and coerced to known fields."""
    ev = table(spark, sf_dir, "events")
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, F.col("props")).when(k % 4 == 1, F.concat(F.lit("Sure: "), "props", F.lit(" and {x} {"))).when(k % 4 == 2, F.lit('note {"k": "a}b", "z": 1')).otherwise(F.lit(""))
    outputs = ev.select(k.alias("ref_id"), F.lit("parse").alias("stage"), (F.floor(k / 4) % 2).cast("int").alias("round"), raw.alias("raw"))
    rows = lookup.model_outputs(ev.select(k.alias("ref_id")), outputs, "parse", 0)
    return rows.select("ref_id", files.lenient_json(F.col("raw")).alias("object"), files.coerced(F.col("raw"), "k int, title string")["k"].alias("k"))


def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, bad = files.route(bundles(spark, sf_dir))
    return ok.select("doc_id", "ext", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("doc_id", "ext", "reason"))


def concatenated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("file_ord"), F.when(F.col("turn") % 3 == 1, F.lit(" \n")).otherwise(F.col("text")).alias("text"))
    ok, _ = files.pasted(files.concatenated(rows).drop("error"))
    return ok.select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").alias("n"))


def normalised_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON payloads of five sources back to one shape."""
    c = candidates(spark, sf_dir)
    people = lambda f: F.transform("authors", lambda a: F.struct(a.alias(f)))
    first, last = F.split("pages", "[-–]")[0], F.get(F.split("pages", "[-–]"), F.lit(1))
    raw = {
        "crossref": F.struct(F.array("title").alias("title"), F.transform("authors", lambda a: F.struct(F.substring_index(a, " ", 1).alias("given"), F.substring_index(a, " ", -1).alias("family"))).alias("author"), F.array("journal_name").alias("container-title"), "volume", "issue", F.col("pages").alias("page"), F.col("doi").alias("DOI"), F.col("cr_type").alias("type"), F.struct(F.array(F.array(F.col("year").cast("int"), F.col("month").cast("int"))).alias("date-parts")).alias("published-print")),
        "openalex": F.struct(F.col("title").alias("display_name"), F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"), F.struct(F.col("journal_name").alias("display_name"), F.col("journal_abbrev").alias("abbrev")).alias("host_venue"), F.struct("volume", "issue", first.alias("first_page"), last.alias("last_page")).alias("biblio"), F.col("year").cast("int").alias("publication_year"), "doi"),
        "semanticscholar": F.struct("title", people("name").alias("authors"), F.col("journal_name").alias("venue"), F.col("year").cast("int").alias("year"), F.struct(F.col("doi").alias("DOI")).alias("externalIds"), F.col("s2_types").alias("publicationTypes")),
        "pubmed": F.struct("title", people("name").alias("authors"), F.col("journal_name").alias("fulljournalname"), F.col("journal_abbrev").alias("source"), F.concat(F.lit("doi: "), "doi").alias("elocationid"), "volume", "issue", "pages", F.concat_ws(" ", "year", F.lit("Mar")).alias("pubdate")),
        "ieeexplore": F.struct("title", F.struct(people("full_name").alias("authors")).alias("authors"), F.col("journal_name").alias("publication_title"), "volume", "issue", first.alias("start_page"), last.alias("end_page"), F.col("year").alias("publication_year"), "doi"),
    }
    payload = F.coalesce(*[F.when(F.col("source") == source, F.to_json(r)) for source, r in raw.items()])
    got = catalogs.from_mixed_json(c.select("ref_id", "cand_ord", "source", payload.alias("payload")), "payload")
    return got.where(F.col("source") != "arxiv").select("ref_id", "cand_ord", "source", "title", _text(F.col("authors")).alias("authors"), "journal_name", "journal_abbrev", "volume", "issue", "pages", "year", "month", "doi")


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom entries made of pages: the entry's own title, names and year."""
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"<title>([^<&]*)", 1)
    k = F.col("page_id")
    xml = F.concat(F.lit("<entry><id>http://arxiv.org/abs/2101."), F.lpad(k.cast("string"), 5, "0"), F.lit("v1</id><title>"), title, F.lit("</title><published>"), (F.lit(2000) + k % 25).cast("string"), F.lit("-01-02T00:00:00Z</published><author><name>A. One</name></author><author><name>B. Two</name></author></entry>"))
    raw = pages.select("page_id", F.from_xml(xml, catalogs.raw_schema("arxiv")).alias("raw"))
    got = catalogs.normalise(raw, "arxiv")
    return got.select("page_id", "title", _text(F.col("authors")).alias("authors"), "journal_name", "year", "arxiv_id")


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as works; some bear a retraction mark of either kind."""
    k = F.col("item_id")
    update = F.array(F.struct(F.concat(F.lit("10.9/"), k.cast("string")).alias("DOI"), F.when(k % 3 == 0, "retraction").otherwise("correction").alias("type"), F.lit("publisher").alias("source"), F.lit("2024-01-01").alias("updated")))
    return table(spark, sf_dir, "benchmark").select(k.cast("string").alias("cand_key"), F.split("text", "\n")[0].alias("title"), F.concat(F.lit("10.8/"), k.cast("string")).alias("doi_key"), F.when(k % 4 == 0, F.lit("is-retracted-by")).alias("relation"), update.alias("update_to"))


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their titles as references: every other one in capitals, the others with a word put before."""
    k, first = F.col("item_id"), F.split("text", "\n")[0]
    return table(spark, sf_dir, "benchmark").select(k.alias("ref_id"), F.when(k % 2 == 0, F.upper(first)).otherwise(F.concat(F.lit("Revisited "), first)).alias("title"))


def retraction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.check_retractions(_screened(spark, sf_dir), _works(spark, sf_dir))


def retraction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that a retracted work is near, and the others: the semi and the anti join."""
    bad, good = screen.split_by_retraction(_screened(spark, sf_dir), _works(spark, sf_dir))
    return bad.select("ref_id", F.lit(True).alias("retracted")).unionByName(good.select("ref_id", F.lit(False).alias("retracted")))


def retracted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.retracted_only(_screened(spark, sf_dir), _works(spark, sf_dir))


def screened_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that list benchmark passages, against the works."""
    k = F.col("item_id")
    line = F.concat(F.lit("["), k.cast("string"), F.lit('] A. B, "'), F.regexp_replace(F.split("text", "\n")[0], '"', ""), F.lit('"'))
    rows = table(spark, sf_dir, "benchmark").select(F.floor(k / 20).alias("doc_id"), k.alias("n"), line.alias("x"))
    docs = rows.groupBy("doc_id").agg(F.concat(F.lit("Body\nReferences\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]), "\n")).alias("text"))
    return screen.screen_documents(docs, _works(spark, sf_dir))


def retraction_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _works(spark, sf_dir)
    raw = w.select("title", F.col("doi_key").alias("doi"), F.struct(F.col("update_to").alias("update-to"), F.col("update_to").alias("update")).alias("raw"))
    return catalogs.retraction_notices(raw)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reference_strings(spark, sf_dir)
    failed = F.when(F.col("ref_id") % 19 == 0, F.lit("lookup failed"))
    out = rows.withColumn("formatted", F.concat(F.upper(F.left("reference", F.lit(1))), F.substr("reference", F.lit(2)))).withColumn("report", F.repeat(F.concat(F.lit("r"), F.col("ref_id").cast("string")), 80)).withColumn("type", F.lit("other"))
    return sinks.with_status(out, failed, F.col("ref_id") % 23 == 0)


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.numbered(_results(spark, sf_dir))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.summary(_results(spark, sf_dir))


def batch_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.preview(_results(spark, sf_dir))


def batch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report_document(_results(spark, sf_dir)).select("doc_id", F.sha2("document", 256).alias("sha"), F.length("document").alias("n"))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.result_rows(_results(spark, sf_dir).drop("report"))


def fresh_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    rows = ev.select(F.col("event_id").alias("request_id"), "ts", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("ref_hash"))
    return online.drop_repeats_batch(rows).select("request_id", "ref_hash")


ALL = [
    consensus_vote, field_votes, author_votes, year_votes, page_ranges, title_clusters, cluster_ranking, consensus_records, match_scores, title_token_sort,
    selected_best, reconciled_types, enriched, verification, loop_guards, input_validation, journal_abbreviations, corrections, change_log, patches, repair_loop,
    formatted_by_type, csl_exports, bibtex_exports, recorded_lines, reports, evidence, scalar_text, scalar_authors, scalar_pages, scalar_dates, scalar_ids,
    source_weights, fingerprints, parsed_references, marked_references, paragraph_references, split_documents, extracted_references, doi_lookup, arxiv_lookup,
    title_lookup, title_lookup_sorted, gathered_candidates, recorded_outputs, routed_files, concatenated_texts, normalised_catalogs, feed_entries, retraction_checks, retracted_titles,
    screened_documents, retraction_split, retraction_notices, numbered_lines, batch_summary, batch_preview, batch_documents, result_rows, fresh_requests,
]


def queries() -> dict:
    return {f.__name__: f for f in ALL}

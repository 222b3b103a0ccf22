"""The selection's short cuts against the long way, and how little its plan computes."""

import random

from citeflow.functions import scalars as S
from citeflow.operators import fuse
from pyspark.sql import functions as F


def drawn(spark, seed: int, most: int):
    """Candidates with equal and near titles, blank values, DOIs in several spellings, and names of many forms."""
    r = random.Random(seed)
    titles = ["Deep graphs for tables", "deep  graphs for tables.", "Birds", "A. B", " ", None]
    names = ["Ada Lovelace", "A. Lovelace", " Bob  Roe Jr. ", "", "et al.", None, "ßen Xu", "Q 3rd"]
    rows = [
        (ref, i + 1, r.choice(["crossref", "openalex", "semanticscholar", "arxiv", "blog", None]), r.choice(titles), [r.choice(names) for _ in range(r.randint(0, 3))], r.choice(["3", "3-9", "3–9", None]), r.choice(["2001", "1999a", "x", None]), r.choice(["10.1/a", "https://doi.org/10.1/A.", "doi:doi:10.1/a", "10.1/b", None]))
        for ref in range(150)
        for i in range(r.randint(1, most))
    ]
    return spark.createDataFrame(rows, "ref_id long, cand_ord int, source string, title string, authors array<string>, pages string, year string, doi string")


def test_best_record_is_the_consensus_exactly_where_its_doi_is_the_references(spark):
    for seed, most in ((1, 1), (2, 5)):
        cands = drawn(spark, seed, most)
        refs = spark.range(150).selectExpr("id AS ref_id", "'Deep graphs for tables' AS title", "array('Ada Lovelace') AS authors", "CASE id % 3 WHEN 0 THEN '10.1/A' WHEN 1 THEN '10.1/b' END AS doi")
        got = {r["ref_id"]: r for r in fuse.select_best(refs, cands).collect()}
        long_way = fuse.consensus(cands).join(refs.select("ref_id", F.col("doi").alias("own")), "ref_id").where(S.doi_key("doi") == S.doi_key("own")).drop("own")
        want = {r["ref_id"]: r for r in long_way.collect()}
        assert len(want) > 20
        for k, w in want.items():
            assert all(got[k]["best"][f] == w[f] for f in fuse.FIELDS) and got[k]["provenance"] == w["provenance"]


def test_one_candidate_has_the_values_that_votes_over_rows_give(spark):
    cands = drawn(spark, 3, 1).where("source is not null")
    got = fuse.voted(fuse.gathered(cands), "own")
    at = {f: fuse.VOTED.index(f) for f in ("title", "pages", "doi")}
    mine = {(r["ref_id"], f, r["votes"][i]["v"], r["votes"][i]["w"], r["votes"][i]["s"]) for r in got.collect() for f, i in at.items() if r["votes"][i] is not None}
    rows = fuse.vote_fields(fuse.with_fields(cands), ["ref_id"]).where(F.col("field").isin(*at)).collect()
    assert mine == {(r["ref_id"], r["field"], r["value"], int(r["weight"] * 100), r["source"]) for r in rows} and mine
    years = {(r["ref_id"], r["years"]["y"]) for r in got.collect() if r["years"] is not None}
    assert years == {(r["ref_id"], r["year"]) for r in fuse.best_years(cands, ["ref_id"], 2025).collect()} and years
    people = {(r["ref_id"], tuple(r["people"]["best"]["raw"])) for r in got.collect() if r["people"] is not None}
    assert people == {(r["ref_id"], tuple(r["authors"])) for r in fuse.vote_authors(cands, ["ref_id"]).collect()} and people


def test_votes_are_counted_only_for_references_whose_doi_some_candidate_holds(spark, sf_dir):
    from citeflow.plans import queries

    plan = queries.selected_best(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" in plan.lower() and "max_by" not in plan  # records are not gathered once more for each pick


def test_surnames_of_a_record(spark):
    rows = fuse.with_fields(drawn(spark, 4, 3))
    c = rows.select(fuse.record(rows).alias("c"))
    assert c.where(~S.record_surnames(F.col("c.authors")).eqNullSafe(S.surnames(F.col("c.authors")))).count() == 0


def test_author_keys_of_a_record(spark):
    r = random.Random(11)
    words = ["Ada", "b.", "J.-P.", "3rd", "-x", "von", "O'Neil", "et", "al.", "et.", "al", "Et", "ßen", "Éva", "_", "Jr.", "(ed)"]
    people = [[" ".join(r.choice(words) for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 4))] for _ in range(2000)]
    rows = fuse.with_fields(spark.createDataFrame([(i, p) for i, p in enumerate([*people, None])], "ref_id long, authors array<string>"))
    c = rows.select(fuse.record(rows).alias("c"))
    assert c.where(~S.record_author_keys(F.col("c.authors")).eqNullSafe(S.author_keys(F.col("c.authors")))).count() == 0


def test_page_ranges_of_the_selection_widen_pages_as_those_of_all_candidates_do(spark):
    from citeflow.operators import repair, verify
    from citeflow.schemas import CHANGE

    cands = drawn(spark, 5, 5).withColumn("pages", F.expr("CASE cand_ord WHEN 1 THEN pages WHEN 2 THEN 'pp. 3-12' WHEN 3 THEN '13-19' WHEN 4 THEN '3–12' ELSE '3' END"))
    refs = spark.range(150).selectExpr("id AS ref_id", "'Deep graphs for tables' AS title", "if(id % 2 = 0, '3', '13') AS pages")
    rows = verify.verify(fuse.select_best(refs, cands)).withColumn("attempts", F.lit(0)).withColumn("changed", F.lit(False)).withColumn("changes", F.array().cast(CHANGE))
    own, all_ = (repair.apply_corrections(rows, ranges).selectExpr("ref_id", "ex.pages", "to_json(changes) AS changes").collect() for ranges in (None, fuse.longest_ranges(cands, ["ref_id"])))
    assert sorted(own) == sorted(all_) and any("pp. 3-12" == r["pages"] for r in own) and any("13-19" == r["pages"] for r in own)

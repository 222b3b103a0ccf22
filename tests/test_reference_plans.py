"""What queries shuffle, and that votes over arrays and over rows agree."""

import random

import pytest
from citeflow.operators import fuse
from citeflow.plans import queries


@pytest.fixture
def not_adaptive(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["field_votes", "consensus_vote", "consensus_records", "title_clusters", "cluster_ranking", "author_votes"])
def test_candidates_are_shuffled_once(not_adaptive, sf_dir, name):
    assert plan(queries.queries()[name](not_adaptive, sf_dir)).count("- Exchange hashpartitioning") == 1


def test_candidates_meet_references_without_another_shuffle(not_adaptive, sf_dir):
    by_candidate = plan(queries.match_scores(not_adaptive, sf_dir)).count("- Exchange hashpartitioning")
    assert by_candidate <= 3  # candidates, their first ones, orders


def test_records_are_compiled(not_adaptive, sf_dir):
    assert "transform(array(named_struct(title" not in plan(queries.match_scores(not_adaptive, sf_dir))


def test_votes_over_arrays_equal_votes_over_rows(spark):
    draw = random.Random(7)
    sources = ["crossref", "openalex", "semanticscholar", "ieeexplore", "pubmed", "arxiv", "blog"]
    pages = ["1-9", "1–9", "3", "1-12", "e7", None]
    rows = [(ref, i + 1, draw.choice(sources), draw.choice(["A", "B", " A ", None]), draw.choice(pages), draw.choice(["x", "y", "z", ""])) for ref in range(200) for i in range(draw.randint(1, 7))]
    df = spark.createDataFrame(rows, "ref_id long, cand_ord int, source string, title string, pages string, volume string")
    got = fuse.voted(fuse.gathered(df), "own")
    at = {f: fuse.VOTED.index(f) for f in ("title", "pages", "volume")}
    mine = {(r["ref_id"], f, r["votes"][i]["v"], r["votes"][i]["w"], r["votes"][i]["s"]) for r in got.collect() for f, i in at.items() if r["votes"][i] is not None}
    want = fuse.vote_fields(fuse.with_fields(df), ["ref_id"]).collect()
    assert mine == {(r["ref_id"], r["field"], r["value"], int(r["weight"] * 100), r["source"]) for r in want} and len(mine) > 300


@pytest.mark.parametrize("name", ["corrections", "change_log"])
def test_corrections_shuffle_no_more_than_the_selection(not_adaptive, sf_dir, name):
    assert plan(queries.queries()[name](not_adaptive, sf_dir)).count("- Exchange") == plan(queries.selected_best(not_adaptive, sf_dir)).count("- Exchange")


def test_reports_shuffle_no_more_than_the_selection(not_adaptive, sf_dir):
    assert plan(queries.reports(not_adaptive, sf_dir)).count("- Exchange") == plan(queries.selected_best(not_adaptive, sf_dir)).count("- Exchange")


def test_patches_shuffle_the_selection_and_the_references_again(not_adaptive, sf_dir):
    of = lambda f: plan(f(not_adaptive, sf_dir)).count("- Exchange hashpartitioning")
    assert of(queries.patches) == of(queries.selected_best) + 2  # orders and their first candidates

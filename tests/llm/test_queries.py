import hashlib
import os
import re
import sys
from collections import Counter

import duckdb
import pytest
import sentencepiece
from citeflow.llm import queries, toxicity

sys.path.insert(0, os.path.dirname(__file__))
from test_near_copies import brute_kept  # noqa: E402
from test_tables import brute_targets  # noqa: E402
from test_text import naive_score  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    """Each stage on its predecessor's rows, against plain Python. (The near-copy stage links texts by five-word shingles
    of a Jaccard similarity of 0.8; op4's four-word fingerprints bind that query only.)"""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit_table(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    kept = {}
    for name, stage in p.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        rows, got = [r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]
        ids = [r["doc_id"] for r in got]
        if name == "toxicity":
            assert set(ids) == {r["doc_id"] for r in rows if naive_score(model, r["text"] or "")[1] == 0}
        if name == "exact_dedup":
            first = {}
            for r in rows:
                t = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
                first[t] = min(first.get(t, r["doc_id"]), r["doc_id"])
            assert set(ids) == set(first.values())
        if name == "simhash_dedup":
            assert set(ids) == brute_kept([(r["doc_id"], r["text"]) for r in rows])
        if name == "mixing":
            size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
            total, took = Counter(), Counter()
            for r in rows:
                total[r["source"]] += size[r["doc_id"]]
            for r in got:
                took[r["source"]] += size[r["doc_id"]]
            goal = brute_targets(total)
            assert max(Counter(ids).values()) <= 2 and {str(r) for r in got} <= {str(r) for r in rows}
            # what is left of a target is less than any document that could still be taken once more
            taken = Counter(ids)
            for s in total:
                more = [size[r["doc_id"]] for r in rows if r["source"] == s and taken[r["doc_id"]] <= goal[s] // total[s] < 2 and size[r["doc_id"]]]
                assert took[s] <= goal[s] + 1 and (not more or goal[s] - took[s] < min(more) or goal[s] - took[s] < 0.01 * goal[s])
        if name == "sentencepiece":
            text = {r["doc_id"]: r["text"] or "" for r in rows}
            want = {i: pieces.encode(t) for i, t in text.items()}
            assert sorted(ids) == sorted(r["doc_id"] for r in rows) and all(r["n_tokens"] == len(want[r["doc_id"]]) for r in got)
            assert all(r["decoded_sha256"] == hashlib.sha256(pieces.decode(want[r["doc_id"]]).encode()).hexdigest() for r in got)
        else:
            assert docs.columns == before.columns
            assert name == "mixing" or len(ids) == len(set(ids))
        kept[name] = len(ids)
    assert kept["toxicity"] > kept["exact_dedup"] > kept["simhash_dedup"] > 0 and kept["sentencepiece"] == kept["mixing"] > 0


def test_pipeline_over_odd_and_no_rows(spark, odd_docs, no_docs, sf_dir):
    import corpus_pipeline as p

    for docs in (odd_docs, no_docs):
        for _, stage in p.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()


def test_the_toxicity_model_is_fitted_in_a_task(spark, sf_dir, monkeypatch):
    """The driver has neither the sample's texts nor the fit of them."""
    from citeflow.llm import toxicity

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    want = toxicity.fit(sorted_sample(docs, labels))

    def refused(*_):
        raise AssertionError("fitted in the driver")

    monkeypatch.setattr(toxicity, "fit", refused)
    assert want.weights and toxicity.fit_table(docs, labels) == want


def sorted_sample(docs, labels):
    """(text, grade) of all labelled documents by id: the small tables have less than ``SAMPLE`` of each class."""
    rows = docs.join(labels, "doc_id").selectExpr("doc_id", "coalesce(text, '') AS text", "cast(toxic AS int) AS toxic").collect()
    return [(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]

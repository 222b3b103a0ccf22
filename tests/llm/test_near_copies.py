import random
import re

import corpus_pipeline
import pytest
from citeflow.llm import near_copies


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(docs, at_least=0.8):
    """Smallest ids of the components over all pairs."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or len(a & b) >= at_least * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i, _ in sets}


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"w{r.randrange(10**6)}"
    return out


def test_stage_links_every_pair_of_that_similarity(spark, sf_dir):
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    r = random.Random(6)
    at = 10_000
    for size in (1, 4, 5, 9, 10, 30, 200):
        base = [f"v{r.randrange(300)}" for _ in range(size)]
        for _ in range(25):  # around the threshold, chains included
            docs.append((at, " ".join(edited(r, base, r.randint(0, max(1, size // 25))))))
            at += 1
    docs += [(at, ""), (at + 1, None), (at + 2, " \n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_kept(docs)
    got = [x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, df, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert 177 in {i for i, _ in docs} - want  # of similarity 0.83 to document 1, nine bits of op4's fingerprint apart
    few = [x["doc_id"] for x in near_copies.drop_near_copies(df, sample=1).collect()]  # whatever the sample holds
    assert set(few) == want


@pytest.mark.parametrize("crowd", [3, 64])
def test_a_large_group_of_near_copies(spark, monkeypatch, crowd):
    """Copies of one text with more and more changes, chains of copies, and a passage that all texts share."""
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    r = random.Random(9)
    passage, base = [f"p{i}" for i in range(12)], [f"b{i}" for i in range(90)]
    docs = [(i, " ".join(edited(r, base, r.randint(0, 9)))) for i in range(150)]
    now = [f"c{i}" for i in range(60)]
    for i in range(200, 240):
        docs.append((i, " ".join(now)))
        now = edited(r, now, 1)
    docs += [(i, " ".join([*passage, *(f"q{i}-{j}" for j in range(r.randint(2, 60)))])) for i in range(300, 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {x["doc_id"] for x in near_copies.drop_near_copies(df).collect()} == brute_kept(docs)


def test_odd_and_no_rows(spark, odd_docs, no_docs):
    assert near_copies.drop_near_copies(no_docs).collect() == []
    kept = near_copies.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 3, 7, 10]

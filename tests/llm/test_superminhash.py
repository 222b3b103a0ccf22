import os
import random
import sys

import numpy as np
import pytest
from citeflow.llm import queries, superminhash

sys.path.insert(0, os.path.dirname(__file__))
from test_near_copies import edited, shingles  # noqa: E402


def brute(docs):
    """(doc_id, size, component) over all pairs; texts without words stand alone."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[max(find(x), find(y))] = min(find(x), find(y))
    low = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        low[r] = i if low.get(r) is None else low[r] if i is None else min(low[r], i)
    return sorted(((i, len(s), low[find(k)], i == low[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def got_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_signatures_estimate_with_less_variance():
    r = np.random.default_rng(1)
    off = []
    for _ in range(150):
        a, b = r.integers(0, 2**63, 200), r.integers(0, 2**63, 30)
        x, y = superminhash.signatures([a, np.concatenate([a[:170], b])])
        off.append(superminhash.estimate(x, y) - 170 / 230)
    assert abs(np.mean(off)) < 0.008 and np.std(off) < 0.034  # plain MinHash: 0.039


def test_signatures_of_a_set_do_not_depend_on_others():
    """One shingle at a time, a permutation drawn step by step, in plain Python."""
    m, mask = 16, 2**64 - 1

    def mixed(z):
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        return z ^ z >> 31

    r = random.Random(2)
    sets = [[r.getrandbits(64) for _ in range(n)] for n in (0, 1, 2, 5, 40, 300)]
    got = superminhash.signatures([np.array(s, np.uint64) for s in sets], m)
    for s, row in zip(sets, got):
        want = [2**64 - 1] * m if s else [0] * m
        for h in s:
            p = list(range(m))
            for j in range(m):
                z = mixed(h + (j + 1) * 0x9E3779B97F4A7C15 & mask)
                k = j + ((z >> 32) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j << 32 | z & 0xFFFFFFFF)
        assert row.tolist() == want


def test_groups_against_brute_force(spark, sf_dir):
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    r, at = random.Random(6), 10_000
    for size in (1, 4, 5, 9, 30, 60, 200):
        base = [f"v{r.randrange(300)}" for _ in range(size)]
        for _ in range(25):  # around the threshold, chains included
            docs.append((at, " ".join(edited(r, base, r.randint(0, max(1, size // 20))))))
            at += 1
    passage, now = [f"p{i}" for i in range(60)], [f"c{i}" for i in range(90)]
    docs += [(i, " ".join([*passage, *(f"q{i}-{j}" for j in range(r.randint(2, 30)))])) for i in range(20_000, 20_100)]
    for i in range(30_000, 30_060):
        docs.append((i, " ".join(now)))
        now = edited(r, now, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got_rows(superminhash.near_duplicates(df)) == brute(docs)


def test_partners_of_a_node_over_several_runs(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "PARTNERS", 7)
    r = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    docs = [(i, " ".join(edited(r, base, r.randint(0, 4)))) for i in range(80)]
    assert got_rows(superminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_query_on_the_table(spark, sf_dir):
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got_rows(queries.op11_superminhash(spark, sf_dir)) == brute(docs)


def test_odd_and_no_rows(spark, odd_docs, no_docs):
    assert superminhash.near_duplicates(no_docs).collect() == []
    got = got_rows(superminhash.near_duplicates(odd_docs))
    docs = [(d["doc_id"], d["text"]) for d in odd_docs.collect()]
    assert got == sorted(((i, n, low if n else i, i == low or not n) for i, n, low, _ in brute(docs)), key=str)
    assert superminhash.near_duplicates(odd_docs).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_odd_bands(spark, no_docs):
    with pytest.raises(ValueError):
        superminhash.near_duplicates(no_docs, band=5)

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from citeflow.llm import periodic_runs, queries


def brute_runs(w, at_least=24, periods=3):
    """Every stretch of a period that no neighbour extends, if no smaller period holds for it."""
    n, out = len(w), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            part = w[i : i + size]
            if j > i and size >= max(at_least, periods * q) and not any(part[d:] == part[: size - d] for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, rewrite):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if rewrite and h is not None and h % 10 == 0 and w:
        a, g = h // 10 % len(w), h // 10
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("at_least, periods", [(24, 3), (8, 2), (4, 2), (30, 4)])
def test_runs_against_brute_force(at_least, periods):
    r = random.Random(at_least)
    for _ in range(60):
        texts = []
        for _ in range(r.randint(0, 6)):
            k, w = r.choice([1, 2, 2, 3, 5, 50]), []
            for _ in range(r.randint(0, 12)):
                w += [b"%d" % r.randrange(k) for _ in range(r.randint(1, 15))] * r.choice([1, 1, 2, 3, 4, 7, 9])
            texts.append(w)
        assert periodic_runs.find_runs(texts, at_least, periods) == [brute_runs(w, at_least, periods) for w in texts]


def test_common_prefixes_and_order():
    import numpy as np

    r = np.random.default_rng(3)
    ids = np.unique(np.tile(r.integers(0, 3, 40), 4)[:130], return_inverse=True)[1].astype(np.int64)
    order, levels = periodic_runs.suffix_ranks(ids)
    told = ids.tolist()
    assert order.tolist() == sorted(range(len(told)), key=lambda i: told[i:])
    x, y = order[:-1], order[1:]
    want = [next((k for k in range(len(told)) if max(i, j) + k >= len(told) or told[i + k] != told[j + k]), 0) for i, j in zip(x.tolist(), y.tolist())]
    assert periodic_runs.common_prefixes(x, y, levels).tolist() == want


def test_whole_query(spark, sf_dir):
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, sf_dir).collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(got) == sorted(brute_row(d["doc_id"], d["text"], True) for d in docs) and sum(r[1] for r in got) > 5


def test_odd_and_no_rows(spark, odd_docs, no_docs):
    for rewrite in (False, True):
        got = [tuple(r) for r in periodic_runs.run_report(odd_docs, rewrite=rewrite).collect()]
        short = [d for d in odd_docs.collect() if len(d["text"] or "") < 10_000]
        assert sorted(str(r) for r in got if r[0] not in (7, 8)) == sorted(str(brute_row(d["doc_id"], d["text"], rewrite)) for d in short)
        assert len(got) == len(short) + 2
        assert all(r[1:6] == (1, 0, 20_000, 5, 4_000_000) for r in got if r[0] in (7, 8) and (not rewrite or zlib.crc32(b"%d" % r[0]) % 10))
    assert periodic_runs.run_report(no_docs).collect() == []
    assert periodic_runs.collapse_runs(no_docs).collect() == []


def test_collapsing_keeps_rows_and_columns(spark, odd_docs):
    got = periodic_runs.collapse_runs(odd_docs)
    assert got.columns == odd_docs.columns
    rows, before = [r.asDict() for r in got.collect()], [r.asDict() for r in odd_docs.collect()]
    key = lambda r: str((r["doc_id"], r["lang"], r["source"], r["keep_id"]))
    for new, old in zip(sorted(rows, key=key), sorted(before, key=key)):
        assert {k: v for k, v in new.items() if k != "text"} == {k: v for k, v in old.items() if k != "text"}
        if old["doc_id"] in (7, 8):
            assert new["text"] == "lorem ipsum dolor sit amet" + " end" * (old["doc_id"] == 8)
        else:
            assert new["text"] == old["text"]


def test_a_very_long_text():
    words = [b"a", b"b", b"c"] * 60_000
    assert periodic_runs.find_runs([words, [b"x"] * 3, []]) == [[(0, 180_000, 3)], [], []]


def test_odd_parameters():
    with pytest.raises(ValueError):
        periodic_runs.find_runs([[b"a"]], 24, 1)

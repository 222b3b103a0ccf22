import hashlib
import random
import re

import numpy as np
import xxhash
from citeflow.llm import exact_dedup, simhash, suffix_dedup
from citeflow.llm.components import connected_components, contract
from citeflow.llm.common import Scratch

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- suffix arrays


def brute_repeats(texts, length):
    first = {}
    for d, t in texts:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, d), d)
    masks = []
    for d, t in texts:
        m = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < d:
                m[p : p + length] = True
        masks.append(m)
    return masks


def some_texts(r, n, alphabet):
    base = [bytes(r.choice(alphabet) for _ in range(r.choice([0, 3, 49, 50, 51, 80, 300]))) for _ in range(6)]
    return [b"".join(r.choice(base)[r.randint(0, 30) :] for _ in range(r.randint(0, 4))) for _ in range(n)]


def test_repeats_against_brute_force():
    r = random.Random(3)
    for _ in range(120):
        texts = [(r.randint(0, 5), t) for t in some_texts(r, r.randint(1, 8), r.choice([b"a", b"ab", b"abcd", bytes(range(256)), b"\x00\xff"]))]
        buf = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
        size = np.array([len(t) for _, t in texts])
        got = suffix_dedup.repeats(buf, np.cumsum(size) - size, np.maximum(0, size - 49), np.array([d for d, _ in texts]))
        at = 0
        for (_, t), want in zip(texts, brute_repeats(texts, 50)):
            n = max(0, len(t) - 49)
            mask = np.zeros(len(t), bool)
            for p in np.flatnonzero(got[at : at + n]):
                mask[p : p + 50] = True
            at += n
            assert (mask == want).all()


def test_suffix_array_and_prefixes_are_those_of_a_plain_sort():
    r = random.Random(5)
    for alphabet in (b"a", b"ab", b"xyz", bytes(range(256))):
        buf = np.frombuffer(bytes(r.choice(alphabet) for _ in range(400)), np.uint8)
        array = suffix_dedup.suffix_array(buf, np.ones(400, bool))
        text = buf.tobytes()
        keys = [text[i : i + 50] for i in array]
        assert keys == sorted(keys) and sorted(array) == list(range(400))
        common = suffix_dedup.common_prefixes(np.concatenate([buf, np.zeros(60, np.uint8)]), array)
        padded = text + b"\0" * 60
        for i in range(1, 400):
            a, b = padded[array[i] :][:50], padded[array[i - 1] :][:50]
            assert common[i] == next((k for k in range(50) if a[k] != b[k]), 50)


def test_op1_on_whole_tables(spark):
    r = random.Random(11)
    docs = [(i, t.decode("latin-1")) for i, t in enumerate(some_texts(r, 60, b"abcdefgh"))]
    docs += [(60, docs[3][1]), (61, None), (None, docs[3][1])]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {}
    order = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in docs]
    for (i, _), (_, t), m in zip(docs, order, brute_repeats(order, 50)):
        edges = np.diff(np.concatenate([[0], m.astype(int), [0]]))
        kept = bytes(np.frombuffer(t, np.uint8)[~m])
        want[i] = (len(t), int(m.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    for how in ({}, {"group": 2000, "bucket": 500, "frequent": 2}):
        got = rows(suffix_dedup.dedup_report(df, **how))
        assert len(got) == len(docs) and {g[0]: g[1:] for g in got} == want


def test_op1_odd_rows(odd_docs, no_docs):
    assert rows(suffix_dedup.dedup_report(no_docs)) == []
    got = rows(suffix_dedup.dedup_report(odd_docs))
    assert len(got) == odd_docs.count()
    assert {g[2] > 0 for g in got if g[0] == 8} == {True}  # all but its end is in document 7
    assert [g[2] for g in got if g[0] in (2, 3, 4, 9)] == [0] * 5


# ---- exact


def test_exact_against_brute_force(spark, odd_docs, no_docs):
    assert rows(exact_dedup.dedup_report(no_docs)) == []
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(20 + i, "hot\n copy") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    groups = {}
    for i, t in docs:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    for counters in (1, 2, 256):
        got = rows(exact_dedup.dedup_report(df, counters))
        assert len(got) == len(docs)
        by = {}
        for doc_id, keep, size, kept, digest in got:
            by.setdefault(digest, []).append((doc_id, keep, size, kept))
        for text, ids in groups.items():
            own = by[hashlib.sha256(text.encode()).hexdigest()]
            low = min((i for i in ids if i is not None), default=None)
            assert sorted(map(str, ids)) == sorted(str(o[0]) for o in own)
            assert {(o[1], o[2]) for o in own} == {(low, len(ids))}
            assert [o[0] for o in own if o[3]] == [low]
        kept = exact_dedup.drop_copies(df, counters)
        assert sorted(str(r[0]) for r in rows(kept)) == sorted(str(g[0]) for g in got if g[3])
    assert exact_dedup.drop_copies(odd_docs).columns == odd_docs.columns


def test_misra_gries_finds_every_frequent_item(spark):
    r = random.Random(1)
    items = ["hot"] * 300 + ["warm"] * 150 + [str(i) for i in range(500)]
    r.shuffle(items)
    df = spark.createDataFrame([(bytes(x, "ascii"),) for x in items], "digest binary").repartition(5)
    found = exact_dedup.heavy_digests(df, 8)
    assert {b"hot", b"warm"} <= set(found) and len(found) <= 8


# ---- SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_masks_cover_every_pair_within_the_radius():
    r = random.Random(2)
    masks = simhash.masks()
    assert len(masks) == 31
    for _ in range(5000):
        diff = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(not diff & m for m in masks)


def test_simhash_against_brute_force(spark, odd_docs, no_docs, sf_dir):
    assert rows(simhash.near_duplicates(no_docs)) == []
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    docs += [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    prints = [brute_fingerprint(t) for _, t in docs]
    comp = brute_components(prints)
    low = {}
    for (i, _), c in zip(docs, comp):
        low.setdefault(c, []).append(i)
    want = sorted(
        (str(i), f"{p:016x}", str(min((x for x in low[c] if x is not None), default=None))) for (i, _), p, c in zip(docs, prints, comp)
    )
    assert sorted((str(a), b, str(c)) for a, b, c in rows(simhash.near_duplicates(df))) == want
    kept = rows(simhash.drop_near_copies(df))
    assert len(kept) == len(low)


def test_fingerprints_in_dense_buckets(spark):
    """Hot buckets go through midpoints and give the same components."""
    r = random.Random(9)
    prints = {0, r.getrandbits(64)}
    for centre in list(prints):
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))))
        far = centre ^ sum(1 << b for b in r.sample(range(64), 9))
        prints |= {far, far ^ 7}
    prints = sorted(prints)
    comp = brute_components(prints)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    for bucket in (4096, 8):
        got = dict(rows(simhash.link_fingerprints(df, Scratch(spark), bucket=bucket)))
        sides = {}
        for p, c in zip(prints, comp):
            sides.setdefault(c, set()).add(got.get(simhash.signed(p), simhash.signed(p)))
        assert all(len(s) == 1 for s in sides.values()) and len({min(s) for s in sides.values()}) == len(sides)


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = dict(rows(connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark))))
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in range(101, 151))
    u, v = contract(np.array([200, 3, 2]), np.array([3, 2, 9]))
    assert dict(zip(u.tolist(), v.tolist())) == {200: 2, 3: 2, 9: 2}
    assert rows(connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark))) == []

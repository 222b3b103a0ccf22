import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from citeflow.llm import chat, mixing, topk
from citeflow.llm.common import Scratch
from pyspark.sql import functions as F


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Sources by code point, null last: shares by weight, what is above a cap reshared until none is."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            return full | {s: left * w[s] / total for s in free}
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]
        free -= over
    return full


def source_docs(seed, n, sources):
    r = random.Random(seed)
    return [(i, " ".join(["w"] * r.choice([0, 1, 5, 20, 40])), r.choice(sources)) for i in range(n)]


def test_mix_meets_its_targets(spark, no_docs):
    assert rows(mixing.mix_report(no_docs)) == []
    for seed, sources in ((1, ["a", "b", "c", "d", None]), (2, ["x"]), (3, ["a"] * 40 + ["B", "é", "", None])):
        docs = source_docs(seed, 600, sources)
        df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
        how = {"block_words": 150, "shard_words": 1000}
        got = rows(mixing.mix_report(df, **how))
        size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
        src = {i: s for i, _, s in docs}
        total = Counter()
        for i, _, s in docs:
            total[s] += size[i]
        goal, took = brute_targets(total), Counter()
        assert len(got) == len(docs)
        for i, n, source_size, target, taken, shards in got:
            assert n == size[i] and source_size == total[src[i]] and abs(target - goal[src[i]]) < 1e-6
            assert taken <= 2 * n and taken == n * len(shards)
            took[src[i]] += taken
        assert all(abs(took[s] - goal[s]) <= max(2, 0.01 * goal[s]) for s in total)
        again = rows(mixing.mix_report(df.repartition(7), **how))
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_odd_documents_are_mixed(spark, odd_docs):
    got = rows(mixing.mix_report(odd_docs))
    assert len(got) == odd_docs.count() and all(r[4] <= 2 * r[1] for r in got)
    mixed = mixing.mixed_rows(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(len(r[5]) for r in got)


def test_splitting_tree_is_exact_and_hypergeometric(spark):
    counts = [(0, 37), (1, 0), (2, 5), (3, 120)]
    df = spark.createDataFrame(counts, "place int, draws long")
    for levels in (1, 3):
        got = rows(mixing.split_tree(df, levels))
        by_source, by_shard = Counter(), Counter()
        for shard, place, quota in got:
            assert quota >= 0
            by_source[place] += quota
            by_shard[shard] += quota
        assert all(by_source[p] == n for p, n in counts)
        assert max(by_shard.values()) - min(by_shard.values()) <= levels
    # means and variances over seeds against the law: 30 of 90 marked, 45 drawn
    urn = spark.createDataFrame([(0, 30), (1, 60)], "place int, draws long")
    left = []
    for seed in range(60):
        left += [q for shard, place, q in rows(mixing.split_tree(urn, 1, seed)) if shard == 0 and place == 0]
    assert abs(np.mean(left) - 15) < 1.2 and 1.2 < np.var(left) < 12  # the law: 15 and 5.06


# ---- top k


def brute_top(vectors, is_query, k=5):
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, dim - len(v)))) for i, v in good]
    out = []
    for i, q in good:
        if is_query(i):
            best = sorted((-int(q @ v), j) for j, v in good if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(300, 8)) * r.choice([0.1, 1, 3], size=(300, 1))
    near = base[:40] + r.normal(scale=0.01, size=(40, 8))
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(np.concatenate([base, near, base[:20]]))]
    vectors += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [1.0] * 8), (1010, []), (1020, [0.0] * 8), (1030, [2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    want = brute_top(vectors, lambda i: i % 10 == 0)
    for bucket in (4096, 16):
        assert sorted(rows(topk.top_k(df, F.col("vec_id") % 10 == 0, bucket=bucket))) == want
    assert rows(topk.top_k(df.where("false"), F.col("vec_id") % 10 == 0)) == []
    few = df.where("vec_id < 3")
    assert len(rows(topk.top_k(few, F.col("vec_id") == 0))) == 2


# ---- chats


def test_chat_round_trip(spark):
    r = random.Random(6)
    bits = ["hi", "<|im_end|>\n", "<|im_start|>assistant\nok", "<|im_sep|>", "&lt;|", "&amp;", "&", "\n", "日本", "", "&nl;"]
    turns = [(c, t, r.choice(["user", "assistant", "assistant", "system", "odd\nrole", None]), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 4)))) for c in range(60) for t in range(r.randint(1, 9))]
    turns += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (7, 0, "user", "same turn"), (7, 0, "user", "same turn")]
    r.shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1))
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    made = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    back = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    report = {r["conv_id"]: r for r in chat.chat_report(df).collect()}
    assert set(made) == set(by)
    for c, own in by.items():
        own.sort()
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(role, text) for _, role, text in own]
        loss = "".join(text for _, role, text in own if role == "assistant")
        text = made[c]["formatted"]
        assert back[c]["loss_text"] == loss and len(made[c]["loss_mask"]) == sum(role == "assistant" for _, role, _ in own)
        blocks = sum(i == 0 or own[i - 1][1] != o[1] for i, o in enumerate(own))
        assert text.count(chat.START) == blocks == report[c]["n_blocks"] and text.count(chat.SEP) == len(own) - blocks
        lines = "".join(f"{role}\n{t}\n" for _, role, t in own)
        assert tuple(report[c])[1:6] == (len(own), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
    assert rows(chat.chat_report(df.where("false"))) == []

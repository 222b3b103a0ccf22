import datetime
import hashlib
import math
import random
import re

import pytest
import sentencepiece
import tokenizers
from citeflow.llm import pii, queries, sentencepiece_codec, token_counts, toxicity
from citeflow.llm.queries import tokenizer_path
from pyspark.sql import functions as F

KEY = "a key of the tests"
PIECES, WORDS = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
BITS = ["a", "the", "The", " ", "  ", "\n", "\t", "é", "é", "<s>", "▁", "<|endoftext|>", "<|EndOfText|>", "'s", "'LL", "12", "½", "日本", "\x00", "\x1c", "　", "\xa0", "ß", "ΣΑΣ", "İ", "😀", "!!", "...", ".", ",", "́"]


def rows(df):
    return [tuple(r) for r in df.collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="session")
def mixed(spark, odd_docs, sf_dir):
    r = random.Random(1)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(100 + i, t) for i, t in enumerate(texts)]
    docs += [(10_000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    return docs


def test_sentencepiece_equals_the_library(spark, mixed, no_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t in mixed:
        ids = model.encode(t or "")
        want.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    df = spark.createDataFrame(mixed, "doc_id long, text string")
    got = [(str(r[0]), *r[1:]) for r in rows(sentencepiece_codec.encode_report(df, PIECES))]
    assert sorted(got) == sorted(want)
    assert rows(sentencepiece_codec.encode_report(no_docs, PIECES)) == []
    back = df.limit(200).select("text", sentencepiece_codec.encode_column(PIECES)("text").alias("ids")).withColumn("back", sentencepiece_codec.decode_column(PIECES)("ids"))
    for text, ids, again in rows(back):
        assert ids == model.encode(text or "") and again == model.decode(ids)


def test_sentencepiece_long_texts_in_stretches(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "STRETCH", 40)
    monkeypatch.setattr(sentencepiece_codec, "TABLE", 30)
    codec = sentencepiece_codec.Codec(PIECES)
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice(BITS) for _ in range(60))
        n, ids, surface = [], [], []
        sentencepiece_codec._hash(codec, ([p] for p in codec.stretches(text)), n, ids, surface)
        want = codec.model.encode(text)
        assert (n[0], ids[0], surface[0]) == (len(want), sha(",".join(map(str, want))), sha(codec.model.decode(want)))


def test_token_counts_equal_the_library_and_fill_the_cache(spark, mixed, no_docs, tmp_path):
    coder = tokenizers.Tokenizer.from_file(WORDS)
    df = spark.createDataFrame(mixed, "doc_id long, text string")
    cache = f"file://{tmp_path}/cache"
    want = sorted((str(i), len((t or "").encode()), n := len(coder.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in mixed)
    assert sorted((str(r[0]), *r[1:]) for r in rows(token_counts.token_counts(df, WORDS, cache))) == want
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == stored.select("digest").distinct().count()
    assert sorted((str(r[0]), *r[1:]) for r in rows(token_counts.token_counts(df, WORDS, cache))) == want
    assert spark.read.parquet(cache).count() == n  # all hits: nothing was encoded again
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    other = rows(token_counts.token_counts(df.limit(300), PIECES, cache))
    assert {r[0]: r[2] for r in other if r[0]} == {i: len(pieces.encode(t or "")) for i, t in mixed[:300] if i}
    assert rows(token_counts.token_counts(no_docs, WORDS)) == []


def test_repeated_rows_are_encoded_and_stored_once(spark, tmp_path, monkeypatch):
    docs = [(5, "hello world")] * 3 + [(6, "hello  world"), (7, "x"), (None, None), (None, None)]
    for few in (0, 100_000):
        monkeypatch.setattr(token_counts, "FEW", few)
        cache = f"file://{tmp_path}/repeats-{few}"
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = rows(token_counts.token_counts(df, WORDS, cache))
        assert sorted(str(r[0]) for r in got) == sorted(str(i) for i, _ in docs)
        assert spark.read.parquet(cache).count() == 3


def test_only_texts_that_count_alike_share_a_digest():
    assert token_counts.drops_spaces(WORDS)
    assert not token_counts.drops_spaces(PIECES) and not token_counts.drops_spaces(tokenizer_path("byte_bpe_50k.json"))


def test_word_table_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE", 20)
    counter, coder = token_counts.Counter(WORDS), tokenizers.Tokenizer.from_file(WORDS)
    r = random.Random(8)
    for _ in range(200):
        text = " ".join(r.choice(BITS) + r.choice("xyz.,") for _ in range(30))
        assert counter.count(text.encode()) == len(coder.encode(text, add_special_tokens=False).ids)


# ---- toxicity


def toxic_texts(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(400)]
    out = []
    for i in range(n):
        y = i % 4 == 0
        own = [r.choice(words) for _ in range(r.randint(20, 80))]
        for _ in range(r.randint(1, 9) if y else 0):
            own.insert(r.randint(0, len(own)), r.choice(["Zgrumpf", "zgrumpfen", "quorx!", "blavvy"]))
        out.append((" ".join(own), int(y)))
    return out


def test_toxicity_on_held_out_texts():
    model = toxicity.fit(toxic_texts(400, 1)[:300])
    score = model.scorer()
    held = toxic_texts(400, 1)[300:]
    assert all((score(t)[1] > 0) == bool(y) for t, y in held)
    assert list(model.cuts) == sorted(model.cuts)
    few, many = score("la lo blavvy ne")[0], score("blavvy quorx blavvy zgrumpf quorx blavvy quorx zgrumpf")[0]
    assert 0 < few < many <= 3
    assert score("")[1] == 0


def naive_score(model, text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    x = 0.0
    for f, w in model.weights.items():
        n = sum((word == f) or (f.endswith("*") and len(word) > 4 and word[:4] == f[:-1]) for word in words)
        x += w * (1 + math.log(n)) if n else 0
    above = [1 / (1 + math.exp(c - x)) for c in model.cuts]
    return sum(above), sum(p >= 0.5 for p in above)


def naive_loss(d, weights, cuts):
    """Negative log likelihood of the grades per row, with the ridge, in plain Python."""
    x = [0.0] * len(d.grade)
    for i, k, v in zip(d.row, d.feature, d.value):
        x[i] += v * weights[k]
    total = 0.0
    for xi, g in zip(x, d.grade):
        for k, c in enumerate(cuts):
            z = xi - c if g > k else c - xi
            total += math.log1p(math.exp(-z)) if z > -30 else -z
    return total / len(x) + toxicity.RIDGE / 2 * sum(w * w for w in weights)


def test_toxicity_fit_is_near_its_optimum_and_scores_agree_with_brute_force():
    for texts in (toxic_texts(200, 5), [(t, y * (1 + i % 3)) for i, (t, y) in enumerate(toxic_texts(200, 6))]):
        d, model = toxicity.design(texts), toxicity.fit(texts, rounds=4000)
        weights = [model.weights.get(f, 0.0) for f in d.names]
        best = naive_loss(d, weights, model.cuts)
        r = random.Random(1)
        for _ in range(40):
            size = r.choice([0.3, 0.1, 0.03])
            other = [max(0.0, w + r.gauss(0, size)) for w in weights]
            cuts = sorted(c + r.gauss(0, size) for c in model.cuts)
            assert naive_loss(d, other, cuts) >= best - 2e-3
        for t, _ in texts[:60]:
            s, g = model.scorer()(t)
            ns, ng = naive_score(model, t)
            assert abs(s - ns) < 1e-9 and g == ng


def test_toxicity_query_against_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_table(docs, labels)
    got = {r["doc_id"]: (r["expected_severity"], r["grade"], r["toxic"]) for r in queries.op6_toxicity(spark, sf_dir).collect()}
    want = {r["doc_id"]: naive_score(model, r["text"] or "") for r in docs.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i][0] - s) < 1e-9 and got[i][1] == g and got[i][2] == (g > 0) for i, (s, g) in want.items())


def test_toxicity_without_both_classes_finds_nothing():
    assert toxicity.fit([]).scorer()("blavvy")[1] == 0
    assert toxicity.fit([("blavvy", 1)] * 5).scorer()("blavvy")[1] == 0


def test_toxicity_tables(spark, odd_docs, no_docs):
    texts = toxic_texts(300, 3)
    docs = spark.createDataFrame([(100 + i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, 1, y) for i, (_, y) in enumerate(texts)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_table(docs, labels)
    found, toxic = {r[0] for r in rows(toxicity.severity(docs, model)) if r[3]}, {100 + i for i, (_, y) in enumerate(texts) if y}
    assert found <= toxic and len(found) >= 0.9 * len(toxic)
    assert len(rows(toxicity.severity(odd_docs, model))) == odd_docs.count()
    assert rows(toxicity.severity(no_docs, model)) == [] and toxicity.drop_toxic(no_docs, model).count() == 0
    kept = toxicity.drop_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert toxicity.drop_toxic(docs, model).count() == len(texts) - len(found)


# ---- personal data


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])


def test_feistel_is_a_permutation(spark):
    df = spark.range(7 * 11).select(pii.feistel(F.col("id") % 7, F.floor(F.col("id") / 7), 7, 11, F.lit("k")).alias("z"), "id")
    back = pii.feistel(F.col("z.x"), F.col("z.y"), 7, 11, F.lit("k"), back=True)
    got = df.select("z.x", "z.y", "id", back.alias("b")).collect()
    assert len({(r.x, r.y) for r in got}) == 77 and all(0 <= r.x < 7 and 0 <= r.y < 11 for r in got)
    assert all((r.b.x, r.b.y) == (r.id % 7, r.id // 7) for r in got)


SAMPLES = {
    "card": (["4111111111111111", "4111 1111 1111 1111", "378282246310005"], lambda s: luhn(s) % 10 == 0),
    "phone": (["+1 (229) 555-4838", "(229) 555-4838", "229-555-4838"], lambda s: re.search(r"[2-9]\d\d\)?[ -]\s?[2-9]\d\d-\d{4}$", s)),
    "ip": (["26.214.230.87", "0.0.0.0", "255.255.255.255"], lambda s: all(0 <= int(x) < 256 for x in s.split("."))),
    "ssn": (["123-45-6789", "001-01-0001", "899-99-9999"], lambda s: re.fullmatch(pii.KINDS["ssn"], s)),
    "date": (["1999-12-31", "1800-01-01", "29/02/2024", "01.03.2021"], lambda s: True),
    "email": (["mosna.88@mail1.example.com", "A.b-C@x.org"], lambda s: "@" in s),
}


def test_pseudonyms_keep_format_and_link(spark, no_docs):
    values = [(k, v) for k, (vs, _) in SAMPLES.items() for v in vs]
    docs = [(i, f"see {v}, and again {v}.") for i, (_, v) in enumerate(values)] + [(100 + i, f"only {v}") for i, (_, v) in enumerate(values)]
    got = {r["doc_id"]: r for r in pii.mask(spark.createDataFrame(docs, "doc_id long, text string"), KEY).collect()}
    for i, (kind, v) in enumerate(values):
        new = got[i]["found"][0]["pseudonym"]
        assert [f["kind"] for f in got[i]["found"]] == [kind, kind]
        assert got[i]["text"] == f"see {new}, and again {new}." and got[100 + i]["text"] == f"only {new}"
        assert new != v and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", v) or kind in ("ip", "email", "date")
        assert SAMPLES[kind][1](new)
    back = pii.mask(spark.createDataFrame([(i, r["text"]) for i, r in got.items()], "doc_id long, text string"), KEY, back=True)
    assert dict(docs) == {r["doc_id"]: r["text"] for r in back.collect()}
    other = pii.mask(spark.createDataFrame(docs, "doc_id long, text string"), key="another").collect()
    assert all(r["text"] != got[r["doc_id"]]["text"] for r in other)
    assert rows(pii.mask(no_docs, KEY)) == []


def test_clean_texts_stay(spark, odd_docs):
    clean = ["4111111111111112 no check digit", "2023-02-30 no day", "256.1.1.1", "v1.2.3.4.5", "12345", "call 555", "a@b", "user@", "000-12-3456", "https://x.org/2024-01-01/", "1" * 25, "", None]
    df = spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string")
    assert {r["doc_id"]: (r["text"], r["n_private"]) for r in pii.mask(df, KEY).collect()} == {i: (t, 0) for i, t in enumerate(clean)}
    assert {(r[0], r[1]) for r in rows(pii.mask(odd_docs, KEY))} == {(r["doc_id"], r["text"]) for r in odd_docs.collect()}


def test_phones_of_any_area_and_dates_with_the_month_first(spark):
    phones = ["+1 (017) 555-7713", "+1 (132) 555-1352", "+1 (171) 555-2028", "017-555-7713", "(229) 155-4838", "1-017.055.0001"]
    dates = ["03/25/2020", "12.31.1999", "02/29/2024", "01/13/1800", "12/31/2199"]
    clean = ["13/13/2020", "02/30/2023", "02/29/2023"]
    docs = list(enumerate(f"at {v}, then {v}." for v in phones + dates + clean))
    got = {r["doc_id"]: r for r in pii.mask(spark.createDataFrame(docs, "doc_id long, text string"), KEY).collect()}
    for i, v in enumerate(phones + dates):
        kind, new = "phone" if i < len(phones) else "date", got[i]["found"][0]["pseudonym"]
        assert [f["kind"] for f in got[i]["found"]] == [kind, kind] and got[i]["text"] == f"at {new}, then {new}."
        assert new != v and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", v)
        assert kind == "phone" or 1 <= int(new[:2]) <= 12 < int(new[3:5])
    assert all(got[len(phones + dates) + i]["n_private"] == 0 for i in range(len(clean)))
    back = pii.mask(spark.createDataFrame([(i, r["text"]) for i, r in got.items()], "doc_id long, text string"), KEY, back=True)
    assert dict(docs) == {r["doc_id"]: r["text"] for r in back.collect()}


def test_days_after_the_twelfth_have_ranks(spark):
    n = pii.LATE_DAYS[0] * pii.LATE_DAYS[1]
    day = pii._late_day(F.col("id"))
    got = spark.range(n).select("id", day.alias("day")).select(F.count_distinct("day"), F.min(F.day("day")), F.min("day").cast("string"), F.max("day").cast("string"), F.sum((pii._late_rank(F.col("day")) == F.col("id")).cast("int")))
    assert tuple(got.first()) == (n, 13, "1800-01-13", "2199-12-31", n)


# Detection and pseudonyms again, in plain Python: a scanner over characters, and the network on integers.

WORD = re.compile(r"\w", re.ASCII)


def near(text, i, chars):
    return 0 <= i < len(text) and (WORD.match(text[i]) is not None or text[i] in chars)


def ends(text, i, chars):
    """Whether a match may end before i: no word character or one of ``chars`` follows, nor a stop and a digit where
    ``chars`` has a stop."""
    if near(text, i, chars.replace(".", "")):
        return False
    return not ("." in chars and text[i : i + 1] == "." and text[i + 1 : i + 2].isascii() and text[i + 1 : i + 2].isdigit())


def digits(text, i, n):
    s = text[i : i + n]
    return s if len(s) == n and s.isascii() and s.isdigit() else None


def scan_email(t, i):
    if near(t, i - 1, ".%+-") or not (t[i].isascii() and t[i].isalnum()):
        return None
    j = i + 1
    while j < len(t) and j - i < 1024 and t[j].isascii() and (t[j].isalnum() or t[j] in "._%+-"):
        j += 1
    if t[j : j + 1] != "@":
        return None
    labels, at, best = 0, j + 1, None
    while labels <= 126:
        k = at
        while k < len(t) and t[k].isascii() and (t[k].isalnum() or t[k] == "-"):
            k += 1
        if labels:
            top = at
            while top < len(t) and t[top].isascii() and t[top].isalpha():
                top += 1
            if top - at >= 2 and not near(t, top, "-"):
                best = top
        if k == at or t[k : k + 1] != ".":
            break
        labels, at = labels + 1, k + 1
    return best


def scan_ip(t, i):
    if near(t, i - 1, "."):
        return None

    def part(at, left):
        for n in (3, 2, 1):
            d = digits(t, at, n)
            if d and int(d) < 256 and not (n == 3 and d[0] == "0"):
                if left == 0:
                    if ends(t, at + n, "."):
                        return at + n
                elif t[at + n : at + n + 1] == "." and (e := part(at + n + 1, left - 1)):
                    return e
        return None

    return part(i, 3)


def scan_phone(t, i):
    if near(t, i - 1, "+"):
        return None
    for p in (t[i:].startswith("+1") and 2, t[i] == "1" and 1, 0):
        if p is False:
            continue
        starts = [i + p + 1] if p and t[i + p : i + p + 1] in (" ", ".", "-") and t[i + p : i + p + 1] else []
        for at in [*starts, i + p]:
            heads = []
            if t[at : at + 1] == "(" and digits(t, at + 1, 3) and t[at + 4 : at + 5] == ")":
                heads = [at + 6] if t[at + 5 : at + 6] == " " else []
                heads.append(at + 5)
            elif digits(t, at, 3) and t[at + 3 : at + 4] in (" ", ".", "-") and t[at + 3 : at + 4]:
                heads = [at + 4]
            for h in heads:
                if digits(t, h, 3) and t[h + 3 : h + 4] and t[h + 3] in " .-" and digits(t, h + 4, 4) and ends(t, h + 8, "-."):
                    return h + 8
    return None


def scan_ssn(t, i):
    a, b, c = digits(t, i, 3), digits(t, i + 4, 2), digits(t, i + 7, 4)
    if near(t, i - 1, "-") or not (a and b and c) or t[i + 3] != "-" or t[i + 6] != "-":
        return None
    return i + 11 if a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000" and not near(t, i + 11, "-") else None


def scan_date(t, i):
    if near(t, i - 1, "/.-"):
        return None
    if digits(t, i, 4) and t[i + 4 : i + 5] == "-" and digits(t, i + 5, 2) and t[i + 7 : i + 8] == "-" and digits(t, i + 8, 2) and ends(t, i + 10, "/-."):
        return i + 10
    for mark in "/.":
        for n in (2, 1):
            for m in (2, 1):
                j = i + n + 1 + m
                if digits(t, i, n) and t[i + n : i + n + 1] == mark and digits(t, i + n + 1, m) and t[j : j + 1] == mark and digits(t, j + 1, 4) and ends(t, j + 5, "/-."):
                    return j + 5
    return None


def scan_card(t, i):
    if near(t, i - 1, "-"):
        return None
    if digits(t, i, 4) and all(t[i + 5 * k - 1 : i + 5 * k] in (" ", "-") and digits(t, i + 5 * k, 4) for k in (1, 2)) and t[i + 14 : i + 15] in (" ", "-") and t[i + 14 : i + 15]:
        for n in range(7, 0, -1):
            if digits(t, i + 15, n) and not near(t, i + 15 + n, "-"):
                return i + 15 + n
    for n in range(19, 12, -1):
        if digits(t, i, n) and not near(t, i + n, "-"):
            return i + n
    return None


def day_of(s):
    p = [int(x) for x in re.split(r"[-/.]", s)]
    for y, m, d in [p] if s[4] == "-" else [p[::-1], (p[2], p[0], p[1])]:
        try:
            day = datetime.date(y, m, d)
        except ValueError:
            continue
        return day if 1800 <= day.year <= 2199 else None
    return None


SCANS = {"email": scan_email, "ip": scan_ip, "phone": scan_phone, "ssn": scan_ssn, "date": scan_date, "card": scan_card}


def brute_found(text):
    """(kind or None, place, match) from left to right; kinds in order at each place. Matches that don't validate use up their text."""
    out, i = [], 0
    while i < len(text or ""):
        for kind, scan in SCANS.items():
            if end := scan(text, i):
                s = text[i:end]
                ok = day_of(s) is not None if kind == "date" else luhn(s) % 10 == 0 and s.strip("0 -") != "" if kind == "card" else True
                out.append((kind if ok else None, i, s))
                i = end
                break
        else:
            i += 1
    return out


def brute_feistel(x, y, a, b, key):
    for r in range(pii.ROUNDS):
        h = lambda v: int(hashlib.sha256(f"{key}|{r}|{v}".encode()).hexdigest()[:15], 16)
        x, y = ((x + h(y)) % a, y) if r % 2 == 0 else (x, (y + h(x)) % b)
    return x, y


def brute_pseudonym(s, kind, key):
    d = re.sub(r"\D", "", s)
    if kind == "ip":
        o = [int(v) for v in s.split(".")]
        x, y = brute_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key + kind)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if kind == "ssn":
        a = int(d[:3])
        x, y = brute_feistel(a - 1 - (a > 666), (int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1, 898, 99 * 9999, key + kind)
        return f"{x + 1 + (x >= 665):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    if kind == "phone":
        area, exchange, line = int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
        low, size = [0 if v < 200 else 200 for v in (area, exchange)], [200 if v < 200 else 800 for v in (area, exchange)]
        x, y = brute_feistel(area - low[0], (exchange - low[1]) * 10_000 + line, size[0], size[1] * 10_000, key + kind)
        new = f"{d[:-10]}{x + low[0]:03d}{y // 10_000 + low[1]:03d}{y % 10_000:04d}"
    elif kind == "card":
        body = d[:-1]
        half = len(body) // 2
        x, y = brute_feistel(int(body[:half]), int(body[half:]), 10**half, 10 ** (len(body) - half), f"{key}{kind}{len(body)}")
        new = f"{x:0{half}d}{y:0{len(body) - half}d}"
        new += str(-luhn(new + "0") % 10)
    else:
        return None
    at = iter(new)
    return "".join(next(at) if c.isdigit() else c for c in s)


def test_detection_and_pseudonyms_against_brute_force(spark, sf_dir):
    bits = [v for vs, _ in SAMPLES.values() for v in vs] + ["03/25/2020", "30.02.2020", "x", " ", ", ", ".", "-", "/", "@", "1", "12", "+1 ", "(555) ", "é", "a.b@c.de.fg", "b@x.com.5", "\n", "0000000000000", "4111-1111-1111-1111", "a@b..co", "c@d.e"]
    r = random.Random(12)
    docs = [(10**6 + i, "".join(r.choice(bits) for _ in range(r.randint(1, 6)))) for i in range(1500)]
    docs += [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {x["doc_id"]: x for x in pii.mask(spark.createDataFrame(docs, "doc_id long, text string"), KEY).collect()}
    seen = set()
    for i, t in docs:
        want = brute_found(t)
        assert [f["kind"] for f in got[i]["found"]] == [k for k, _, _ in want if k], t
        shift, text = 0, t or ""
        found = iter(got[i]["found"])
        for kind, at, s in want:
            new = next(found)["pseudonym"] if kind else s
            if kind in ("ip", "ssn", "phone", "card"):
                assert new == brute_pseudonym(s, kind, KEY)
            seen.add(kind)
            at += shift
            text, shift = text[:at] + new + text[at + len(s) :], shift + len(new) - len(s)
        assert got[i]["text"] == (text if t is not None else None)
    assert seen == {*SCANS, None}


def test_hostile_texts_end_well(spark):
    n = 100_000
    hostile = ["x a@" + "b." * n + "com y", "a@" + "b-" * n, "1" * n, "a" * n + "@x.org", "a@" + "x." * n, "1.2.3." * n, "4111 " * n, "(555) " * n, "a." * n + "@b.org", "@" * n, "12/" * n]
    got = {r["doc_id"]: r["text"] for r in pii.mask(spark.createDataFrame(list(enumerate(hostile)), "doc_id long, text string"), KEY).collect()}
    assert got == dict(enumerate(hostile))


def test_addresses_with_long_names(spark):
    """Names beyond what mail allows are masked too, in their own shape."""
    own = ["a" * 65 + "@x.com", "b." * 500 + "c@b.org", "d" * 1024 + "@x.com", "e" * 1025 + "@x.com"]
    got = [r["text"] for r in pii.mask(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    for old, new in zip(own[:3], got):
        assert new != old and len(new) == len(old) and [c == "." for c in new] == [c == "." for c in old] and new.partition("@")[1:] == old.partition("@")[1:]
    assert got[3] == own[3]

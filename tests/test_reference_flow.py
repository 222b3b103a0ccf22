"""A small catalog end to end, votes and clusters with ties, and the streaming entry points."""

import random

from citeflow.operators import fuse, lookup
from citeflow.plans import resolve
from citeflow.streaming import online
from pyspark.sql import functions as F

CATALOG = "source string, cand_key string, title string, authors array<string>, journal_name string, volume string, pages string, year string, doi string, arxiv_id string, cr_type string, oa_is_proceedings boolean, s2_types array<string>"


def catalog(spark):
    rows = [
        ("crossref", "c1", "Deep graphs for tables", ["Ada Lovelace", "Bob Roe"], "Journal of Tables", "3", "10-19", "2020", "10.1234/dg", None, "journal-article", None, None),
        ("openalex", "o1", "Deep graphs for tables", ["A. Lovelace", "B. Roe"], "Journal of Tables", "3", "10", "2020", "10.1234/dg", None, None, False, None),
        ("crossref", "c2", "An unrelated work on birds", ["Cy Dee"], "Birds", "1", "1-2", "1999", "10.1234/bd", None, "journal-article", None, None),
    ]
    df = spark.createDataFrame(rows, CATALOG)
    return fuse.with_fields(df).withColumn("doi_key", F.lower("doi"))


def test_resolve(spark):
    """End to end, with a row that failed before, recorded outputs of every stage, and a catalog of journals."""
    refs = [
        ("d", 1, "r1", 'A. Lovelace and B. Roe, "Deep graphs for tables," *J. Tables*, vol. 3, pp. 10, 2020. doi:10.1234/dg', None),
        ("d", 2, "r2", "   ", None),
        ("d", 3, "r3", 'X. Nobody, "Nothing like it at all," 2001.', None),
        ("d", 4, "r4", "broken", "ValueError: not a zip"),
        ("d", 5, "r5", "Just a sentence.", None),
        ("d", 6, "r6", 'X. Nobody, "Nothing like it at all," 2001.', None),
    ]
    df = spark.createDataFrame(refs, "doc_id string, pos int, ref_id string, reference string, error string")
    told = [
        ("r5", "validate", 0, 'Sure: {"is_reference": false}'), ("r3", "type", 0, '{"type": "Book"}'), ("r3", "parse", 0, 'Here: {"publisher": "Press", "unknown": 1} done'),
        ("r3", "format", 0, 'X. Nobody,  "Nothing like it at all" , pp. 1, 5, 2001'), ("r1", "correct", 1, '{"location": "Oslo", "title": "Patched"}'),
    ]
    outputs = spark.createDataFrame(told, "ref_id string, stage string, round int, raw string")
    journals = spark.createDataFrame([("journal of tables", "J. Tabl.")], "name_norm string, iso_abbrev string")
    got = {r["ref_id"]: r for r in resolve.resolve(df, catalog(spark), max_rounds=1, outputs=outputs, journals=journals).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"r1": "success", "r2": "skipped", "r3": "success", "r4": "error", "r5": "skipped", "r6": "success"}
    assert got["r2"]["formatted"].strip() == "" and got["r4"]["formatted"] == "broken [ERROR]" and got["r4"]["error"] == "ValueError: not a zip"
    one = got["r1"]
    assert one["type"] == "journal article" and "Deep graphs for tables" in one["formatted"] and "10–19" in one["formatted"] and "https://doi.org/10.1234/dg" in one["formatted"]
    assert "*J. Tabl.*" in one["formatted"] and "NLM Catalog ISO Abbrev: J. Tabl." in one["report"] and "location: MISSING → Oslo" in one["report"]
    three = got["r3"]
    assert three["type"] == "book" and "Trusted online match: No" in three["report"] and "publisher = {Press}" in three["bibtex"]
    assert three["format_source"] == "model" and three["formatted"] == 'X. Nobody, "Nothing like it at all", pp. 1–5, 2001.'
    assert got["r6"]["formatted"] == three["formatted"] and one["format_source"] == "rules"


def test_lookup_by_title_equals_brute_force(spark):
    """Every pair of the similarity, whatever its words' frequencies; stop words alone bring none together."""
    r = random.Random(3)
    words = ["the", "of", "a"] * 6 + [f"w{i}" for i in range(30)]
    title = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 9)))
    left, right = [(i, title()) for i in range(60)], [(f"c{i}", title()) for i in range(80)]
    right += [("x1", "alpha beta carbon delta epsilon foxtrots"), *((f"y{i}", f"alpha beta carbon other{i} more{i}") for i in range(20))]
    left += [(100, "alpha beta carbon delta epsilon foxtrot"), (101, ""), (102, None)]
    refs = spark.createDataFrame(left, "ref_id int, title string")
    works = spark.createDataFrame([(k, t, "crossref", None) for k, t in right], "cand_key string, title string, source string, doi_key string")
    for at_least in (0.3, 0.5, 0.8, 1.0):
        got = {(x["ref_id"], x["cand_key"]): x["sim"] for x in lookup.by_title(refs, works, at_least, k=1000).where("variant = 0").collect()}
        want = {}
        for i, t in left:
            for k, u in right:
                a, b = set((t or "").split()), set(u.split())
                if a and b and len(a & b) / len(a | b) >= at_least - 1e-9:
                    want[i, k] = round(len(a & b) / len(a | b), 6)
        assert got == want
    near = lookup.by_title(refs.where("ref_id = 100"), works, 0.9, mode="token_sort").collect()
    assert [x["cand_key"] for x in near] == ["x1"]


def test_lookup_by_sorted_words_equals_brute_force(spark):
    """Every pair of the similarity, at every level of grams: typos in most words, short and long titles, repeated words,
    letters beyond the basic plane, titles of one letter, blank ones."""
    from citeflow.functions.similarity import common_subsequence

    r = random.Random(5)
    letters = "aeinorst"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    title = lambda n: " ".join(word() for _ in range(n))

    def typos(s: str, share: float) -> str:
        out = []
        for c in s:
            x = r.random()
            out.append("" if x < share / 2 else c + r.choice(letters) if x < share else c)
        return "".join(out)

    base = [title(r.choice((1, 2, 4, 8, 20))) for _ in range(70)] + ["a", "b", "", " ", "a a a b", "𝔸𝔹ℂ𝔻 ééé", "ab " * 120]
    left = [(i, t) for i, t in enumerate(base)] + [(len(base), None)]
    right = [(f"c{i}", typos(r.choice(base), r.choice((0, 0.05, 0.1, 0.2, 0.4)))) for i in range(150)] + [(f"d{i}", t) for i, t in enumerate(base)]
    refs = spark.createDataFrame(left, "ref_id int, title string")
    works = spark.createDataFrame([(k, t, "crossref", None) for k, t in right], "cand_key string, title string, source string, doi_key string")
    line = lambda s: " ".join(sorted((s or "").split()))
    for at_least in (0.6, 0.75, 0.85, 0.95, 1.0):
        got = {(x["ref_id"], x["cand_key"]): x["sim"] for x in lookup.by_title(refs, works, at_least, k=1000, mode="token_sort", variants=False).collect()}
        want = {}
        for i, t in left:
            for k, u in right:
                a, b = line(t), line(u)
                sim = 2 * common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0
                if sim >= at_least - 1e-9:
                    want[i, k] = round(sim, 6)
        assert got == want and len(want) > 70


def test_votes_go_to_the_first_seen(spark):
    rows = [(1, 1, "arxiv", "B"), (1, 2, "pubmed", "A"), (1, 3, "other", "B"), (1, 4, "other", None)]
    df = fuse.with_fields(spark.createDataFrame(rows, "ref_id int, cand_ord int, source string, title string"))
    votes = {r["field"]: (r["value"], float(r["weight"]), r["source"]) for r in fuse.vote_fields(df, ["ref_id"]).collect()}
    assert votes == {"title": ("B", 0.6, "arxiv")}
    tie = fuse.with_fields(spark.createDataFrame([(1, 2, "crossref", "B"), (1, 1, "crossref", "A")], "ref_id int, cand_ord int, source string, title string"))
    assert fuse.vote_fields(tie, ["ref_id"]).first()["value"] == "A"


def test_clusters_agree_in_both_forms(spark):
    rows = [(1, i, t) for i, t in enumerate(["red small ring", "Ring, small red!", "blue ring", "", "", "red small rings"], 1)]
    df = spark.createDataFrame(rows, "ref_id int, cand_ord int, title string")
    got = {r["cand_ord"]: r["cluster"] for r in fuse.cluster_titles(df).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5}
    sorted_form = {r["cand_ord"]: r["cluster"] for r in fuse.cluster_titles(df, "token_sort").collect()}
    assert sorted_form == {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 1}  # one letter more is similar enough there


def test_dedup_keeps_first_place_and_last_values(spark):
    rows = [(1, 1, "crossref", "10.1/A", "old"), (1, 2, "crossref", None, "t"), (1, 3, "crossref", "10.1/a", "new")]
    df = spark.createDataFrame(rows, "ref_id int, cand_ord int, source string, doi string, title string")
    assert sorted((r["cand_ord"], r["title"]) for r in lookup.dedup(df).collect()) == [(1, "new"), (2, "t")]


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "h1", "a"), ("2024-01-01 00:10:00", "h1", "b"), ("2024-01-01 00:20:00", "h2", "c")]
    static = spark.createDataFrame(rows, "ts string, ref_hash string, raw string").select(F.col("ts").cast("timestamp").alias("ts"), "ref_hash", "raw")
    static.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(static.schema).parquet(f"{tmp_path}/in")
    q = online.resolve_stream(online.drop_repeats(stream), lambda b: b.withColumn("done", F.upper("raw")), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(90)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["ref_hash"] for r in got) == ["h1", "h2"] and all(r["done"] for r in got)
    batch = online.drop_repeats_batch(static.withColumn("request_id", F.col("raw")))
    assert sorted(r["raw"] for r in batch.collect()) == ["a", "c"]


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "ref_hash string")
    sink = f"{tmp_path}/out"
    online.commit(rows("a", "b"), 0, sink)
    online.commit(rows("c"), 1, sink)
    online.commit(rows("a", "b"), 0, sink)
    assert sorted((r["ref_hash"], r["batch_id"]) for r in spark.read.parquet(sink).collect()) == [("a", 0), ("b", 0), ("c", 1)]


def test_sources_told_by_audit(spark):
    """A field without provenance is told by its change: the last best record that set it, else the first change."""
    from citeflow.operators import render
    from citeflow.schemas import CHANGE, FIELDS, RECORD

    changes = [(1, "suggestion", "title", "a", "b", "verify/llm"), (1, "best", "volume", None, "3", "crossref"), (2, "best", "volume", "3", "4", "pubmed"), (2, "normalize", "month", "Mar", "3", "normalize")]
    record = {"title": "b", "volume": "4", "month": "3", "issue": "9", "journal_abbrev": "J."}
    df = spark.createDataFrame([(changes, record, None, {"issue": "openalex"})], f"changes {CHANGE}, ex {RECORD}, best {RECORD}, p map<string,string>")
    c = F.col
    got = df.select(render.correction_lines(c("changes"), c("p")).alias("a"), render.provenance_lines(c("ex"), c("best"), c("p"), c("changes"), F.lit("Jrnl.")).alias("b")).first()
    assert got["a"].split("\n") == ["- title: a → b  (by: LLM suggestion)", "- volume: MISSING → 3  (by: PubMed)", "- volume: 3 → 4  (by: PubMed)", "- month: Mar → 3  (by: Normalization)"]
    want = {"title": ("b", "LLM suggestion"), "journal_abbrev": ("J.", "Unknown"), "verified_journal_abbrev": ("Jrnl.", "Unknown"), "volume": ("4", "PubMed"), "issue": ("9", "OpenAlex"), "month": ("3", "Normalization")}
    order = [f for x in FIELDS for f in ([x, "verified_journal_abbrev"] if x == "journal_abbrev" else [x]) if f in want]
    assert got["b"].split("\n") == [f"- {f}: {want[f][0]}  (source: {want[f][1]})" for f in order]


def test_repeats_are_answered_from_earlier_batches(spark, tmp_path):
    """Repeats within an hour get the stored result, one after it is resolved anew, and a replayed batch changes nothing."""
    import json

    hour = lambda h, m=0: f"2024-01-01T{h:02}:{m:02}:00"
    batches = [
        [(1, hour(1), "a"), (2, hour(1, 5), "b"), (3, hour(1, 6), "a"), (4, hour(1, 7), None), (5, hour(1, 7), None)],
        [(6, hour(1, 30), "a"), (7, hour(2, 6), "b"), (8, hour(1, 59), "a")],
        [(9, hour(2, 10), "a"), (10, hour(2, 50), "b")],
    ]
    source, sink, calls = tmp_path / "in", f"{tmp_path}/out", []
    source.mkdir()

    def resolve(rows):
        calls.append(sorted(r["request_id"] for r in rows.collect()))
        return rows.select("request_id", F.concat(F.lit("by "), F.col("request_id").cast("string")).alias("result"))

    stream = spark.readStream.schema("request_id long, ts timestamp, ref_hash string").json(str(source))
    for n, rows in enumerate(batches):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("request_id", "ts", "ref_hash"), r))) for r in rows))
        online.answer_stream(stream, resolve, sink, f"{tmp_path}/cp").awaitTermination(60)
    want = {1: ("by 1", False), 2: ("by 2", False), 3: ("by 1", False), 4: ("by 4", False), 5: ("by 5", False), 6: ("by 1", True), 7: ("by 7", False), 8: ("by 1", True), 9: ("by 9", False), 10: ("by 7", True)}
    answers = lambda: {r["request_id"]: (r["result"], r["cached"]) for r in spark.read.parquet(sink).collect()}
    assert answers() == want and calls == [[1, 2, 4, 5], [7], [9]]
    rows = spark.createDataFrame([(r[0], r[1], r[2]) for r in batches[1]], "request_id long, ts string, ref_hash string").withColumn("ts", F.col("ts").cast("timestamp"))
    earlier = spark.read.parquet(sink).where("batch_id < 1 and not cached")
    online.commit(online.answered(rows, earlier, resolve), 1, sink)
    assert answers() == want and spark.read.parquet(sink).count() == 10


def test_sets_meet_only_where_enough_words_are_left(spark):
    """All pairs of the wanted similarity meet; two sets whose only shared word leaves too few after it don't."""
    import itertools
    import random

    from citeflow.operators.lookup import similar_sets

    rng = random.Random(5)
    sets = {frozenset(rng.choices("abcdefghijklmnopqrst", [1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7, 8, 9, 9, 9, 9, 9], k=rng.randint(1, 12))) for _ in range(300)}
    df = spark.createDataFrame([(" ".join(sorted(s)), sorted(s)) for s in sets], "line string, words array<string>")
    for t in (0.3, 0.5, 0.8, 1.0):
        rows = [(frozenset(r["a"].split()), frozenset(r["b"].split())) for r in similar_sets(df, df, t).collect()]
        assert len(rows) == len(set(rows))
        assert {(x, y) for x, y in itertools.product(sets, sets) if len(x & y) >= t * len(x | y)} <= set(rows)
    one, two = [f"a{i}" for i in range(5)] + ["z"] + [f"zz{i}" for i in range(4)], [f"b{i}" for i in range(5)] + ["z"] + [f"zy{i}" for i in range(4)]
    a, b = (spark.createDataFrame([(" ".join(x), x)], "line string, words array<string>") for x in (one, two))
    assert similar_sets(a, b, 0.5).count() == 0


def test_payloads_of_several_sources_are_read_in_one_pass(spark, sf_dir):
    """As each source alone, with one scan and one numbering of the candidates, and unknown sources dropped."""
    from citeflow.plans import queries
    from citeflow.sources import catalogs

    rows = [
        ("crossref", '{"title":["A"],"DOI":"10.1/X","author":[{"given":"J","family":"Doe"}]}'), ("openalex", '{"display_name":"B","biblio":{"first_page":"1","last_page":"2"}}'), ("pubmed", "{}"),
        ("arxiv", '{"title":"C","published":"2020-01-01"}'), ("ieeexplore", '{"title":"D","start_page":"3"}'), ("semanticscholar", "no json"), ("unknown", '{"title":"E"}'), (None, '{"title":"F"}'),
    ]
    df = spark.createDataFrame(rows, "source string, payload string")
    got = catalogs.from_mixed_json(df, "payload")
    want = [r for s in catalogs.SOURCES_BY_NAME for r in catalogs.from_json_column(df.where(f"source = '{s}'"), "payload", s).select(*got.columns).collect()]
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == 4
    plan = queries.normalised_catalogs(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") <= 1 and plan.count("Window [row_number()") == 1


def test_title_similarity_reads_titles_only(spark, sf_dir):
    from citeflow.plans import queries

    plan = queries.title_token_sort(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "p_name:" in plan and "p_brand:" not in plan and "c_mktsegment:" not in plan


def test_sorted_words_meet_in_blocks_of_any_size(spark):
    """Small blocks give the pairs of one block, each once; pairs are told by ids, and no row of a gram leaves a task."""
    import random

    from citeflow.functions.similarity import common_subsequence
    from citeflow.operators.alike import alike_lines

    r = random.Random(9)
    base = {" ".join(sorted("".join(r.choices("aeinorst", k=r.randint(1, 9))) for _ in range(r.choice((1, 3, 12, 50))))) for _ in range(60)}
    lines = sorted(base | {s[:i] + r.choice("xyz") + s[i + 1 :] for s in base for i in (len(s) // 2, len(s) - 1)})
    df = spark.createDataFrame([(s,) for s in lines], "line string")
    name = {bytes(x["id"]): x["line"] for x in df.selectExpr("line", "unhex(md5(line)) AS id").collect()}
    want = {(a, b) for a in lines for b in lines if 2 * common_subsequence(a, b) >= (0.9 - 1e-9) * (len(a) + len(b))}
    for chars in (300, 10**6):
        found = alike_lines(df, df, 0.9, chars)
        rows = [(name[bytes(x["a"])], name[bytes(x["b"])]) for x in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert "gram" not in found._jdf.queryExecution().executedPlan().toString()

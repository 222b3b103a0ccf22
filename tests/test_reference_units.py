"""Hand-worked cases of the scalar functions, segmentation and recorded output."""

import io
import zipfile

from citeflow.functions import scalars as S
from citeflow.functions.similarity import common_subsequence
from citeflow.operators import render, segment
from citeflow.sources import files
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("r")).first()["r"]


def many(spark, cases, f, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], f"i int, x {kind}").select("i", f(F.col("x")).alias("r")).collect()
    got = {r["i"]: r["r"] for r in rows}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_authors(spark):
    cases = [
        ("Ada Lovelace", "A. Lovelace"), ("Lovelace, Ada King", "A. K. Lovelace"), ("Jean-Pierre Serre", "J.-P. Serre"), ("Plato", "Plato"),
        ("Martin Luther King Jr.", "M. L. K. , Jr."), ("King Jr., Martin", "M. King, Jr."), ("", ""), (None, ""), ("j. Doe", "J. Doe"),
    ]
    many(spark, cases, S.format_author)
    names = [f"A{i} Name{i}" for i in range(7)]
    lists = [(names[:0], ""), (names[:1], "A. Name0"), (names[:2], "A. Name0, and A. Name1"), (names[:3], "A. Name0, A. Name1, and A. Name2"), (names, "A. Name0 *et al.*"), (None, "")]
    many(spark, lists, S.format_authors, "array<string>")
    many(spark, [("Doe, J. and Roe, R. and Mary Lee", ["Doe, J.", "Roe, R.", "Mary Lee"]), ("A. B & C. D", ["A. B", "C. D"]), (None, [])], S.author_list)
    many(spark, [("Ada M. Lovelace", "a. m. lovelace"), ("Smith et al.", ""), (None, "")], S.author_key)
    many(spark, [("Ada M. Lovelace", "m. lovelace")], lambda x: S.author_key(x, False))


def test_numbers(spark):
    many(spark, [("5338", 1), ("5338-5346", 2), ("12–12", 0), ("", 0), ("e1234", 1), ("5338—5346", 2), (None, 0)], S.pages_richness)
    many(spark, [("jan", "1"), ("Sept.", "9"), ("07", "7"), ("13", "13"), ("", ""), ("Spring", "Spring"), (None, "")], S.month_number)
    many(spark, [("Nov. 2021", "2021"), ("0021", ""), ("2999", ""), ("x2021", ""), ("1899", "1899"), (None, "")], S.year_of)
    many(spark, [("2021", True), ("0021", False), ("2999", False), ("n.d.", False), (None, False)], lambda y: S.is_plausible_year(y, 2025))
    many(spark, [("10.1/A", "10.1/a"), ("doi:10.1/a.", "10.1/a"), ("HTTPS://doi.org/10.1/a", "10.1/a"), ("", None), (None, None)], S.doi_key)
    many(spark, [("doi:10.1/A", "https://doi.org/10.1/a"), ("http://doi.org/10.1/a", "https://doi.org/10.1/a"), ("", ""), (None, "")], S.doi_link)
    many(spark, [("a_b & {c}\\", "a\\_b \\& \\{c\\}\\textbackslash{}")], S.bibtex_escape)
    many(spark, [("pp. 12, 19 , x .", "pp. 12–19, x.")], S.sanitised)


def test_parse(spark):
    r = one(spark, 'A. One and B. Two, "A title here," *J*, vol. 3, no. 4, pp. 5–9, 2020. doi:10.1234/xy', S.parse_reference)
    assert r["title"] == "A title here," and r["authors"] == ["A. One", "B. Two"]
    assert (r["volume"], r["issue"], r["pages"], r["year"], r["doi"]) == ("3", "4", "5-9", "2020", "10.1234/xy")


def test_segmentation(spark):
    marked = "Intro text\r\n[1] First\ncontinued\n\n2. Second\n- Third"
    block = "A. Author, Title one. 2020.\nB. Writer, Title two. doi 10.1234/ab.\nC. Third, more text."
    cases = [
        (marked, ["Intro text", "First continued", "Second", "Third"]), ("one para\nline\n\n\n\ntwo para", ["one para\nline", "two para"]),
        (block, ["A. Author, Title one. 2020.", "B. Writer, Title two. doi 10.1234/ab.", "C. Third, more text."]), ("just one line", ["just one line"]), (" \n ", []), (None, []),
    ]
    many(spark, cases, segment.references_of)
    many(spark, [("a\n\n b \r\n", 2), ("", 0), (None, 0)], segment.line_count)
    docs = spark.createDataFrame([(1, marked)], "doc_id int, text string")
    assert [r["reference"] for r in segment.split_marked(docs).orderBy("pos").collect()] == ["Intro text", "First continued", "Second", "Third"]


def test_split_as_a_table_function(spark, sf_dir):
    from citeflow.sources.surrogates import bundles

    segment.register(spark)
    odd = [(-1, "Intro text\r\n[1] First\ncontinued\n\n2. Second\n- Third"), (-2, "one para\nline\n\n\n\ntwo para"), (-3, " \n "), (-4, None), (-5, "just one line")]
    docs = bundles(spark, sf_dir).select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    docs.createOrReplaceTempView("bundled")
    got = spark.sql("SELECT doc_id, s.pos, s.reference FROM bundled, LATERAL split_references(text) s").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, segment.split_references(docs).collect())) and got


def test_recorded_output(spark):
    cases = [('{"a": 1}', '{"a": 1}'), ('Sure: {"a": "}"} done', '{"a": "}"}'), ("{bad} then {\"b\": 2}", '{"b": 2}'), ('{"cut": ', None), ("", None), (None, None)]
    many(spark, cases, files.lenient_json)


def test_docx_and_rejects(spark, tmp_path):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(body.getvalue())
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.txt").write_bytes(b"caf\xc3\xa9 \xff!")
    (tmp_path / "d.doc").write_bytes(b"x")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    found = files.read_binary(spark, f"file://{tmp_path}")
    ok, bad = files.route(found)
    assert {r["ext"]: r["reason"] for r in bad.collect()} == {"doc": "Legacy .doc is not supported; save as .docx", "pdf": "Text of .pdf files must be extracted before"} and ok.count() == 3
    docx = {r["path"][-6:]: (r["text"], r["error"] is None) for r in files.read_docx(ok).collect()}
    assert docx == {"a.docx": ("One\nTwo", True), "b.docx": (None, False)}
    assert [r["text"] for r in files.read_texts(ok).collect()] == ["café !"]


def docx(*paragraphs):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:body></w:document>")
    return body.getvalue()


def test_a_folder_of_manuscripts_is_screened(spark, tmp_path):
    from citeflow.operators import screen

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(docx("Body", "References", '[1] A. B, "A bad work on stars"', '[2] C. D, "A good work on birds"'))
    (tmp_path / "b.docx").write_bytes(docx("Bibliography", '1. C. D, "A good work on birds"'))
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    kind = "cand_key string, title string, doi_key string, relation string, update_to array<struct<DOI:string,type:string,source:string,updated:string>>"
    works = spark.createDataFrame([("1", "A bad work on stars", "10.1/a", "is-retracted-by", None), ("2", "A good work on birds", "10.1/b", None, [("10.1/c", "correction", "x", "y")])], kind)
    got = {r["doc_id"][-6:]: (r["n_references"], r["n_retracted"], r["flagged"]) for r in screen.screen_folder(spark, f"file://{tmp_path}", works).collect()}
    assert got == {"a.docx": (2, 1, 'A. B, "A bad work on stars"'), "b.docx": (1, 0, "")}


def test_corpus_dump(spark, tmp_path):
    for path, content in {"a.py": b"x = 1", "skip/b.py": b"y", "c.md": b"z", "d/e.py": b"\xff\xfe"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(content)
    found = files.read_binary(spark, f"file://{tmp_path}")
    got = sorted(r["entry"] for r in files.corpus_dump(found, ["py"], ["skip"]).collect())
    assert got == ["a.py:\nx = 1\n\n", "e.py:\n[BINARY FILE - CONTENT NOT READ]\n\n"]


def test_numbered_lines_are_written_in_ranges(spark, tmp_path):
    from citeflow.operators import sinks

    rows = spark.createDataFrame([(d, p, f"ref {d} {p}") for d in range(30) for p in (3, 1, 2)], "doc_id int, pos int, formatted string")
    sinks.write_numbered(rows, f"file://{tmp_path}/out")
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [f"{d}\t[{n}] ref {d} {n}" for d in range(30) for n in (1, 2, 3)]


def test_similarity_and_types(spark):
    assert common_subsequence("kitten", "sitting") == 4 and common_subsequence("", "a") == 0
    r = spark.createDataFrame([(["A B"], "T", "J", "1", "2", "3-4", "2020", "5", "10.1/x")], "authors array<string>, title string, journal_name string, volume string, issue string, pages string, year string, month string, doi string")
    from citeflow.operators import fuse

    r = fuse.with_fields(r).withColumn("r", fuse.record(fuse.with_fields(r)))
    got = r.select(*[render.format_reference(F.col("r"), F.lit(k)).alias(k.replace(" ", "_")) for k in ("journal article", "conference paper", "preprint", "other")]).first()
    assert got["journal_article"] == 'A. B, "T", *J*, vol. 1, no. 2, pp. 3–4, May 2020, https://doi.org/10.1/x.'
    assert got["conference_paper"] == 'A. B, "T", in *J*, pp. 3–4, May 2020, https://doi.org/10.1/x.'
    assert got["preprint"] == 'A. B, "T", preprint, May 2020, https://doi.org/10.1/x.'
    assert got["other"] == 'A. B, "T", J, May 2020, vol. 1, no. 2, pp. 3–4, https://doi.org/10.1/x.'


def test_a_marked_document_of_very_many_lines(spark):
    """The array form agrees with the window form, in linear time: 100,000 lines."""
    import time

    text = "intro\n" + "\n".join(f"[{i}] work {i}\n more of {i}" for i in range(50_000))
    docs = spark.createDataFrame([(1, text), (2, "a\n\n[1] b\n[2]\nc"), (3, "[1]")], "doc_id int, text string")
    began = time.time()
    got = sorted(map(tuple, segment.split_references(docs).where("doc_id < 3").collect()))
    assert time.time() - began < 60
    want = sorted(map(tuple, segment.split_marked(docs).where("doc_id < 3").collect()))
    assert got == want and len(got) == 50_001 + 3 and got[1][2] == "work 0 more of 0"


def test_cues_find_what_a_scan_finds(spark):
    """Random blocks of lines with and without keys and cues equal a line-by-line scan; 100,000 lines take linear time."""
    import random
    import time

    r = random.Random(11)
    kinds = ["A. Author, Title one", "B. Writer, On things. 2020.", "plain words go on", "see 10.1234/ab.c", "https://x.org/a", "short end.", "in Proc. of Things 1999", "pp. 3, 2001", "10.1234/", "IEEE"]
    blocks = ["\n".join(r.choice(kinds) for _ in range(r.randint(1, 14))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(blocks)), "doc_id int, text string")
    want = sorted((n, pos, text) for n, b in enumerate(blocks) for pos, text in segment.SplitReferences().eval(b))
    assert sorted(map(tuple, segment.split_references(docs).collect())) == want and len(want) > 900
    long = spark.createDataFrame([(1, "\n".join(f"A. Author, Work n{i}\n in a journal, 2020." for i in range(50_000)))], "doc_id int, text string")
    began = time.time()
    got = segment.split_references(long).collect()
    assert time.time() - began < 60 and len(got) == 50_000 and got[7]["reference"] == "A. Author, Work n7 in a journal, 2020."


def test_names_of_a_record_are_formatted_as_shown(spark):
    """Cleaned lists give the lines of ``format_authors``; of seven names or more only the first is split into words."""
    from citeflow.operators import fuse

    lists = [None, [], ["Plato"], ["Anna Maria Lee"], ["Lee, Mary-Ann", "Kim Jr., Q.", "J.-P. Sartre"], ["Van Dyk, A. B."] * 6, ["Lee, Mary-Ann"] + ["B. Author"] * 6, ["  ", "A  B", None]]
    rows = fuse.with_fields(spark.createDataFrame([(i, a) for i, a in enumerate(lists)], "ref_id int, authors array<string>"))
    rows = rows.select("ref_id", "authors", fuse.record(rows).alias("r"))
    got = rows.select(S.format_authors(F.col("authors")).alias("x"), F.coalesce(S.format_authors(F.col("r.authors"), cleaned=True), F.lit("")).alias("y"), render.format_reference(F.col("r"), F.lit("book")).alias("z"), F.expr("r.authors IS NULL").alias("none")).collect()
    assert [g["x"] for g in got] == [g["y"] for g in got] == ["", "", "Plato", "A. M. Lee", "M.-A. Lee, Q. Kim, Jr., and J.-P. Sartre", "A. B. Van Dyk, A. B. Van Dyk, A. B. Van Dyk, A. B. Van Dyk, A. B. Van Dyk, and A. B. Van Dyk", "M.-A. Lee *et al.*", "A. B"]
    assert [g["z"] for g in got] == [g["x"] + "." for g in got] and [g["none"] for g in got] == [True, True] + [False] * 6
    plan = rows.select(S.format_authors(F.col("r.authors"), cleaned=True))._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 7) THEN slice(" in plan

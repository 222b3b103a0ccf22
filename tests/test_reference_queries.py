"""Registered queries against their SQL on the small tables."""

import duckdb
import pytest
from citeflow.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = oracle.oracle_sql()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    df = queries.queries()[name](spark, sf_dir)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"select {cols} from ({SQL[name]})").fetchall()
    got = [tuple(map(plain, r)) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(map(plain, r))) for r in want) and got


def test_sql_is_for_registered_queries():
    assert set(SQL) <= set(queries.queries())


def sorted_lookup_sql() -> str:
    """SQL of ``title_lookup_sorted``: every pair of titles by the fewest insertions and deletions, diagonal by diagonal. It
    compares all pairs of like length by their edit distance first, so it is for small tables: a minute or more at sf0.01."""
    titles = SQL["title_lookup"].split("p AS (SELECT v.ref_id")[0].replace("WITH", "WITH RECURSIVE", 1)
    line = "array_to_string(list_sort(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda z: z <> '')), ' ')".format
    plain_text = "regexp_replace({}, '[^ -~]', '?', 'g')".format

    def alike_from(x: str, y: str) -> str:
        left = f"greatest(least(n - ({x}), m - ({y})), 0)"
        return f"coalesce(list_position(list_transform(range(0, {left}), lambda i: ca[({x}) + 1 + i] <> cb[({y}) + 1 + i]), true) - 1, {left})"

    return f"""{titles} asked AS (SELECT ref_id, variant, {line("wanted")} AS a FROM v), works AS (SELECT doc_id, title, {line("title")} AS b FROM d),
      two AS (SELECT a, b, length(a) AS n, length(b) AS m, string_split(a, '') AS ca, string_split(b, '') AS cb FROM (SELECT DISTINCT a FROM asked WHERE a <> '') JOIN (SELECT DISTINCT b FROM works WHERE b <> '')
        ON 2 * least(length(a), length(b)) >= 0.9 * (length(a) + length(b)) AND levenshtein({plain_text("a")}, {plain_text("b")}) <= 0.1 * (length(a) + length(b)) + 1e-6),
      edits AS (SELECT *, 0 AS e, [{alike_from("0", "0")}] AS far FROM two UNION ALL
        SELECT a, b, n, m, ca, cb, e + 1, list_transform(list_transform(range(0, e + 2), lambda j: [j, greatest(CASE WHEN j <= e THEN far[j + 1] END, CASE WHEN j >= 1 THEN far[j] + 1 END)]), lambda p: p[2] + {alike_from("p[2]", "p[2] - (2 * p[1] - e - 1)")})
        FROM edits WHERE NOT ((n - m + e) % 2 = 0 AND coalesce(far[(n - m + e) // 2 + 1], -1) >= n) AND e + 1 <= 0.1 * (n + m) + 1e-6),
      near AS (SELECT a, b, round((n + m - e) / (n + m), 6) AS sim FROM edits WHERE (n - m + e) % 2 = 0 AND (n - m + e) // 2 BETWEEN 0 AND e AND far[(n - m + e) // 2 + 1] >= n)
      SELECT ref_id, variant, 'crossref' AS source, CAST(doc_id AS VARCHAR) AS cand_key, CAST(sim AS DOUBLE) AS sim, row_number() OVER w AS rank FROM asked JOIN near USING (a) JOIN works USING (b)
      WINDOW w AS (PARTITION BY ref_id, variant ORDER BY sim DESC, title, CAST(doc_id AS VARCHAR)) QUALIFY row_number() OVER w <= 5"""


def test_sorted_lookup_equals_all_pairs(spark, sf_dir, con):
    df = queries.title_lookup_sorted(spark, sf_dir)
    want = con.execute(f"select {', '.join(df.columns)} from ({sorted_lookup_sql()})").fetchall()
    got = [tuple(map(plain, r)) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(map(plain, r))) for r in want) and len(got) > 300

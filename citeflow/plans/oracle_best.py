"""SQL of the chosen records and of what is checked and rewritten by them, over the same tables."""

from __future__ import annotations

from .oracle import CAND, CLUSTERS, FIELDS, MATCHES, REFS, RICH, WORDS, votes, years

MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
#: Fields that the surrogate tables fill; the others are NULL everywhere.
FILLED = ["title", "authors", "journal_name", "journal_abbrev", "volume", "issue", "pages", "doi", "year", "month"]
ALWAYS = ["title", "authors", "year", "month", "doi"]


def keys(a: str) -> str:
    """Initials and surname of each name."""
    toks = "string_split(trim(x), ' ')"
    key = f"lower(array_to_string(list_append(list_transform({toks}[:-2], lambda t: upper(t[1]) || '.'), {toks}[-1]), ' '))"
    return f"coalesce(list_transform({a}, lambda x: {key}), [])"


def jaccard(a: str, b: str) -> str:
    x, y = WORDS.format(t=a), WORDS.format(t=b)
    return f"coalesce(len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))), 0)"


def month(m: str) -> str:
    return f"coalesce(CAST(list_position({MONTHS}, {m}) AS VARCHAR), {m})"


def names(a: str) -> str:
    return f"list_transform({a}, lambda x: trim(x))"


def widens(page: str, other: str) -> str:
    """Whether ``other`` is a range that starts at the single page ``page``."""
    return f"coalesce(regexp_full_match({page}, '\\d+') AND regexp_matches({other}, '[-–]') AND len(regexp_extract_all({other}, '\\d+')) >= 2 AND regexp_extract({other}, '(\\d+)', 1) = {page}, false)"


FUSED = f"""
{CLUSTERS},
dois AS (SELECT ref_id, cluster, lower(doi) AS doi, count(*) AS n, min(cand_ord) AS first, bool_or(sure) AS sure FROM clustered WHERE doi <> '' GROUP BY ALL),
agree AS (SELECT * FROM (SELECT * FROM dois QUALIFY row_number() OVER (PARTITION BY ref_id, cluster ORDER BY n DESC, first) = 1) WHERE n >= 2 OR sure),
total AS (SELECT ref_id, cluster, sum(w) AS weight, min(cand_ord) AS first FROM clustered GROUP BY ALL),
tops AS (SELECT t.ref_id, t.cluster, a.doi AS agreed FROM total t LEFT JOIN agree a USING (ref_id, cluster)
  QUALIFY row_number() OVER (PARTITION BY t.ref_id ORDER BY CASE WHEN a.doi IS NOT NULL THEN 100 ELSE weight END DESC, t.first) = 1),
own AS (SELECT c.* FROM clustered c JOIN tops USING (ref_id, cluster)),
{votes("own")}, {years("own")},
grp AS (SELECT ref_id, {keys("authors")} AS norm, sum(w) AS weight, min(cand_ord) AS first, arg_min(authors, cand_ord) AS authors, arg_min(source, cand_ord) AS source FROM own GROUP BY ALL),
people AS (SELECT * FROM grp QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY weight DESC, first) = 1),
spans AS (SELECT ref_id, regexp_extract(pages, '(\\d+)', 1) AS start, pages, source FROM own WHERE {RICH.format(p='pages')} = 2
  QUALIFY row_number() OVER (PARTITION BY ref_id, regexp_extract(pages, '(\\d+)', 1) ORDER BY length(pages) DESC, cand_ord) = 1),
wide AS (SELECT ref_id, {', '.join(f"max(value) FILTER (WHERE field = '{f}') AS {f}, max(source) FILTER (WHERE field = '{f}') AS {f}_by" for f in FIELDS)} FROM votes GROUP BY ref_id),
fused AS (SELECT t.ref_id, title, {names("p.authors")} AS authors, journal_name, journal_abbrev, volume, issue, coalesce(s.pages, w.pages) AS pages, coalesce(agreed, w.doi) AS doi, y.year, w.month,
    title_by, p.source AS authors_by, journal_name_by, journal_abbrev_by, volume_by, issue_by, coalesce(s.source, pages_by) AS pages_by, CASE WHEN agreed IS NOT NULL THEN 'doi-agreement' ELSE doi_by END AS doi_by, y.source AS year_by, month_by
  FROM tops t LEFT JOIN wide w USING (ref_id) LEFT JOIN people p USING (ref_id) LEFT JOIN years y USING (ref_id)
  LEFT JOIN spans s ON s.ref_id = t.ref_id AND {RICH.format(p='w.pages')} = 1 AND s.start = regexp_extract(w.pages, '(\\d+)', 1))"""

BEST = f"""
{FUSED}, {MATCHES},
one AS (SELECT ref_id, CASE WHEN s.trusted THEN s.cand_ord WHEN t.near >= 0.95 AND t.trusted THEN t.cand_ord END AS cand_ord
  FROM (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, cand_ord) = 1) s
  JOIN (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY near DESC, cand_ord) = 1) t USING (ref_id)),
joined AS (SELECT r.ref_id, coalesce(r.doi IS NOT NULL AND f.doi = '10.1000/' || r.ref_id, false) AS by_doi, r, f, c FROM refs r LEFT JOIN fused f USING (ref_id) LEFT JOIN one o USING (ref_id) LEFT JOIN cand c ON c.ref_id = r.ref_id AND c.cand_ord = o.cand_ord),
chosen AS (SELECT ref_id, by_doi OR c.ref_id IS NOT NULL AS trusted,
    r.title AS e_title, {names("r.authors")} AS e_authors, r.journal_name AS e_journal_name, CAST(NULL AS VARCHAR) AS e_journal_abbrev, r.volume AS e_volume, r.issue AS e_issue, nullif(r.pages, '') AS e_pages, r.doi AS e_doi, r.year AS e_year, r.month AS e_month,
    {', '.join(f"CASE WHEN by_doi THEN f.{f} ELSE {names('c.authors') if f == 'authors' else f'c.{f}'} END AS b_{f}" for f in FILLED)},
    {', '.join(f"CASE WHEN by_doi THEN f.{f}_by WHEN c.{f} IS NOT NULL THEN {chr(39) + 'doi-agreement' + chr(39) if f == 'doi' else 'c.source'} END AS p_{f}" for f in FILLED)}
  FROM joined),
best AS (SELECT *, regexp_replace(lower(e_doi), '^(https://doi.org/|doi:)', '') AS e_key,
    list_filter([CASE WHEN {jaccard('e_title', 'b_title')} >= 0.93 THEN 'title' END, CASE WHEN len({keys('e_authors')}) > 0 AND {keys('e_authors')} = {keys('b_authors')} THEN 'authors' END,
      {', '.join(f"CASE WHEN e_{f} = b_{f} THEN '{f}' END" for f in ('year', 'journal_name', 'volume', 'issue', 'pages'))},
      CASE WHEN regexp_replace(lower(e_doi), '^(https://doi.org/|doi:)', '') = b_doi THEN 'doi' END], lambda f: f IS NOT NULL) AS matching FROM chosen)"""

_SAME_KEYS = f"(len({keys('e_authors')}) > 0 AND len({keys('b_authors')}) > 0 AND {keys('e_authors')} = {keys('b_authors')})"
_NEW = {
    "journal_name": "CASE WHEN b_journal_name IS DISTINCT FROM e_journal_name THEN b_journal_name END",
    "journal_abbrev": "CASE WHEN b_journal_abbrev IS DISTINCT FROM e_journal_abbrev THEN b_journal_abbrev END",
    "authors": f"CASE WHEN b_authors IS NOT NULL AND NOT coalesce({_SAME_KEYS}, false) THEN array_to_string(b_authors, '; ') END",
    "title": f"CASE WHEN NOT (b_title IS NOT NULL AND {jaccard('e_title', 'b_title')} >= 0.90) THEN b_title END",
    "year": "CASE WHEN b_year <> coalesce(e_year, '') THEN b_year END",
    "month": f"CASE WHEN {month('b_month')} <> coalesce({month('e_month')}, '') THEN {month('b_month')} END",
    **{f: f"CASE WHEN b_{f} IS DISTINCT FROM e_{f} THEN b_{f} END" for f in ("volume", "issue", "pages")},
    "doi": "CASE WHEN lower(b_doi) IS DISTINCT FROM e_key THEN b_doi END",
}
_NUMBERS = "coalesce(b_volume, b_issue, b_pages, b_doi) IS NOT NULL AND coalesce(a_volume, a_issue, a_pages, a_doi) IS NULL"
_OK = {
    "title": f"b_title IS NOT NULL AND {jaccard('e_title', 'b_title')} >= 0.90",
    "authors": f"{_SAME_KEYS} OR (len({keys('e_authors')}) > 0 AND len({keys('e_authors')}) = len({keys('b_authors')}) AND list_sort(list_distinct({keys('e_authors')})) = list_sort(list_distinct({keys('b_authors')})))",
    "journal": f"{jaccard('e_journal_name', 'b_journal_name')} >= 0.90 OR {jaccard('e_journal_abbrev', 'b_journal_abbrev')} >= 0.90",
    "date": "CASE WHEN b_year IS NOT NULL OR b_month IS NOT NULL THEN a_year IS NULL AND a_month IS NULL ELSE try_cast(left(e_year, 4) AS INTEGER) BETWEEN 1800 AND 2026 END",
    "numbers": _NUMBERS,
    "presence": "e_title IS NOT NULL AND e_authors IS NOT NULL",
}
_ROLLUP = {"title": "title", "authors": "authors", "journal_name": "journal", "journal_abbrev": "journal", "year": "date", "month": "date", "volume": "numbers", "issue": "numbers", "pages": "numbers", "doi": "numbers", "presence": "presence"}
_OR_MATCH = lambda f: f" OR list_contains(matching, '{f}')" if f not in ("authors", "presence") else ""



def checked(source: str) -> str:
    """Checks, suggestions and score of a table of e_ and b_ fields."""
    return f"""
asked AS (SELECT *, {', '.join(f'{e} AS a_{f}' for f, e in _NEW.items())} FROM {source}),
flags AS (SELECT *, {', '.join(f'coalesce({e}, false) AS f_{c}' for c, e in _OK.items())} FROM asked),
checked AS (SELECT *, {', '.join(f"(f_{c}{_OR_MATCH(f)}) AS ok_{f}" for f, c in _ROLLUP.items())},
    {', '.join(f"CASE WHEN {'true' if f == 'authors' else f'NOT list_contains(matching, {chr(39)}{f}{chr(39)})'} THEN a_{f} END AS new_{f}" for f in _NEW)} FROM flags),
verified AS (SELECT *, {' + '.join(f'CAST(ok_{f} AS INTEGER)' for f in _ROLLUP)} AS ver_score FROM checked)"""


CHECKED = f"{BEST}, {checked('best')}"

_FREE = lambda f: "true" if f in ALWAYS else f"NOT list_contains(matching, '{f}')"


def _over(f: str) -> str:
    kept = f" AND NOT {widens('b_pages', 'e_pages')}" if f == "pages" else ""
    return f"CASE WHEN b_{f} IS NOT NULL AND {_FREE(f)}{kept} THEN b_{f} ELSE e_{f} END AS o_{f}"


def _advised(f: str) -> str:
    kept = f" AND NOT {widens('new_pages', 'q_pages')}" if f == "pages" else ""
    return f"CASE WHEN new_{f} IS NOT NULL AND {_FREE(f)}{kept} THEN {'b_authors' if f == 'authors' else f'new_{f}'} ELSE q_{f} END AS s_{f}"


FIXED = f"""
{CHECKED},
every AS (SELECT ref_id, regexp_extract(pages, '(\\d+)', 1) AS start, pages AS range, source AS range_source FROM cand WHERE {RICH.format(p='pages')} = 2
  QUALIFY row_number() OVER (PARTITION BY ref_id, regexp_extract(pages, '(\\d+)', 1) ORDER BY length(pages) DESC, cand_ord) = 1),
first AS (SELECT *, {', '.join(map(_over, FILLED))} FROM verified),
paged AS (SELECT first.*, {', '.join(f'o_{f} AS q_{f}' for f in FILLED if f != 'pages')},
    CASE WHEN {widens('o_pages', 'b_pages')} THEN b_pages ELSE coalesce(range, o_pages) END AS q_pages,
    CASE WHEN {widens('o_pages', 'b_pages')} THEN coalesce(p_pages, 'consensus') ELSE coalesce(range_source, 'candidates') END AS pages_from
  FROM first LEFT JOIN every ON every.ref_id = first.ref_id AND regexp_full_match(o_pages, '\\d+') AND every.start = o_pages),
told AS (SELECT *, {', '.join(map(_advised, FILLED))} FROM paged),
fixed AS (SELECT *, {', '.join(f'{month("s_month") if f == "month" else f"s_{f}"} AS n_{f}' for f in FILLED)} FROM told)"""


def _text(x: str, f: str) -> str:
    return f"array_to_string({x}_{f}, ', ')" if f == "authors" else f"{x}_{f}"


def _entries() -> str:
    steps = [("best", "e", "o", FILLED, lambda f: f"coalesce(p_{f}, 'consensus')"), ("pages", "o", "q", ["pages"], lambda f: "pages_from"), ("suggestion", "q", "s", FILLED, lambda f: "'verify/llm'"), ("normalize", "s", "n", ["month"], lambda f: "'normalize'")]
    rows, at = [], 0
    for step, old, new, fields, by in steps:
        for f in fields:
            at += 1
            rows.append(f"""SELECT ref_id, {at} AS place, '{step}' AS step, '{f}' AS field, {_text(old, f)} AS old, {_text(new, f)} AS new, {by(f)} AS "by" FROM fixed WHERE {old}_{f} IS DISTINCT FROM {new}_{f}""")
    return " UNION ALL ".join(rows)


LOGGED = f"""{FIXED}, entries AS ({_entries()}),
log AS (SELECT ref_id, CAST(row_number() OVER (PARTITION BY ref_id ORDER BY place) - 1 AS INTEGER) AS n, CAST(1 AS INTEGER) AS round, step, field, old, new, "by" FROM entries)"""

_CTE = f"WITH {CAND}, {REFS}, "
_JOINED = lambda a: f"coalesce(array_to_string({a}, '|'), '')"
_WARNED = """array_to_string(list_filter([CASE WHEN NOT regexp_full_match(e_year, '(18|19|20)\\d{2}') THEN 'Suspicious year value: ''' || e_year || '''' END,
  CASE WHEN e_doi IS NULL THEN 'Missing DOI for an article/conference reference' END,
  CASE WHEN e_pages LIKE '%-%' AND regexp_extract_all(e_pages, '\\d+')[1] = regexp_extract_all(e_pages, '\\d+')[2] THEN 'Detected fake page range ''' || e_pages || ''' collapsed to single page'
    WHEN regexp_full_match(e_pages, '\\d+') THEN 'Single page ''' || e_pages || ''' — verify whether it should be a range' END], lambda w: w IS NOT NULL), '|')"""
_PATCHED = f"""{FIXED}, patched AS (SELECT *, coalesce(b_title, 'Patched ' || ref_id) AS t_title, coalesce(b_year, CASE WHEN ref_id % 3 = 0 THEN '1999' ELSE n_year END) AS t_year, coalesce({month('b_month')}, '12' ) AS t_month0,
    CASE WHEN ref_id % 2 = 0 THEN 'Berlin' END AS t_location, CASE WHEN b_pages IS NULL OR {widens('b_pages', 'n_pages')} THEN n_pages ELSE b_pages END AS t_pages, CASE WHEN b_doi IS NULL OR lower(b_doi) = regexp_replace(lower(n_doi), '^(https://doi.org/|doi:)', '') THEN n_doi ELSE b_doi END AS t_doi FROM fixed)"""
#: Locked fields that no patch names take the best record's value.
_LOCKED = " OR ".join(f"(b_{f} IS NOT NULL AND b_{f} IS DISTINCT FROM n_{f})" for f in ("authors", "journal_name", "journal_abbrev", "volume", "issue"))
_LOGGED_ANY = " OR ".join([*(f"e_{f} IS DISTINCT FROM o_{f}" for f in FILLED), "o_pages IS DISTINCT FROM q_pages", *(f"q_{f} IS DISTINCT FROM s_{f}" for f in FILLED), "s_month IS DISTINCT FROM n_month"])

SQL = {
    "consensus_records": f"WITH {CAND}, {FUSED} SELECT ref_id, title, {_JOINED('authors')} AS authors, journal_name, journal_abbrev, volume, issue, pages, year, month, doi, title_by, authors_by, pages_by, year_by, doi_by FROM fused",
    "selected_best": f"{_CTE}{BEST} SELECT ref_id, trusted, b_title AS title, b_year AS year, b_doi AS doi, b_pages AS pages, b_volume AS volume, array_to_string(b_authors, '|') AS authors, array_to_string(matching, '|') AS matching FROM best",
    "enriched": f"""{_CTE}{BEST} SELECT ref_id, coalesce(e_title, b_title) AS title, coalesce(e_journal_name, b_journal_name) AS journal_name, coalesce(e_journal_abbrev, b_journal_abbrev) AS journal_abbrev, coalesce(e_volume, b_volume) AS volume, coalesce(e_issue, b_issue) AS issue,
      CASE WHEN {widens('coalesce(e_pages, b_pages)', 'b_pages')} THEN b_pages ELSE coalesce(e_pages, b_pages) END AS pages, coalesce(e_year, b_year) AS year, {month('coalesce(e_month, b_month)')} AS month, coalesce(e_doi, b_doi) AS doi, array_to_string(coalesce(e_authors, b_authors), '|') AS authors FROM best""",
    "verification": f"{_CTE}{CHECKED} SELECT ref_id, array_to_string(matching, '|') AS matching, {', '.join(f'ok_{f}' for f in _ROLLUP)}, CAST(ver_score AS INTEGER) AS ver_score, {', '.join(f'new_{f}' for f in ('title', 'authors', 'journal_name', 'year', 'month', 'volume', 'pages', 'doi'))}, {_WARNED} AS warnings FROM verified",
    "loop_guards": f"""{_CTE}{CHECKED}, g AS (SELECT ref_id, ver_score, CASE WHEN ver_score > ref_id % 12 - 1 THEN 0 ELSE ref_id % 2 + 1 END AS stagnation, ref_id % 13 + 1 AS hops, ref_id % 4 AS attempts, ref_id % 3 = 0 AS changed FROM verified)
      SELECT ref_id, CAST(ver_score AS INTEGER) AS ver_score, CAST(stagnation AS INTEGER) AS stagnation, false AS looped, CAST(hops AS INTEGER) AS hops, CAST(1 AS INTEGER) AS seen, hops >= 12 OR attempts >= 3 OR stagnation >= 2 OR (NOT changed AND stagnation >= 1) OR ver_score = 11 AS done FROM g""",
    "corrections": f"{_CTE}{FIXED} SELECT ref_id, {', '.join(f'n_{f} AS {f}' for f in ('title', 'journal_name', 'volume', 'issue', 'pages', 'year', 'month', 'doi'))}, array_to_string(n_authors, '|') AS authors, {_LOGGED_ANY} AS changed, CAST(1 AS INTEGER) AS attempts FROM fixed",
    "change_log": f'{_CTE}{LOGGED} SELECT ref_id, n, round, step, field, old, new, "by" FROM log',
    "patches": f"""{_CTE}{_PATCHED} SELECT ref_id, t_title AS title, t_year AS year, t_month0 AS month, t_location AS location, t_pages AS pages, t_doi AS doi,
      {_LOGGED_ANY} OR {_LOCKED} OR t_title IS DISTINCT FROM n_title OR t_year IS DISTINCT FROM n_year OR t_month0 IS DISTINCT FROM n_month OR t_location IS NOT NULL OR t_pages IS DISTINCT FROM n_pages OR t_doi IS DISTINCT FROM n_doi AS changed FROM patched""",
}


_LABELS = {"crossref": "Crossref", "openalex": "OpenAlex", "semanticscholar": "Semantic Scholar", "ieeexplore": "IEEE Xplore", "pubmed": "PubMed", "arxiv": "arXiv", "doi-agreement": "DOI agreement", "consensus": "Consensus", "normalize": "Normalization", "verify/llm": "LLM suggestion"}


def label(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items())
    return f"CASE coalesce({x}, '') {cases} WHEN '' THEN 'Unknown' ELSE {x} END"


def listed(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda v: v IS NOT NULL AND v <> ''))), ', ')"


_ALL_BY = "[" + ", ".join(label(f"p_{f}") + f" || CASE WHEN p_{f} IS NULL THEN NULL ELSE '' END" for f in FILLED) + "]"
_LINES = ", ".join(f"CASE WHEN {_text('b', f)} IS NOT NULL OR {_text('n', f)} IS NOT NULL THEN '- {f}: ' || coalesce({_text('b', f)}, {_text('n', f)}) || '  (source: ' || {label(f'coalesce(p_{f}, u_{f})')} || ')' END" for f in FILLED)
SQL["reports"] = f"""{_CTE}{LOGGED}, again AS (SELECT ref_id, matching, {', '.join(f'n_{f} AS e_{f}, b_{f}' for f in FILLED)}, regexp_replace(lower(n_doi), '^(https://doi.org/|doi:)', '') AS e_key FROM fixed),
  {checked('again').replace('asked AS', 'asked2 AS').replace('FROM asked)', 'FROM asked2)').replace('flags AS', 'flags2 AS').replace('FROM flags)', 'FROM flags2)').replace('checked AS', 'checked2 AS').replace('FROM checked)', 'FROM checked2)').replace('verified AS', 'verified2 AS')},
  used AS (SELECT ref_id, {listed(f"list({label('source')})")} AS sources FROM cand GROUP BY ref_id),
  audit AS (SELECT ref_id, field, coalesce(arg_max("by", n) FILTER (WHERE step = 'best'), arg_min("by", n)) AS code FROM log GROUP BY ALL),
  audits AS (SELECT ref_id, {', '.join(f"max(code) FILTER (WHERE field = '{f}') AS u_{f}" for f in FILLED)} FROM audit GROUP BY ref_id),
  lines AS (SELECT ref_id, string_agg('- ' || field || ': ' || coalesce(nullif(old, ''), 'MISSING') || ' → ' || coalesce(nullif(new, ''), 'MISSING') || '  (by: ' || {label('code')} || ')', chr(10) ORDER BY n) AS corrections FROM log JOIN audit USING (ref_id, field) GROUP BY ref_id)
  SELECT f.ref_id, '- Type detected: journal article' || chr(10) || '- DOI: ' || coalesce(f.b_doi, n_doi, 'Not available') || chr(10) || '- Primary source for DOI: ' || {label('p_doi')} || chr(10) || '- Trusted online match: ' || CASE WHEN trusted THEN 'Yes' ELSE 'No' END || chr(10) || 'Match rationale: '
      || CASE WHEN NOT trusted THEN 'No trusted online match' WHEN p_doi = 'doi-agreement' THEN 'DOI agreement across sources' ELSE 'Strict title/author/venue match from ' || {listed(_ALL_BY)} END || chr(10) || 'Sources searched: ' || coalesce(nullif(sources, ''), 'None') AS overview,
    'Fields matched authoritative sources: ' || coalesce(nullif({listed('f.matching')}, ''), 'None') || chr(10) || 'Fields needing attention: ' || coalesce(nullif({listed('[' + ', '.join(f"CASE WHEN NOT v.ok_{f} THEN '{f}' END" for f in _ROLLUP) + ']')}, ''), 'None') AS fields,
    coalesce(corrections, 'No corrections were needed.') AS corrections, concat_ws(chr(10), {_LINES}) AS provenance
  FROM fixed f JOIN (SELECT ref_id AS k, COLUMNS('^ok_') FROM verified2) v ON v.k = f.ref_id LEFT JOIN used u ON u.ref_id = f.ref_id LEFT JOIN lines l ON l.ref_id = f.ref_id LEFT JOIN audits u2 ON u2.ref_id = f.ref_id"""

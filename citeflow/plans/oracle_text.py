"""SQL of scalars, rendering, segmentation, title lookups and batch results, over the same tables."""

from __future__ import annotations

from .oracle import CAND, IEEE, REFS, STRINGS, WORDS
from .oracle_best import MONTHS, month

_CTE = f"WITH {CAND}, {REFS}"
_LINK = "'https://doi.org/10.1000/' || ref_id"
_DATE = f"{MONTHS}[CAST({month('month')} AS INTEGER)] || ' ' || year"
STYLED = f"""styled AS (SELECT * REPLACE (CASE WHEN ref_id % 11 = 0 THEN 'e1234' ELSE nullif(pages, '') END AS pages),
  CASE WHEN ref_id % 4 = 1 THEN 'Proc. of Things' END AS conf, CASE WHEN ref_id % 3 <> 0 THEN 'Press & Co' END AS pub, CASE WHEN ref_id % 5 <> 0 THEN 'Berlin' END AS loc,
  CASE WHEN ref_id % 7 = 0 THEN '2nd' END AS ed, CASE WHEN ref_id % 2 = 0 THEN '978-3' END AS isbn, CASE WHEN ref_id % 2 = 1 THEN 'https://x.org/a_b' END AS url FROM refs),
drawn AS (SELECT *, nullif({IEEE}, '') AS people, '"' || title || '"' AS quoted, 'vol. ' || volume AS vol, 'no. ' || issue AS no, 'pp. ' || replace(pages, '-', '–') AS pp, CASE WHEN ref_id % 11 = 0 THEN 'Art. no. e1234' ELSE 'pp. ' || replace(pages, '-', '–') END AS place,
  {_DATE} AS date, CASE WHEN doi IS NOT NULL THEN {_LINK} END AS link FROM styled)"""
_LINES = {
    "journal article": "people, quoted, '*' || journal_name || '*', vol, no, place, date, link",
    "conference paper": "people, quoted, 'in *' || coalesce(conf, journal_name, 'Proceedings') || '*', loc, pp, date, link",
    "preprint": "people, quoted, 'preprint', date, link",
    "book": "people, '*' || title || '*', ed || ' ed.', nullif(concat_ws(': ', loc, pub), ''), year, 'ISBN: ' || isbn, link",
    "book chapter": "people, quoted, 'in *' || coalesce(conf, journal_name) || '*', pp, pub, date, link",
    "dataset": "people, quoted, coalesce(journal_name, conf, pub), date, vol, no, pp, link",
}
_LINE = lambda kind: f"replace(concat_ws(', ', {_LINES[kind]}) || '.', ' ,', ',')"
_KINDS = "['journal article', 'conference paper', 'book', 'book chapter', 'thesis', 'technical report', 'dataset']"
_LAST = lambda a: f"string_split(trim({a}[1]), ' ')[-1]"


def _escaped(x: str) -> str:
    out = f"replace({x}, '\\', chr(1))"
    for c in "{}&%$#_":
        out = f"replace({out}, '{c}', '\\{c}')"
    return f"replace({out}, chr(1), '\\textbackslash{{}}')"


def _entry(name: str, value: str) -> str:
    return f"'{name} = {{' || {_escaped(f'nullif({value}, {chr(39) * 2})')} || '}}'"


_BIBTEX = [
    ("author", "array_to_string(list_transform(authors, lambda x: trim(x)), ' and ')"), ("title", "title"), ("journal", "CASE WHEN entry = 'article' THEN journal_name END"),
    ("booktitle", "CASE WHEN entry IN ('inproceedings', 'incollection') THEN coalesce(conf, journal_name) END"), ("volume", "CASE WHEN entry = 'article' THEN volume END"), ("number", "CASE WHEN entry = 'article' THEN issue END"),
    ("pages", "CASE WHEN entry IN ('article', 'inproceedings', 'incollection') THEN pages END"), ("publisher", "CASE WHEN entry IN ('book', 'incollection') THEN pub END"),
    ("school", "CASE WHEN entry = 'phdthesis' THEN coalesce(pub, conf, journal_name) END"), ("institution", "CASE WHEN entry = 'techreport' THEN coalesce(pub, conf, journal_name) END"),
    ("howpublished", "CASE WHEN entry = 'misc' THEN coalesce(conf, journal_name, pub) END"), ("year", "year"), ("isbn", "CASE WHEN entry = 'book' THEN isbn END"), ("url", "coalesce(link, url)"),
]

# ---- title lookups: every pair of titles is compared

SETS = lambda t: WORDS.format(t=t)
_SIM = "round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6)"
_WORKS = """works AS (SELECT item_id, CAST(item_id AS VARCHAR) AS cand_key, split_part(text, chr(10), 1) AS title, '10.8/' || item_id AS doi_key, item_id % 4 = 0 AS relation, item_id % 3 = 0 AS updated FROM benchmark),
  asked AS (SELECT item_id AS ref_id, CASE WHEN item_id % 2 = 0 THEN upper(split_part(text, chr(10), 1)) ELSE 'Revisited ' || split_part(text, chr(10), 1) END AS title FROM benchmark)"""


def _near(refs: str, works: str) -> str:
    """Each reference's five nearest works."""
    return f"""near AS (SELECT * FROM (SELECT r.ref_id, w.*, {_SIM.replace('(a, b)', '(r.ws, w.ws)')} AS sim FROM (SELECT *, {SETS('title')} AS ws FROM {refs}) r JOIN (SELECT *, {SETS('title')} AS ws FROM {works}) w ON len(list_intersect(r.ws, w.ws)) > 0) WHERE sim >= 0.5
      QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY sim DESC, doi_key, title, cand_key) <= 5), placed AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY sim DESC, doi_key, title, cand_key) AS rank FROM near)"""


_MARKED = "marked AS (SELECT *, CASE WHEN relation THEN 'relation' ELSE 'update-to' END AS reason FROM placed WHERE relation OR updated QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY rank) = 1)"
_BAD = "bad AS (SELECT * FROM works WHERE relation OR updated)"
_FLAT = "trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
_FIRST = "trim(split_part(text, chr(10), 1))"

_TITLES = "styled_ids AS (SELECT *, concat_ws(': ', title, CASE WHEN ref_id % 2 = 0 THEN repeat('word & more_ ', 20) END) AS long FROM refs), flat AS (SELECT *, " + _FLAT.format(t="long") + " AS s FROM styled_ids)"

_RESULTS = f"""{_CTE}, {STRINGS}, res AS (SELECT doc_id, pos, ref_id, reference, CASE WHEN ref_id % 19 = 0 THEN reference || ' [ERROR]' ELSE reference END AS formatted, repeat('r' || ref_id, 80) AS report FROM strings)"""

_LCS = f"""RECURSIVE lines AS (SELECT DISTINCT array_to_string(list_sort(string_split(trim(regexp_replace(lower(r.title), '[^a-z0-9]+', ' ', 'g')), ' ')), ' ') AS a, array_to_string(list_sort(string_split(c.title, ' ')), ' ') AS b, r.title AS rt, c.title AS ct FROM refs r JOIN cand c USING (ref_id)),
  pairs AS (SELECT DISTINCT a, b FROM lines),
  lcs AS (SELECT a, b, 0 AS i, list_transform(range(len(a)), lambda x: 0) AS row FROM pairs
    UNION ALL SELECT a, b, i + 1, list_transform(range(1, len(a) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(row[k], coalesce(row[k - 1], 0) + CASE WHEN a[k] = b[i + 1] THEN 1 ELSE 0 END)))) FROM lcs WHERE i < len(b))"""

SQL = {
    "formatted_by_type": f"{_CTE}, {STYLED} SELECT ref_id, ['journal article', 'conference paper', 'preprint', 'book', 'book chapter', 'dataset'][ref_id % 6 + 1] AS type, CASE ref_id % 6 {' '.join(f'WHEN {i} THEN {_LINE(k)}' for i, k in enumerate(_LINES))} END AS formatted FROM drawn",
    "csl_exports": f"""{_CTE}, {STYLED} SELECT ref_id, ['article-journal', 'paper-conference', 'book', 'chapter', 'thesis', 'report', 'dataset'][ref_id % 7 + 1] AS type, title, {_LAST('authors')} AS family, array_to_string(string_split(trim(authors[1]), ' ')[:-2], ' ') AS given,
      coalesce(journal_name, conf) AS container, pages AS page, coalesce(link, url) AS url, doi, '[[' || year || ',' || {month('month')} || ']]' AS issued FROM drawn""",
    "bibtex_exports": f"""{_CTE}, {STYLED}, e AS (SELECT *, ['article', 'inproceedings', 'book', 'incollection', 'phdthesis', 'techreport', 'misc'][ref_id % 7 + 1] AS entry FROM drawn)
      SELECT ref_id, '@' || entry || '{{' || coalesce(nullif(regexp_replace({_LAST('authors')}, '[^A-Za-z0-9]+', '', 'g'), ''), 'ref') || year || ',' || chr(10) || '  ' || concat_ws(',' || chr(10) || '  ', {', '.join(_entry(n, v) for n, v in _BIBTEX)}) || chr(10) || '}}' AS bibtex FROM e""",
    "recorded_lines": f"""{_CTE}, {STYLED} SELECT ref_id, CASE WHEN ref_id % 3 = 0 THEN 'A. B, "' || title || '", pp. 12–19, .' ELSE {_LINE('journal article')} END AS formatted, CASE WHEN ref_id % 3 = 0 THEN 'model' ELSE 'rules' END AS format_source,
      concat_ws(chr(10), 'type: journal article', 'title: ' || title, 'authors: ' || array_to_string(list_transform(authors, lambda x: trim(x)), ', '), 'journal_name: ' || journal_name, 'conference_name: ' || conf, 'volume: ' || volume, 'issue: ' || issue,
        'pages: ' || CASE WHEN len(regexp_extract_all(pages, '\\d+')) = 2 THEN array_to_string(regexp_extract_all(pages, '\\d+'), '–') ELSE regexp_extract(pages, '\\d+') END, 'year: ' || year, 'month: ' || month, 'doi: ' || doi, 'publisher: ' || pub, 'location: ' || loc, 'edition: ' || ed, 'isbn: ' || isbn, 'url: ' || url) AS payload FROM drawn""",
    "scalar_text": f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations) SELECT conv_id, turn, {_FLAT.format(t='text')} AS clean, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g')) AS comparable, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS safe,
      CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_replace(l, '\\s+', '', 'g') <> '')) AS INTEGER) AS lines, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(text, ',\\s*|\\s+&\\s+| and '), lambda p: {_FLAT.format(t='p')}), lambda p: p <> ''), '|'), '') AS parts FROM t""",
    "scalar_ids": f"""{_CTE}, {_TITLES} SELECT ref_id, CASE WHEN doi IS NOT NULL THEN '10.1000/' || ref_id END AS doi_key, CASE WHEN doi IS NOT NULL THEN {_LINK} ELSE '' END AS link,
      array_to_string(list_filter([s, CASE WHEN ref_id % 2 = 0 AND length(title) >= 6 THEN {_FLAT.format(t='title')} END, CASE WHEN length(s) > 180 THEN left(s, 180) END], lambda v: v IS NOT NULL), '|') AS variants, {_escaped("chr(92) || long")} AS escaped FROM flat""",
    "fingerprints": f"""{_CTE} SELECT ref_id, sha256('{{' || concat_ws(',', '"doi":"' || doi || '"', '"title":"' || title || '"', '"year":"' || year || '"') || '}}') AS fp FROM refs""",
    "split_documents": f"{_CTE}, {STRINGS} SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN pos + 1 ELSE pos END AS INTEGER) AS pos, reference FROM strings UNION ALL SELECT DISTINCT doc_id, 1, 'Body text References' FROM strings WHERE doc_id % 3 = 0",
    "title_token_sort": f"WITH {_LCS.replace('RECURSIVE', 'RECURSIVE ' + CAND + ', ' + REFS + ',', 1)}, ends AS (SELECT a, b, row[len(a)] AS n FROM lcs WHERE i = len(b)) SELECT r.ref_id, c.cand_ord, round(2 * n / (len(a) + len(b)), 6) AS similarity FROM refs r JOIN cand c USING (ref_id) JOIN lines ON rt = r.title AND ct = c.title JOIN ends USING (a, b)",
    "title_lookup": f"""WITH d AS (SELECT doc_id, {_FIRST} AS title FROM documents), s AS (SELECT doc_id, title, {_FLAT.format(t='title')} AS s FROM d), h AS (SELECT *, coalesce(nullif(regexp_extract(s, '^(.*?)\\s*[:\\-–—]', 1), ''), CASE WHEN regexp_matches(s, '[:\\-–—]') THEN '' ELSE s END) AS head FROM s),
      v AS (SELECT doc_id AS ref_id, unnest(vs) AS wanted, generate_subscripts(vs, 1) - 1 AS variant FROM (SELECT doc_id, CASE WHEN s = '' THEN [] ELSE list_filter([s, CASE WHEN length(head) >= 6 AND head <> s THEN head END, CASE WHEN length(s) > 180 AND left(s, 180) <> head THEN left(s, 180) END], lambda x: x IS NOT NULL) END AS vs FROM h)),
      p AS (SELECT v.ref_id, v.variant, CAST(w.doc_id AS VARCHAR) AS cand_key, w.title, {_SIM.replace('(a, b)', '(v.ws, w.ws)')} AS sim FROM (SELECT *, {SETS('wanted')} AS ws FROM v) v JOIN (SELECT *, {SETS('title')} AS ws FROM s) w ON len(v.ws) <= 2 * len(w.ws) AND len(w.ws) <= 2 * len(v.ws) AND v.ws <> [''] AND w.ws <> [''])
      SELECT ref_id, CAST(variant AS INTEGER) AS variant, 'crossref' AS source, cand_key, CAST(sim AS DOUBLE) AS sim, CAST(row_number() OVER w AS INTEGER) AS rank FROM p WHERE sim >= 0.5 WINDOW w AS (PARTITION BY ref_id, variant ORDER BY sim DESC, title, cand_key) QUALIFY row_number() OVER w <= 5""",
    "normalised_catalogs": f"""WITH {CAND}, n AS (SELECT *, list_transform(authors, lambda a: trim(a)) AS people, CASE WHEN pages LIKE '%-%' OR pages LIKE '%–%' THEN replace(pages, '–', '-') ELSE pages END AS ab FROM cand)
      SELECT ref_id, cand_ord, source, title, CASE WHEN source = 'crossref' THEN array_to_string(list_transform(authors, lambda a: trim(split_part(a, ' ', 1) || ' ' || string_split(a, ' ')[-1])), '|') ELSE array_to_string(people, '|') END AS authors, journal_name,
        CASE WHEN source IN ('openalex', 'pubmed') THEN journal_abbrev END AS journal_abbrev, CASE WHEN source <> 'semanticscholar' THEN volume END AS volume, CASE WHEN source <> 'semanticscholar' THEN issue END AS issue,
        CASE WHEN source IN ('crossref', 'pubmed') THEN pages WHEN source IN ('openalex', 'ieeexplore') THEN ab END AS pages, year, CASE WHEN source = 'crossref' THEN month END AS month, doi FROM n WHERE source IN ('crossref', 'openalex', 'semanticscholar', 'pubmed', 'ieeexplore')""",
    "retraction_checks": f"WITH {_WORKS}, {_near('asked', 'works')}, {_MARKED} SELECT a.ref_id, m.reason IS NOT NULL AS is_retracted, m.reason, m.title, CASE WHEN m.reason = 'update-to' THEN '10.9/' || m.item_id END AS update_dois FROM asked a LEFT JOIN marked m USING (ref_id)",
    "retracted_titles": f"WITH {_WORKS}, {_BAD}, {_near('asked', 'bad')} SELECT ref_id, array_to_string(list_sort(list_distinct(list(title))), '; ') AS titles FROM placed GROUP BY ref_id",
    "retraction_split": f"WITH {_WORKS}, {_BAD}, {_near('asked', 'bad')} SELECT ref_id, ref_id IN (SELECT ref_id FROM placed) AS retracted FROM asked",
    "screened_documents": f"""WITH {_WORKS}, listed AS (SELECT item_id AS ref_id, replace(title, '"', '') AS title FROM works), {_near('listed', 'works')}, {_MARKED}
      SELECT CAST(floor(l.ref_id / 20) AS BIGINT) AS doc_id, count(*) AS n_references, count(m.ref_id) AS n_retracted, coalesce(string_agg('A. B, "' || l.title || '"', chr(10) ORDER BY l.ref_id) FILTER (WHERE m.ref_id IS NOT NULL), '') AS flagged FROM listed l LEFT JOIN marked m USING (ref_id) GROUP BY 1""",
    "batch_preview": f"{_RESULTS} SELECT doc_id, string_agg('[' || pos || '] ' || formatted || chr(10) || left(report, 200), chr(10) || chr(10) ORDER BY pos) AS preview FROM res WHERE pos <= 10 GROUP BY doc_id",
    "batch_documents": f"{_RESULTS}, d AS (SELECT doc_id, string_agg('## Reference ' || pos || chr(10) || chr(10) || '**Original:** ' || reference || chr(10) || chr(10) || '**Processed:** ' || formatted || chr(10) || chr(10) || report, chr(10) || chr(10) ORDER BY pos) AS x FROM res GROUP BY doc_id) SELECT doc_id, sha256(x) AS sha, CAST(length(x) AS INTEGER) AS n FROM d",
}

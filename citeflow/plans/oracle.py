"""DuckDB SQL for the registered queries, over the same tables. Written against the tables, not generated from the plans."""

from __future__ import annotations

CAND = """
cand AS (
  SELECT l_orderkey AS ref_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS INTEGER) AS cand_ord,
    coalesce(['crossref','openalex','semanticscholar','ieeexplore','pubmed','arxiv'][l_linenumber], 'other') AS source,
    l_linenumber AS line, p_size, p_name AS title,
    ['Anna Maria ' || s_name, 'J.-P. ' || substr(p_name, 1, 5)] AS authors,
    p_brand || ' ' || p_type AS journal_name, 'B. ' || p_brand AS journal_abbrev,
    CAST(l_suppkey AS VARCHAR) AS volume, CAST(CAST(l_quantity AS INTEGER) % 12 AS VARCHAR) AS issue,
    CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS VARCHAR)
         ELSE l_partkey || CASE WHEN l_partkey % 3 = 1 THEN '-' ELSE '–' END || (l_partkey + CAST(l_quantity AS BIGINT)) END AS pages,
    CAST(year(l_shipdate) AS VARCHAR) AS year, CAST(month(l_shipdate) AS VARCHAR) AS month,
    CASE WHEN l_orderkey % 2 = 0 AND l_linenumber IN (1, 2, 4) THEN '10.1000/' || l_orderkey WHEN l_partkey % 5 = 0 THEN '10.2000/' || l_partkey END AS doi
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
), weighted AS (
  SELECT *, CASE source WHEN 'ieeexplore' THEN 1.20 WHEN 'crossref' THEN 1.00 WHEN 'openalex' THEN 0.80 WHEN 'semanticscholar' THEN 0.60 WHEN 'pubmed' THEN 0.55 WHEN 'arxiv' THEN 0.40 ELSE 0.20 END AS w,
    CASE source WHEN 'ieeexplore' THEN 0.16 WHEN 'crossref' THEN 0.12 WHEN 'openalex' THEN 0.08 WHEN 'semanticscholar' THEN 0.06 WHEN 'pubmed' THEN 0.05 WHEN 'arxiv' THEN 0.03 ELSE 0 END AS sw,
    source IN ('crossref', 'ieeexplore', 'openalex') AS sure FROM cand
)"""

REFS = """
refs AS (
  SELECT o_orderkey AS ref_id, o_custkey AS doc_id,
    CASE WHEN f.title IS NULL THEN 'untitled work ' || o_orderkey WHEN o_orderkey % 3 = 0 THEN f.title WHEN o_orderkey % 3 = 1 THEN upper(f.title) || '.' ELSE f.title || ' revisited' END AS title,
    CASE o_orderkey % 4 WHEN 0 THEN f.authors
      WHEN 1 THEN [upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' van Dyk' || c_nationkey, 'Lee, Mary-Ann', 'Kim Jr., Q.']
      WHEN 2 THEN list_transform(['A','B','C','D','E','F','G'], lambda x: x || '. Author' || c_nationkey) END AS authors,
    CASE WHEN o_orderkey % 5 = 0 THEN f.journal_name ELSE 'Journal of ' || c_mktsegment END AS journal_name,
    CAST(o_custkey AS VARCHAR) AS volume, substr(o_orderpriority, 1, 1) AS issue,
    CASE WHEN o_orderkey % 2 = 0 THEN regexp_extract(f.pages, '^(\\d+)', 1) ELSE f.pages END AS pages,
    CAST(year(o_orderdate) AS VARCHAR) AS year,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%b') ELSE CAST(month(o_orderdate) AS VARCHAR) END AS month,
    CASE WHEN o_orderkey % 4 = 0 THEN 'https://doi.org/10.1000/' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'doi:10.1000/' || o_orderkey END AS doi
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN cand f ON f.ref_id = o_orderkey AND f.cand_ord = 1
)"""

STRINGS = """
strings AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ref_id) AS pos, ref_id,
    concat_ws(', ', 'A. Author' || ref_id % 7 || ' and B. Writer' || ref_id % 5, '"' || title || ',"', '*' || journal_name || '*', 'vol. ' || volume, 'no. ' || issue,
      CASE WHEN pages <> '' THEN 'pp. ' || pages END, year,
      CASE WHEN ref_id % 2 = 0 THEN 'doi: 10.1000/' || ref_id WHEN ref_id % 9 = 0 THEN 'arXiv:2101.' || lpad(CAST(ref_id % 100000 AS VARCHAR), 5, '0') || 'v2' END) || '.' AS reference
  FROM refs
)"""

RICH = "CASE WHEN (replace({p}, '–', '-') LIKE '%-%') AND len(regexp_extract_all({p}, '\\d+')) >= 2 AND regexp_extract_all({p}, '\\d+')[1] <> regexp_extract_all({p}, '\\d+')[2] THEN 2 WHEN len(regexp_extract_all({p}, '\\d+')) = 1 THEN 1 ELSE 0 END"
WORDS = "list_sort(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')))"
FIELDS = ["title", "journal_name", "journal_abbrev", "volume", "issue", "pages", "month", "doi"]



def votes(table: str) -> str:
    return f"""
long AS (
  {' UNION ALL '.join(f"SELECT ref_id, cand_ord, source, w, '{f}' AS field, {f} AS value FROM {table} WHERE {f} <> ''" for f in FIELDS)}
), sums AS (
  SELECT ref_id, field, value, sum(w) AS weight, min(cand_ord) AS first, arg_max(source, w * 1000 - cand_ord) AS source FROM long GROUP BY ALL
), votes AS (
  SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY ref_id, field ORDER BY weight DESC, CASE WHEN field = 'pages' THEN {RICH.format(p='value')} ELSE 0 END DESC, CASE WHEN field = 'pages' THEN length(value) ELSE 0 END DESC, first) = 1
)"""


def years(table: str) -> str:
    return f"""
ycount AS (
  SELECT ref_id, coalesce(list_position(['ieeexplore','crossref','openalex','semanticscholar','pubmed','arxiv'], source), 99) AS prio, year, count(*) AS n, min(cand_ord) AS first
  FROM {table} WHERE CAST(year AS INTEGER) BETWEEN 1800 AND 2026 GROUP BY ALL
), years AS (
  SELECT ref_id, year, coalesce(['ieeexplore','crossref','openalex','semanticscholar','pubmed','arxiv'][prio], 'consensus') AS source FROM ycount
  QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY prio, n DESC, first) = 1
)"""


VOTES, YEARS = votes("weighted"), years("cand")

CLUSTERS = f"""
keyed AS (SELECT *, array_to_string({WORDS.format(t='title')}, ' ') AS k FROM weighted),
leads AS (SELECT ref_id, k, min(cand_ord) AS lead FROM keyed GROUP BY ALL),
clusters AS (SELECT ref_id, k, CAST(row_number() OVER (PARTITION BY ref_id ORDER BY lead) AS INTEGER) AS cluster FROM leads),
clustered AS (SELECT keyed.*, cluster FROM keyed JOIN clusters USING (ref_id, k))"""

MATCHES = f"""
pairs AS (
  SELECT c.ref_id, c.cand_ord, {WORDS.format(t='r.title')} AS a, {WORDS.format(t='c.title')} AS b, {WORDS.format(t="coalesce(r.journal_name, '')")} AS ja, {WORDS.format(t='c.journal_name')} AS jb,
    list_distinct(list_transform(coalesce(r.authors, []), lambda n: lower(list_last(string_split(trim(n), ' '))))) AS pa, list_distinct(list_transform(c.authors, lambda n: lower(list_last(string_split(trim(n), ' '))))) AS pb,
    '10.1000/' || r.ref_id = c.doi AND r.doi IS NOT NULL AS same, CAST(r.year AS INTEGER) - CAST(c.year AS INTEGER) AS gap, r.journal_name IS NULL AS nov, c.sw, c.sure
  FROM weighted c JOIN refs r USING (ref_id)),
sims AS (SELECT *, CAST(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS DOUBLE) AS t, CAST(CASE WHEN nov THEN 0 ELSE len(list_intersect(ja, jb)) / len(list_distinct(list_concat(ja, jb))) END AS DOUBLE) AS v,
  CASE WHEN len(pa) > 0 THEN 0.25 * len(list_intersect(pa, pb)) / len(list_distinct(list_concat(pa, pb))) ELSE -0.05 END AS p FROM pairs),
matches AS (SELECT ref_id, cand_ord, t AS near, v AS place,
  round(CAST(CASE WHEN coalesce(same, false) THEN 1.0 ELSE 0.0 END AS DOUBLE) + 0.9 * t + CAST(p AS DOUBLE) + CAST(CASE WHEN gap = 0 THEN 0.12 WHEN abs(gap) = 1 THEN -0.03 WHEN abs(gap) = 2 THEN -0.06 ELSE -0.12 END AS DOUBLE) + 0.08 * v + CAST(sw AS DOUBLE), 6) AS score,
  sure AND (coalesce(same, false) OR (t >= 0.93 AND (len(list_intersect(pa, pb)) > 0 OR abs(gap) <= 1) AND (nov OR v >= 0.80))) AS trusted FROM sims)"""

IEEE = """CASE ref_id % 4 WHEN 0 THEN coalesce('A. M. ' || split_part(authors[1], ' ', 3) || ', and J.-P. ' || CASE WHEN trim(authors[2][7:]) LIKE '% %' THEN upper(authors[2][7]) || '. ' || split_part(trim(authors[2][7:]), ' ', 2) ELSE trim(authors[2][7:]) END, '')
          WHEN 1 THEN upper(authors[1][1]) || '. V. ' || list_last(string_split(authors[1], ' ')) || ', M.-A. Lee, and Q. Kim, Jr.' WHEN 2 THEN authors[1] || ' *et al.*' ELSE '' END"""

SQL = {
    "field_votes": f"WITH {CAND}, {VOTES} SELECT ref_id, field, value, CAST(weight AS DOUBLE) AS weight, source FROM votes",
    "author_votes": f"""WITH {CAND}, n AS (SELECT ref_id, cand_ord, source, w, authors, list_transform(authors, lambda a: lower(a)) AS norm FROM weighted),
      g AS (SELECT ref_id, norm, sum(w) AS weight, min(cand_ord) AS first, arg_min(authors, cand_ord) AS authors, arg_min(source, cand_ord) AS source FROM n GROUP BY ALL)
      SELECT ref_id, array_to_string(list_transform(authors, lambda a: trim(a)), '|') AS authors, CAST(weight AS DOUBLE) AS weight, source FROM g QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY weight DESC, first) = 1""",
    "year_votes": f"WITH {CAND}, {YEARS} SELECT ref_id, year, source FROM years",
    "page_ranges": f"""WITH {CAND}, r AS (SELECT *, regexp_extract(pages, '(\\d+)', 1) AS start FROM cand WHERE {RICH.format(p='pages')} = 2)
      SELECT ref_id, start, pages AS range, source AS range_source FROM r QUALIFY row_number() OVER (PARTITION BY ref_id, start ORDER BY length(pages) DESC, cand_ord) = 1""",
    "title_clusters": f"WITH {CAND}, {CLUSTERS} SELECT ref_id, cand_ord, cluster FROM clustered",
    "cluster_ranking": f"""WITH {CAND}, {CLUSTERS}, d AS (SELECT ref_id, cluster, lower(doi) AS doi, count(*) AS n, min(cand_ord) AS first, bool_or(sure) AS sure FROM clustered WHERE doi <> '' GROUP BY ALL),
      a AS (SELECT * FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY ref_id, cluster ORDER BY n DESC, first) = 1) WHERE n >= 2 OR sure),
      s AS (SELECT ref_id, cluster, sum(w) AS weight, min(cand_ord) AS first FROM clustered GROUP BY ALL)
      SELECT s.ref_id, s.cluster, CAST(CASE WHEN a.doi IS NOT NULL THEN 100 ELSE weight END AS DOUBLE) AS score, a.doi FROM s LEFT JOIN a USING (ref_id, cluster)
      QUALIFY row_number() OVER (PARTITION BY s.ref_id ORDER BY CASE WHEN a.doi IS NOT NULL THEN 100 ELSE weight END DESC, s.first) = 1""",
    "consensus_vote": f"""WITH {CAND}, {VOTES}, {YEARS}, wide AS (SELECT ref_id, {', '.join(f"max(value) FILTER (WHERE field = '{f}') AS {f}" for f in FIELDS)} FROM votes GROUP BY ref_id),
      g AS (SELECT ref_id, list_transform(authors, lambda a: lower(a)) AS norm, sum(w) AS weight, min(cand_ord) AS first, arg_min(authors, cand_ord) AS authors FROM weighted GROUP BY ALL),
      people AS (SELECT ref_id, authors FROM g QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY weight DESC, first) = 1)
      SELECT ref_id, title, journal_name, journal_abbrev, volume, issue, pages, month, doi, year, years.source AS year_source,
        concat_ws(', ', 'A. M. ' || split_part(authors[1], ' ', 3) || ', and J.-P.' || CASE WHEN trim(substr(authors[2], 7)) LIKE '% %' THEN ' ' || upper(authors[2][7]) || '. ' || split_part(trim(substr(authors[2], 7)), ' ', 2) ELSE ' ' || trim(substr(authors[2], 7)) END,
          '"' || title || '"', '*' || journal_abbrev || '*', 'vol. ' || volume, 'no. ' || issue, 'pp. ' || replace(pages, '-', '–'),
          ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][CAST(month AS INTEGER)] || ' ' || year, 'https://doi.org/' || doi) || '.' AS formatted
      FROM wide LEFT JOIN years USING (ref_id) LEFT JOIN people USING (ref_id)""",
    "reconciled_types": f"""WITH {CAND}, {REFS}, v AS (
        SELECT ref_id, cand_ord, 0 AS nth, CASE WHEN p_size % 2 = 0 THEN 'journal article' ELSE 'conference paper' END AS type FROM cand WHERE line = 1
        UNION ALL SELECT ref_id, cand_ord, 0, 'conference paper' FROM cand WHERE line = 2 AND p_size % 3 = 0
        UNION ALL SELECT ref_id, cand_ord, 0, 'conference paper' FROM cand WHERE line = 3 AND p_size % 4 = 0
        UNION ALL SELECT ref_id, cand_ord, 1, 'journal article' FROM cand WHERE line = 3
        UNION ALL SELECT ref_id, cand_ord, 0, 'preprint' FROM cand WHERE line = 6
        UNION ALL SELECT ref_id, 0, 0, 'book' FROM refs WHERE ref_id % 10 = 0),
      c AS (SELECT ref_id, type, count(*) AS n, min(cand_ord * 10 + nth) AS first FROM v GROUP BY ALL),
      b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY n DESC, first) = 1)
      SELECT ref_id, coalesce(type, 'other') AS type FROM refs LEFT JOIN b USING (ref_id)""",
    "input_validation": """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS t, CASE WHEN doc_id % 5 = 0 THEN lang = 'en' END AS v FROM documents),
      o AS (SELECT *, trim(t, E' \\t\\n\\r') <> '' AND coalesce(v, true) AS ok FROM r)
      SELECT doc_id, ok AS is_reference, CASE WHEN ok THEN 'Reference detected, proceeding with pipeline.' WHEN trim(t, E' \\t\\n\\r') = '' THEN 'Reference missing.' ELSE 'Reference invalid or incomplete.' END AS message FROM o""",
    "journal_abbreviations": """WITH j AS (SELECT r_name || ' ' || n_name AS name, CASE WHEN n_nationkey % 5 <> 0 THEN left(r_name, 3) || '. N. ' || n_nationkey END AS iso FROM nation JOIN region ON n_regionkey = r_regionkey),
      c AS (SELECT c_custkey AS ref_id, CASE WHEN c_custkey % 6 = 0 THEN ' ' WHEN c_custkey % 6 = 1 THEN 'Unknown Journal' ELSE r_name || ' ' || n_name END AS journal_name, CASE WHEN c_custkey % 2 = 0 THEN 'Abbr.' END AS journal_abbrev
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
      o AS (SELECT c.*, iso, j.name IS NOT NULL AS known FROM c LEFT JOIN j ON c.journal_name = j.name)
      SELECT ref_id, journal_name, journal_abbrev, iso AS verified_journal_abbrev,
        CASE WHEN trim(journal_name) = '' THEN 'No journal name provided for abbreviation verification.' WHEN NOT known THEN 'Journal not found in NLM Catalog: ' || journal_name || '.'
          WHEN iso IS NULL THEN 'No standard abbreviation found for journal: ' || journal_name || '.' WHEN journal_abbrev IS NOT NULL AND lower(journal_abbrev) <> lower(iso) THEN 'Journal abbreviation corrected: ''' || journal_abbrev || ''' to ''' || iso || '''.' ELSE '' END AS abbrev_note,
        CASE WHEN trim(journal_name) = '' THEN 'Missing journal name' WHEN NOT known THEN 'Journal not found' WHEN iso IS NULL THEN 'Not found' WHEN journal_abbrev IS NOT NULL AND lower(journal_abbrev) <> lower(iso) THEN iso END AS abbrev_change FROM o""",
    "scalar_pages": f"""WITH {CAND}, p AS (SELECT ref_id, cand_ord, CASE WHEN ref_id % 17 = 0 THEN 'e' || pages ELSE pages END AS raw FROM cand), d AS (SELECT *, replace(raw, '–', '-') AS s, regexp_extract_all(raw, '\\d+') AS n FROM p)
      SELECT ref_id, cand_ord, s AS pages, s NOT LIKE '%-%' AND regexp_matches(s, '[A-Za-z]') AS is_eloc, CAST(CASE WHEN s LIKE '%-%' AND len(n) >= 2 AND n[1] <> n[2] THEN 2 WHEN len(n) = 1 THEN 1 ELSE 0 END AS INTEGER) AS richness,
        regexp_full_match(s, '\\d+') AS single, s LIKE '%-%' AND len(n) >= 2 AS is_range, n[1] AS first, CASE WHEN len(n) = 2 THEN n[1] || '–' || n[2] WHEN len(n) = 1 THEN n[1] ELSE raw END AS shown FROM d""",
    "scalar_dates": f"""WITH {CAND}, {REFS}, y AS (SELECT *, CASE ref_id % 5 WHEN 0 THEN 'Nov. ' || year WHEN 1 THEN 'x12' || year || 'b' WHEN 2 THEN '0021' ELSE year END AS y, coalesce(list_position(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], month), try_cast(month AS INTEGER)) AS m FROM refs)
      SELECT ref_id, CAST(m AS VARCHAR) AS month, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][m] AS month_name, regexp_extract(y, '\\b(1[89]\\d{{2}}|20\\d{{2}})\\b', 1) AS year,
        CASE ref_id % 5 WHEN 1 THEN coalesce(list_filter(['12' || year[1:2], '2' || year[1:3], year], lambda v: CAST(v AS INTEGER) BETWEEN 1800 AND 2100)[1], '') WHEN 2 THEN '' ELSE year END AS "window",
        CASE ref_id % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS plausible FROM y""",
    "source_weights": f"""WITH {CAND}, l AS (SELECT *, CASE source WHEN 'crossref' THEN 'Crossref' WHEN 'openalex' THEN 'OpenAlex' WHEN 'semanticscholar' THEN 'Semantic Scholar' WHEN 'ieeexplore' THEN 'IEEE Xplore' WHEN 'pubmed' THEN 'PubMed' WHEN 'arxiv' THEN 'arXiv' ELSE source END AS label FROM weighted)
      SELECT ref_id, CAST(sum(w) AS DOUBLE) AS votes, round(CAST(sum(sw) AS DOUBLE), 6) AS score, bool_or(sure) AS trusted, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels FROM l GROUP BY ref_id""",
    "parsed_references": f"""WITH {CAND}, {REFS}, {STRINGS} SELECT ref_id, title || ',' AS title, 'A. Author' || ref_id % 7 || '|' || 'B. Writer' || ref_id % 5 AS authors, CASE WHEN ref_id % 2 = 0 THEN '10.1000/' || ref_id || '.' END AS doi,
      CASE WHEN ref_id % 2 = 1 AND ref_id % 9 = 0 THEN '2101.' || lpad(CAST(ref_id % 100000 AS VARCHAR), 5, '0') WHEN ref_id % 2 = 0 THEN nullif(regexp_extract(reference, '\\s*(\\d{{4}}\\.\\d{{4,5}})', 1), '') END AS arxiv_id, nullif(replace(pages, '–', '-'), '') AS pages, volume, issue, nullif(regexp_extract(reference, '\\b((?:19|20)\\d{{2}})\\b', 1), '') AS year FROM refs JOIN strings USING (ref_id)""",
    "marked_references": f"WITH {CAND}, {REFS}, {STRINGS}, s AS (SELECT doc_id, pos, reference FROM strings WHERE doc_id % 3 = 0) SELECT doc_id, CAST(pos + 1 AS INTEGER) AS pos, reference FROM s UNION ALL SELECT DISTINCT doc_id, 1, 'Body text References' FROM s UNION ALL SELECT doc_id, 1, string_agg(reference, ' ' ORDER BY pos) FROM strings WHERE doc_id % 3 <> 0 GROUP BY doc_id",
    "extracted_references": f"WITH {CAND}, {REFS}, {STRINGS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, reference FROM strings WHERE doc_id % 3 = 0",
    "doi_lookup": f"""WITH {CAND}, {REFS} SELECT r.ref_id, c.source, c.ref_id || '-' || c.cand_ord AS cand_key, c.title FROM refs r JOIN cand c ON c.doi = '10.1000/' || r.ref_id WHERE r.doi IS NOT NULL AND c.source NOT IN ('pubmed', 'arxiv')""",
    "arxiv_lookup": f"""WITH {CAND}, {REFS} SELECT r.ref_id, c.source, c.ref_id || '-' || c.cand_ord AS cand_key, c.title FROM refs r JOIN cand c ON c.source = 'arxiv' AND c.ref_id % 100000 = r.ref_id % 100000 WHERE r.ref_id % 9 = 0 AND r.ref_id % 2 = 1""",
    "routed_files": """WITH b AS (SELECT DISTINCT o_custkey AS doc_id FROM orders JOIN customer ON o_custkey = c_custkey), e AS (SELECT doc_id, ['txt', 'tex', 'docx', 'doc', 'png', ''][doc_id % 6 + 1] AS ext FROM b)
      SELECT doc_id, ext, CASE WHEN ext = 'doc' THEN 'Legacy .doc is not supported; save as .docx' WHEN ext NOT IN ('txt', 'bbl', 'tex', 'docx', 'pdf') THEN 'Unsupported file type: .' || ext END AS reason FROM e""",
    "concatenated_texts": """WITH t AS (SELECT conv_id AS doc_id, string_agg(trim(text, E' \\t\\n\\r'), E'\\n\\n' ORDER BY turn) AS x FROM conversations WHERE turn % 3 <> 1 AND trim(text, E' \\t\\n\\r') <> '' GROUP BY conv_id)
      SELECT doc_id, sha256(x) AS sha, CAST(length(x) AS INTEGER) AS n FROM t""",
    "numbered_lines": f"WITH {CAND}, {REFS}, {STRINGS} SELECT doc_id, CAST(pos AS INTEGER) AS n, '[' || pos || '] ' || CASE WHEN ref_id % 19 = 0 THEN reference || ' [ERROR]' ELSE reference END AS line FROM strings",
    "batch_summary": "SELECT o_custkey AS doc_id, count(*) AS total, count(*) FILTER (WHERE o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0) AS success, count(*) FILTER (WHERE o_orderkey % 19 = 0) AS errors FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey",
    "fresh_requests": """WITH r AS (SELECT event_id AS request_id, ts, user_id || '/' || event_type AS ref_hash FROM events), g AS (SELECT *, lag(ts) OVER (PARTITION BY ref_hash ORDER BY ts, request_id) AS before FROM r)
      SELECT request_id, ref_hash FROM g WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) > 3600000000""",
    "feed_entries": """SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<&]*)', 1), '\\s+', ' ', 'g')) AS title, 'A. One|B. Two' AS authors, 'arXiv' AS journal_name, CAST(2000 + page_id % 25 AS VARCHAR) AS year, '2101.' || lpad(CAST(page_id AS VARCHAR), 5, '0') AS arxiv_id FROM pages
      WHERE trim(regexp_extract(html, '<title>([^<&]*)', 1)) <> ''""",
    "retraction_notices": "SELECT split_part(text, chr(10), 1) AS title, '10.8/' || item_id AS doi, '10.9/' || item_id AS update_doi, 'publisher' AS update_source, '2024-01-01' AS updated FROM benchmark WHERE item_id % 3 = 0",
    "paragraph_references": f"""WITH {CAND}, {REFS}, {STRINGS}, p AS (
        SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, reference, false AS marked FROM strings WHERE doc_id % 3 = 1
        UNION ALL SELECT doc_id, 0, 'Body text' || chr(10) || 'References' || chr(10) || string_agg('[' || pos || '] ' || reference, chr(10) ORDER BY pos), true FROM strings WHERE doc_id % 3 = 0 GROUP BY doc_id
        UNION ALL SELECT doc_id, 0, string_agg(reference, chr(10) ORDER BY pos), false FROM strings WHERE doc_id % 3 = 2 GROUP BY doc_id)
      SELECT doc_id, pos, reference, marked, regexp_matches(reference, '^([A-Z][a-z]+|[A-Z]\\.)[^\\n]{{0,60}}\\b([A-Z][a-z]+|[A-Z]\\.)') OR (length(reference) < 140 AND reference LIKE '%.') OR regexp_matches(reference, 'Proc\\.|Proceedings|IEEE') AS looks_new FROM p""",
    "match_scores": f"WITH {CAND}, {REFS}, {MATCHES} SELECT ref_id, cand_ord, round(near, 6) AS title_sim, round(place, 6) AS venue_sim, score, trusted FROM matches",
    "scalar_authors": f"""WITH {CAND}, {REFS} SELECT ref_id,
        {IEEE} AS ieee,
        CASE ref_id % 4 WHEN 0 THEN coalesce('a. m. ' || lower(split_part(authors[1], ' ', 3)) || '|j. ' || CASE WHEN trim(authors[2][7:]) LIKE '% %' THEN lower(authors[2][7]) || '. ' || lower(split_part(trim(authors[2][7:]), ' ', 2)) ELSE lower(trim(authors[2][7:])) END, '')
          WHEN 1 THEN lower(authors[1][1]) || '. v. ' || lower(list_last(string_split(authors[1], ' '))) || '|l. mary-ann|k. j. q.' WHEN 2 THEN lower(array_to_string(authors, '|')) ELSE '' END AS keys,
        CASE ref_id % 4 WHEN 0 THEN coalesce(lower(split_part(authors[1], ' ', 3)) || '|' || CASE WHEN trim(authors[2][7:]) LIKE '% %' THEN 'j.-p. ' || lower(split_part(trim(authors[2][7:]), ' ', 2)) ELSE 'j.-p. ' || lower(trim(authors[2][7:])) END, '')
          WHEN 1 THEN lower(list_last(string_split(authors[1], ' '))) || '|mary-ann|q.' WHEN 2 THEN lower(array_to_string(authors, '|')) ELSE '' END AS short_keys,
        coalesce(array_to_string(list_sort(list_distinct(list_transform(authors, lambda x: lower(list_last(string_split(trim(x), ' ')))))), '|'), '') AS surnames FROM refs""",
    "gathered_candidates": f"""WITH {CAND}, {REFS}, f AS (
        SELECT r.ref_id, c.source, c.doi, c.title, c.ref_id || '-' || c.cand_ord AS key, 1 AS kind FROM refs r JOIN cand c ON c.doi = '10.1000/' || r.ref_id WHERE r.doi IS NOT NULL AND c.source NOT IN ('pubmed', 'arxiv')
        UNION ALL SELECT r.ref_id, c.source, c.doi, c.title, c.ref_id || '-' || c.cand_ord, 0 FROM refs r JOIN cand c ON c.source = 'arxiv' AND c.ref_id % 100000 = r.ref_id % 100000 WHERE r.ref_id % 9 = 0 AND r.ref_id % 2 = 1),
      o AS (SELECT *, CAST(row_number() OVER (PARTITION BY ref_id ORDER BY list_position(['crossref','openalex','semanticscholar','ieeexplore','pubmed','arxiv'], source), kind, key) AS INTEGER) AS cand_ord FROM f),
      g AS (SELECT ref_id, source, coalesce(lower(doi), title) AS k, min(cand_ord) AS cand_ord, arg_max(struct_pack(doi := doi, title := title, key := key), cand_ord) AS last FROM o GROUP BY ALL)
      SELECT ref_id, cand_ord, source, last.doi AS doi, last.title AS title, last.key AS key FROM g""",
    "recorded_outputs": """WITH e AS (SELECT event_id, CASE WHEN event_id // 4 % 2 = 0 AND event_id % 4 < 2 THEN props END AS object FROM events) SELECT event_id AS ref_id, object, CAST(json_extract(object, '$.k') AS INTEGER) AS k FROM e""",
    "result_rows": f"""WITH {CAND}, {REFS}, {STRINGS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, ref_id, 'other' AS type, CASE WHEN ref_id % 19 = 0 THEN reference || ' [ERROR]' ELSE reference END AS formatted,
      CASE WHEN ref_id % 19 = 0 THEN 'error' WHEN ref_id % 23 = 0 THEN 'skipped' ELSE 'success' END AS status, CASE WHEN ref_id % 19 = 0 THEN 'lookup failed' END AS error FROM strings""",
    "evidence": f"""WITH {CAND}, {REFS}, l AS (
        SELECT ref_id, 0 AS a, 0 AS b, 'DOI' AS label, 'https://doi.org/10.1000/' || ref_id AS url FROM refs WHERE doi IS NOT NULL
        UNION ALL SELECT ref_id, cand_ord, 0, 'Crossref (DOI)', 'https://doi.org/' || doi FROM cand WHERE source = 'crossref'
        UNION ALL SELECT ref_id, cand_ord, 1, 'Publisher (from Crossref)', 'https://pub.org/' || ref_id FROM cand WHERE source = 'crossref'
        UNION ALL SELECT ref_id, cand_ord, 0, 'IEEE Xplore', 'https://lib.org/' || ref_id FROM cand WHERE source = 'ieeexplore'
        UNION ALL SELECT ref_id, cand_ord, 0, 'OpenAlex', 'https://oa.org/W' || ref_id FROM cand WHERE source = 'openalex'
        UNION ALL SELECT ref_id, cand_ord, 0, 'Semantic Scholar (DOI)', 'https://www.semanticscholar.org/doi/' || doi FROM cand WHERE source = 'semanticscholar'
        UNION ALL SELECT ref_id, cand_ord, 1, 'Semantic Scholar', 'https://www.semanticscholar.org/paper/' || ref_id FROM cand WHERE source = 'semanticscholar'
        UNION ALL SELECT ref_id, cand_ord, 0, 'PubMed', 'https://pubmed.ncbi.nlm.nih.gov/' || volume || '/' FROM cand WHERE source = 'pubmed'
        UNION ALL SELECT ref_id, cand_ord, 9, 'DOI', 'https://doi.org/' || doi FROM cand),
      f AS (SELECT ref_id, url, min(struct_pack(a := a, b := b, label := label)) AS f FROM l WHERE url IS NOT NULL GROUP BY ALL)
      SELECT ref_id, CAST(row_number() OVER (PARTITION BY ref_id ORDER BY f.a, f.b) AS INTEGER) AS ord, f.label AS label, url FROM f""",
}


def oracle_sql() -> dict[str, str]:
    from . import oracle_best, oracle_text

    return {**SQL, **oracle_best.SQL, **oracle_text.SQL}

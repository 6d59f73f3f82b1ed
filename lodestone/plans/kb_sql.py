"""DuckDB SQL for the knowledge-base queries."""

from __future__ import annotations

from lodestone.functions.text import DATE_FORMS, STOP_WORDS, TERMS
from lodestone.plans import tables as T

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens(text: str) -> str:
    found = f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+(?:[-''][a-z0-9]+)?'), lambda t: length(t) >= 2 AND t NOT IN ({_STOP}))"
    return f"list_transform({found}, lambda t: CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y' WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END)"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


_INDEX = f"""
tok AS (SELECT doc_id, {_tokens("text")} AS tokens FROM documents),
posts AS (SELECT doc_id, len(tokens) AS dl, term, count(*) AS tf FROM (SELECT doc_id, tokens, unnest(tokens) AS term FROM tok) GROUP BY doc_id, len(tokens), term),
sizes AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM tok),
df AS (SELECT term, count(*) AS df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts, sizes GROUP BY term),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_tokens("text")}) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25
  FROM q JOIN idf USING (term) JOIN posts USING (term), sizes GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) AS rank FROM scores)"""

_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
#: The notes, and the patterns of lines that go, as they stand in the definition.
_FURNITURE = r"(?:(?i)we use cookies)|(?:(?i)all rights reserved)|(?:(?i)^\W*(©|copyright)\b)|(?:(?i)^(home|plans|faq|partners|claims|customer login|accept)$)|(?:(?i)privacy policy\s*\|)|(?:(?i)limited period offer)|(?:(?i)^(exported by|internal only|contains customer details))|(?:^-{3,}$)|(?:(?i)^\(?superseded by .*retained for reference\)?$)"
_NOTED = T.NOTED.replace("CAST(chr(10) AS STRING)", "chr(10)")
_LINES = f"""
noted AS (SELECT doc_id, {_NOTED} AS text FROM documents),
raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM noted),
lines AS (
  SELECT *, trim(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS norm,
         CASE WHEN regexp_matches(line, '{_FURNITURE}') THEN 'boilerplate' WHEN regexp_matches(line, '\\bwindow\\.dataLayer\\b|^\\s*$') THEN 'irrelevant' END AS own FROM raw),
often AS (SELECT norm FROM lines WHERE length(norm) > 25 GROUP BY norm HAVING count(DISTINCT doc_id) >= 2),
firsts AS (SELECT norm, min({{'d': doc_id, 'l': line_no}}) AS first FROM lines WHERE own IS NULL AND norm IN (SELECT norm FROM often) GROUP BY norm),
marked AS (SELECT l.*, coalesce(own, CASE WHEN first IS NOT NULL AND first <> {{'d': doc_id, 'l': line_no}} THEN 'repeated' END, 'kept') AS status FROM lines l LEFT JOIN firsts USING (norm))"""

_TOP = f"""WITH {_INDEX},
top AS (SELECT * FROM ranked WHERE rank = 1),
qt AS (SELECT DISTINCT item_id, term FROM q),
w AS (SELECT item_id, term, greatest(coalesce(idf, (SELECT max(idf) FROM idf)), 0.1) AS w FROM qt LEFT JOIN idf USING (term)),
cov AS (SELECT w.item_id, t.doc_id, t.bm25, sum(CASE WHEN p.term IS NOT NULL THEN w ELSE 0 END) / sum(w) AS coverage
        FROM w JOIN top t USING (item_id) LEFT JOIN posts p ON p.doc_id = t.doc_id AND p.term = w.term GROUP BY w.item_id, t.doc_id, t.bm25),
conf AS (SELECT item_id, doc_id, round(coverage, 6) AS coverage, round(0.65 * round(coverage, 6) + 0.35 * least(1.0, bm25 / 12.0), 3) AS confidence FROM cov),
tiers AS (SELECT *, CASE WHEN confidence >= 0.55 THEN 'high' WHEN confidence >= 0.30 THEN 'medium' ELSE 'low' END AS tier FROM conf)"""


def _facts() -> str:
    rows = []
    for fact, (p, n) in T.FACTS.items():
        groups = [f"regexp_extract_all(text, '{p}', {g})" for g in range(1, n + 1)]
        rows.append(f"SELECT doc_id, '{fact}' AS fact, unnest(list_transform(list_zip({', '.join(groups)}), lambda x: " + " || '-' || ".join(f"x[{g}]" for g in range(1, n + 1)) + ")) AS value FROM documents")
    return " UNION ALL ".join(rows)


def _score(kws, damp=1.0) -> str:
    part = "(CASE WHEN {n} > 0 THEN (1.0 + 0.3 * least({n} - 1, 4.0)) * CASE WHEN contains(title, '{k}') THEN 2.0 ELSE 1.0 END ELSE 0.0 END)"
    return f"round(({' + '.join(part.format(k=k, n=f'''((length(whole) - length(replace(whole, '{k}', ''))) / {len(k)})''') for k in kws)}) * {damp}, 6)"


_CATS = ", ".join(f"{{'neg': -({_score(kws, 0.4 if c == 'mail' else 1.0)})::DOUBLE, 'ord': {i}, 'name': '{c}'}}" for i, (c, kws) in enumerate(T.CATEGORIES.items()))
_INTENT = " ".join(f"WHEN '{c}' THEN '{','.join(sorted(v))}'" for c, v in T.INTENTS.items())
_FLAG = " || ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN ',{n}' ELSE '' END" for n, p in T.FLAGS.items())


def _rewrites(text: str, rules=T.REWRITES) -> str:
    for p, r in rules:
        text = f"regexp_replace({text}, '{p}', '{r.replace('$', chr(92))}', 'g')"
    return text


_MONTHS = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"


def _each(text: str, pattern: str, of: str) -> str:
    """The text with each match m of the pattern replaced by `of`."""
    return f"array_to_string(list_transform(list_zip(string_split_regex({text}, '{pattern}'), list_transform(regexp_extract_all({text}, '{pattern}'), lambda m: {of})), lambda x: x[1] || coalesce(x[2], '')), '')"


def _dates() -> list[tuple[str, str, str]]:
    """(name, pattern, replacement of m) of the three forms, one after the other."""
    a, b, c = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", r"\b([A-Z][a-z]{2,8})\s+(\d{1,2}),\s+(\d{4})\b", r"\b(\d{1,2})(?:st|nd|rd|th)?[\s-]([A-Za-z]{3,9}),?[\s-](\d{4})\b"
    g = lambda p, i: f"regexp_extract(m, '{p}', {i})"
    two = lambda x: f"lpad(({x})::INT::VARCHAR, 2, '0')"
    month = lambda x: f"list_position({_MONTHS}, lower(left({x}, 3)))"
    return [
        ("t1", a, f"CASE WHEN {g(a, 1)}::INT BETWEEN 1 AND 31 AND {g(a, 2)}::INT BETWEEN 1 AND 12 THEN {g(a, 3)} || '-' || {two(g(a, 2))} || '-' || {two(g(a, 1))} ELSE m END"),
        ("t2", b, f"CASE WHEN {month(g(b, 1))} > 0 THEN {g(b, 3)} || '-' || {two(month(g(b, 1)))} || '-' || {two(g(b, 2))} ELSE m END"),
        ("t3", c, f"CASE WHEN {month(g(c, 2))} > 0 THEN {g(c, 3)} || '-' || {two(month(g(c, 2)))} || '-' || {two(g(c, 1))} ELSE m END"),
    ]


def _first_date(table: str, key: str, text: str) -> str:
    """Of each form the place of its first match, marked by a character that no text has, and its date."""
    rows = []
    for i, (p, year, month, day) in enumerate(DATE_FORMS):
        part = lambda g: f"regexp_extract(h, '{p}', {g})"  # noqa: B023, E731
        number = part(month) if i < 2 else f"list_position({_MONTHS}, lower(left({part(month)}, 3)))::VARCHAR"
        last = f"lpad({part(day)}, 2, '0')" if day else "'01'"
        rows.append(f"{{'p': strpos(regexp_replace(h, '{p}', chr(1)), chr(1)), 'f': {i}, 'd': {part(year)} || '-' || lpad({number}, 2, '0') || '-' || {last}}}")
    return f"SELECT {key}, list_sort(list_filter([{', '.join(rows)}], lambda x: x.p > 0))[1].d AS date FROM (SELECT {key}, left({text}, 600) AS h FROM {table})"


_SPACE = r"regexp_replace(regexp_replace(regexp_replace(translate(text, chr(160) || chr(8217) || chr(8211) || chr(8212), ' ''--'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\A\s+|\s+\z', '', 'g')"

ORACLES = {
    "bm25_topk": f"WITH {_INDEX} SELECT item_id, doc_id, rank::INT AS rank, bm25 FROM ranked WHERE rank <= 5 AND bm25 > 0",
    "search_confidence": f"{_TOP} SELECT * FROM tiers",
    "filter_fallback": f"""WITH {_INDEX},
c AS (SELECT s.*, lang, lang = CASE WHEN item_id % 2 = 0 THEN 'fr' ELSE 'xx' END AS ok FROM scores s JOIN documents d USING (doc_id)),
k AS (SELECT *, bool_or(ok) OVER (PARTITION BY item_id) AS has_any FROM c),
n AS (SELECT *, bm25 / max(bm25) OVER (PARTITION BY item_id) AS bm25_norm, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) AS rank FROM k WHERE ok OR NOT has_any)
SELECT item_id, doc_id, lang, rank::INT AS rank, round(bm25_norm, 6) AS bm25_norm FROM n WHERE rank <= 3""",
    "cosine_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-9 AS n FROM e),
p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_sum(list_transform(list_zip(q.v, e.v), lambda x: x[1] * x[2])) / (q.n * e.n), 6) AS cosine FROM n q JOIN n e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, rank::INT AS rank, cosine FROM r WHERE rank <= 5 AND cosine > 0""",
    "hybrid_fusion": f"""WITH {_INDEX},
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-9 AS n FROM e),
m AS (SELECT item_id, doc_id, CASE WHEN max(bm25) OVER (PARTITION BY item_id) > 0 THEN bm25 / max(bm25) OVER (PARTITION BY item_id) ELSE 0 END AS bn FROM scores),
c AS (SELECT q.vec_id AS item_id, d.vec_id AS doc_id, list_sum(list_transform(list_zip(q.v, d.v), lambda x: x[1] * x[2])) / (q.n * d.n) AS cos
      FROM n q JOIN n d ON q.vec_id IN (SELECT item_id FROM benchmark) AND d.vec_id IN (SELECT doc_id FROM documents))
SELECT item_id, doc_id, round(0.5 * coalesce(bn, 0) + 0.5 * least(1.0, greatest(0.0, coalesce(cos, 0))), 5) AS score FROM m FULL JOIN (SELECT * FROM c WHERE cos > 0) USING (item_id, doc_id)""",
    "repeated_lines": f"WITH {_LINES} SELECT norm, count(DISTINCT doc_id)::BIGINT AS n_docs FROM lines WHERE length(norm) > 25 GROUP BY norm HAVING count(DISTINCT doc_id) >= 2",
    "clean_lines": f"WITH {_LINES} SELECT doc_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("kept", "repeated", "boilerplate", "irrelevant")) + " FROM marked GROUP BY doc_id",
    "cleaned_documents": f"""WITH {_LINES} SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (status = 'kept'), '')) AS text_md5,
sum(length(line))::BIGINT AS raw_chars, coalesce(sum(length(line)) FILTER (status = 'kept'), 0)::BIGINT AS clean_chars FROM marked GROUP BY doc_id""",
    "exact_dups": f"""WITH h AS (SELECT doc_id, {_NORM} AS n, source, n_chars FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keeper, doc_id <> first_value(doc_id) OVER w AS is_duplicate FROM h WINDOW w AS (PARTITION BY n ORDER BY source DESC, n_chars DESC, doc_id)""",
    "near_dups": f"""WITH d AS (SELECT lang, min(doc_id) AS id, {_NORM} AS n FROM documents WHERE {_NORM} <> '' GROUP BY lang, {_NORM}),
w AS (SELECT *, string_split(n, ' ') AS w FROM d),
s AS (SELECT lang, id, len(w) AS k, list_distinct(CASE WHEN len(w) < 3 THEN [n] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh, list_distinct(list_filter(w, lambda x: length(x) > 2)) AS un FROM w),
xs AS (SELECT lang, id, unnest(sh) AS t FROM s), xu AS (SELECT lang, id, unnest(un) AS t FROM s),
cs AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM xs a JOIN xs b ON a.lang = b.lang AND a.t = b.t AND a.id < b.id GROUP BY ALL),
cu AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM xu a JOIN xu b ON a.lang = b.lang AND a.t = b.t AND a.id < b.id GROUP BY ALL),
p AS (SELECT coalesce(cs.a, cu.a) AS a, coalesce(cs.b, cu.b) AS b, coalesce(cs.c, 0) AS c, coalesce(cu.c, 0) AS u FROM cs FULL JOIN cu ON cs.a = cu.a AND cs.b = cu.b),
j AS (SELECT p.a, p.b, p.c / (len(x.sh) + len(y.sh) - p.c) AS js, CASE WHEN p.u = 0 THEN 0 ELSE p.u / (len(x.un) + len(y.un) - p.u) END AS ju, CASE WHEN least(len(x.un), len(y.un)) = 0 THEN 0 ELSE least(len(x.un), len(y.un)) / greatest(len(x.un), len(y.un)) END AS r FROM p JOIN s x ON x.id = p.a JOIN s y ON y.id = p.b)
SELECT a, b, round(CASE WHEN r < 0.5 THEN js ELSE greatest(js, 0.9 * ju) END, 6) AS similarity FROM j WHERE round(CASE WHEN r < 0.5 THEN js ELSE greatest(js, 0.9 * ju) END, 6) >= 0.55""",
    "pii_counts": r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.-]+'))::BIGINT AS emails, list_transform(regexp_extract_all(text, '\b(?:[0-9][ -]?){12,15}[0-9]\b'), lambda r: reverse(regexp_replace(r, '[^0-9]', '', 'g'))) AS runs FROM documents),
l AS (SELECT doc_id, emails, len(list_filter(runs, lambda r: list_sum(list_transform(range(1, length(r) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(r, i, 1)::INT ELSE substr(r, i, 1)::INT * 2 - CASE WHEN substr(r, i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0))::BIGINT AS cards FROM c)
SELECT * FROM l WHERE emails > 0 OR cards > 0""",
    "quality_flags": f"SELECT doc_id, ltrim(f, ',') AS flags FROM (SELECT doc_id, {_FLAG} AS f FROM documents) WHERE f <> ''",
    "fact_conflicts": f"""WITH f AS (SELECT DISTINCT * FROM ({_facts()})), m AS (SELECT fact FROM f GROUP BY fact HAVING count(DISTINCT value) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY fact, value ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY fact, value) AS n FROM f)
SELECT fact, value, n AS n_records, string_agg(doc_id::VARCHAR, ', ' ORDER BY nth) AS first_ids FROM r WHERE nth <= 3 AND fact IN (SELECT fact FROM m) GROUP BY fact, value, n""",
    "classify_docs": f"""WITH t AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS title, lower(split_part(text, chr(10), 1) || chr(10) || text) AS whole FROM documents),
s AS (SELECT doc_id, list_sort([{_CATS}]) AS s FROM t),
b AS (SELECT doc_id, CASE WHEN s[1].neg < 0 THEN s[1].name ELSE 'mail' END AS category, CASE WHEN -s[2].neg >= 0.6 * -s[1].neg AND -s[2].neg > 1 THEN s[2].name END AS subcategory, round(-s[1].neg + 0.0, 6) AS category_score FROM s)
SELECT *, CASE category {_INTENT} END AS intents FROM b""",
    "record_ids": "SELECT doc_id, 'kb_' || lang || '_' || source || '_' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS record_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)",
    "content_digest": """WITH h AS (SELECT left(sha1(source || chr(10) || text), 16) AS h FROM documents),
r AS (SELECT left(h, 3) AS part, sha1(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL)
SELECT count(*) AS ranges, left(sha1(string_agg(part || d, '' ORDER BY part || d)), 8) AS digest FROM r""",
    "version_bump": """WITH t AS (SELECT doc_id AS record_id, left(sha1(source || chr(10) || text), 16) AS content_hash FROM documents),
o AS (SELECT record_id, CASE WHEN record_id % 5 = 0 THEN 'other' ELSE content_hash END AS old FROM t WHERE record_id % 3 <> 0)
SELECT t.*, CASE WHEN old <> content_hash THEN '1.1' ELSE '1.0' END AS version FROM t LEFT JOIN o USING (record_id)""",
    "manifest_counts": "SELECT lang, source, count(*) AS n, count(quality) AS n_labelled, coalesce(sum(quality), 0)::BIGINT AS n_good, coalesce(sum(toxic), 0)::BIGINT AS n_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source",
    "manifest": """SELECT (SELECT count(*) FROM documents) AS n, (SELECT string_agg(lang || '=' || c, ',' ORDER BY lang) FROM (SELECT lang, count(*) AS c FROM documents GROUP BY lang)) AS by_market,
(SELECT string_agg(source || '=' || c, ',' ORDER BY source) FROM (SELECT source, count(*) AS c FROM documents GROUP BY source)) AS by_category""",
    "sample_per_category": "SELECT doc_id, source, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1",
    "normalized_text": f"""SELECT doc_id, md5({_rewrites(_SPACE)}) AS text_md5, floor(len({_words("text")}) * 1.3)::BIGINT AS token_estimate,
md5(CASE WHEN length(text) <= 420 THEN text ELSE regexp_replace(left(text, 420), '\\s\\S*\\z', '') END) AS clip_md5 FROM documents""",
    "text_shape": f"""WITH d AS (SELECT *, {_NORM} AS n FROM documents), w AS (SELECT *, list_filter(string_split(n, ' '), lambda x: x <> '') AS w FROM d)
SELECT doc_id, trim(regexp_replace(lower(source || '/' || lang), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END::BIGINT AS n_shingles,
len(list_distinct(list_filter(w, lambda x: length(x) > 2)))::BIGINT AS n_unigrams, len({_tokens("text")})::BIGINT AS n_terms, contains(lower(text), 'tion of') OR contains(lower(text), 'keit') AS has_phrase FROM w""",
    "html_boilerplate": """WITH b AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style|nav|header|footer|aside)\\b.*?</(script|style|nav|header|footer|aside)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM pages)
SELECT page_id, length(html) AS html_chars, length(t) AS text_chars, md5(t) AS text_md5, trim(split_part(regexp_extract(html, '<title>([^<]*)', 1), '|', 1), ' ') AS title FROM b""",
    "table_to_text": "SELECT p_partkey, p_name || ' - brand: ' || p_brand || '; type: ' || p_type || '; size: ' || p_size || '.' AS line FROM part",
    "csv_grouped": """SELECT p_brand AS heading, floor((p_partkey - 1) / 1000)::BIGINT AS section, md5(string_agg('(row ' || (p_partkey + 1) || ') p brand: ' || p_brand || '; p name: ' || p_name || '; p size: ' || p_size || '.', chr(10) ORDER BY p_partkey)) AS text_md5
FROM part GROUP BY ALL""",
    "tail_leads": "SELECT o_orderkey, o_orderstatus FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 50) WHERE o_orderkey % 7 <> 0",
    "retrieval_verdict": f"""{_TOP}, c AS (SELECT item_id, {_words("lower(text)")}[1:2] AS kw, item_id % 5 = 0 AS oos FROM benchmark),
h AS (SELECT r.item_id, r.rank, len(list_filter(c.kw, lambda k: NOT contains(lower(d.text), k))) = 0 AS ok FROM ranked r JOIN c USING (item_id) JOIN documents d USING (doc_id) WHERE r.rank <= 3),
b AS (SELECT c.item_id, c.oos, coalesce(bool_or(ok AND rank = 1), false) AS f, coalesce(bool_or(ok), false) AS a, any_value(tier) AS tier FROM c LEFT JOIN h USING (item_id) LEFT JOIN tiers USING (item_id) GROUP BY ALL)
SELECT item_id, CASE WHEN oos THEN CASE WHEN coalesce(tier, 'low') = 'low' THEN 'correct' WHEN tier = 'medium' THEN 'partial' ELSE 'incorrect' END WHEN f AND tier = 'high' THEN 'correct' WHEN a THEN 'partial' ELSE 'incorrect' END AS verdict FROM b""",
    "query_expansion": """SELECT item_id, md5(text || CASE WHEN e = '' THEN '' ELSE ' ' || e END) AS expanded_md5, trim(text) LIKE '%?' OR regexp_matches(trim(text), '(?i)^(what|how|can|is|do|does|who|when|why|will|are)\\b') AS question
FROM (SELECT *, array_to_string(list_filter([CASE WHEN t OR o THEN 'article' END, CASE WHEN o THEN 'genitive' END, CASE WHEN i THEN 'place' END], lambda x: x IS NOT NULL), ' ') AS e
FROM (SELECT *, regexp_matches(lower(text), '\\bthe\\b') AS t, regexp_matches(lower(text), '\\bof\\b') AS o, regexp_matches(lower(text), '\\bin\\b') AS i FROM benchmark))""",
    "embedding_cache": "SELECT DISTINCT sha1('m::' || text) AS k FROM documents WHERE sha1('m::' || text) NOT IN (SELECT sha1('m::' || text) FROM documents WHERE doc_id % 2 = 0)",
}
ORACLES |= {
    "boosted_topk": f"""WITH {_INDEX},
c AS (SELECT s.*, source, lang, contains(d.text, '|') AS faq, regexp_matches(lower(b.text), '^(the|is|in)\\b') AS question, coalesce(lang = 'en' AND source <> 'src2', false) AS ok
      FROM scores s JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
k AS (SELECT *, bool_or(ok) OVER (PARTITION BY item_id) AS has_any FROM c),
n AS (SELECT *, CASE WHEN max(bm25) OVER (PARTITION BY item_id) > 0 THEN bm25 / max(bm25) OVER (PARTITION BY item_id) ELSE 0 END AS bn FROM k WHERE ok OR NOT has_any),
f AS (SELECT *, round(bn + CASE WHEN source = 'src' || (item_id % 20) THEN 0.08 ELSE 0 END + CASE WHEN question AND faq THEN 0.05 ELSE 0 END, 6) AS score FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT item_id, doc_id, rank::INT AS rank, score FROM r WHERE rank <= 3 AND score > 0""",
    "verdict_tally": f"SELECT verdict, count(*) AS n FROM ({ORACLES['retrieval_verdict']}) GROUP BY verdict",
    "citations": "SELECT doc_id, '[' || lang || '] ' || source || CASE WHEN doc_id % 2 = 0 THEN ', part ' || doc_id ELSE '' END AS citation, lang || ' > ' || source AS path FROM documents",
    "cleaning_counts": f"WITH {_LINES} SELECT count(*) AS lines, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("boilerplate", "irrelevant", "repeated", "kept")) + " FROM marked",
    "tagged_docs": """SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '[A-Za-z0-9_.+-]+@') THEN 'mail' END, CASE WHEN regexp_matches(text, '(?i)(?:token|key|secret)\\s*=') THEN 'secret' END,
CASE WHEN contains(text, '|') THEN 'table' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents WHERE tags <> ''""",
    "outdated_docs": """WITH t AS (SELECT doc_id, regexp_matches(text, '(?i)superseded by|retained for reference|outdated') AS stale, source = 'src1' OR '20' || (20 + doc_id % 7) || '-01-31' < '2024-01-01' AS older FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN stale THEN 'contains_outdated_text' END, CASE WHEN older THEN 'older_edition' END], lambda x: x IS NOT NULL), ',') AS flags, older AS superseded FROM t""",
}
ORACLES |= {
    "normalized_terms": f"""WITH t0 AS (SELECT doc_id, {_SPACE.replace("translate(text,", f"translate({T.PHRASED},")} AS t FROM documents)"""
    + "".join(f", {n} AS (SELECT doc_id, {_each('t', p, of)} AS t FROM t{i})" for i, (n, p, of) in enumerate(_dates()))
    + f" SELECT doc_id, md5({_rewrites('t', [*TERMS, ('ACME PLUS', 'Acme Plus')])}) AS text_md5 FROM t3",
    "document_dates": _first_date("documents", "doc_id", T.DATED_TEXT),
    "page_dates": f"""WITH p AS (SELECT page_id, {T.DATED_PAGE} AS html FROM pages), f AS ({_first_date("p", "page_id", "regexp_replace(html, '<[^>]*>', ' ', 'g')")})
SELECT page_id, CASE WHEN contains(html, 'last updated on ') THEN regexp_replace(regexp_extract(html, 'last updated on (\\d{{2}}/\\d{{2}}/\\d{{4}})', 1), '(..)/(..)/(....)', '\\3-\\2-\\1') ELSE date END AS date FROM p JOIN f USING (page_id)""",
    "record_lookup": "SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents WHERE doc_id = 17",
}

#: The categories, their keywords and intents, the weights of files and the kinds of cover, as they stand in the definition.
_KEYWORDS = """waiting_periods: waiting period|30 days|36 months|24 months|12 months|survival period|initial waiting
exclusions: exclusion|not covered|excluded|cosmetic|infertility|self-inflicted|war|experimental
claims: claim|cashless|reimbursement|pre-authorisation|discharge|settle|network hospital|documents
eligibility_underwriting: entry age|underwrit|medical examination|medical test|bmi|loading|accept|decline|refer|hba1c|tobacco|smoker|ppme|pre-policy
qualification_rules: lead|qualified|referred|not eligible|voice agent|tele-sales|capture
premium_pricing: premium|rate|gst|discount|pay monthly|frequency|annual premium|cost|price|zone
objection_handling: objection|approved response|do not:|reframe|competitor|discuss with my spouse
compliance: disclosure|solicitation|prohibited|must not|recorded for quality|do-not-call|rebating|section 41
product: sum insured|floater|room rent|restoration|rider|maternity|add-on|plan|cover|benefit|feature
policy_terms: means|definition|grace period|free look|free-look|renewal|renewab|cancellation|nomination|grievance|portab
partnership: partner|commission|outlet|posp|corporate agent
forms: field |proposal form|required)|optional)
customer_service: ticket|resolution:|issue:
company: irdai|licensed|head office|branches|since 2011|members|settlement ratio|about
faq: ?"""
_PRIOR = {"eligibility_underwriting": "CASE WHEN file = 'underwriting_rules.md' THEN 2.0 ELSE 0 END", "faq": "CASE WHEN file = 'faq.md' THEN 1.0 ELSE 0 END", "product": "CASE WHEN file = 'brochure_2023.md' THEN 1.5 ELSE 0 END", "policy_terms": "CASE WHEN file = 'policy_wording.md' THEN 1.5 ELSE 0 END"}


def _kb_scores() -> str:
    part = "(CASE WHEN {n} > 0 THEN (1.0 + 0.3 * least({n} - 1, 4.0)) * CASE WHEN contains(title, '{k}') THEN 2.0 ELSE 1.0 END ELSE 0.0 END)"
    out = []
    for i, line in enumerate(_KEYWORDS.split("\n")):
        name, _, kws = line.partition(": ")
        total = " + ".join(part.format(k=k, n=f"((length(whole) - length(replace(whole, '{k}', ''))) // {len(k)})") for k in kws.split("|"))
        out.append(f"{{'neg': -round((({total}) + {_PRIOR.get(name, '0')})::DOUBLE * {0.4 if name == 'faq' else 1.0}::DOUBLE, 6), 'ord': {i}, 'name': '{name}'}}")
    return ", ".join(out)


ORACLES |= {
    "record_quality": rf"""WITH t AS (SELECT doc_id, {_NOTED} AS text FROM documents),
f AS (SELECT doc_id, 'essential_entry_age' AS fact, unnest(list_transform(list_zip(regexp_extract_all(text, '(?i)essential[^.\n]{{0,80}}?entry age (\d{{2}})\s*(?:to|-)\s*(\d{{2}})', 1), regexp_extract_all(text, '(?i)essential[^.\n]{{0,80}}?entry age (\d{{2}})\s*(?:to|-)\s*(\d{{2}})', 2)), lambda x: x[1] || '-' || x[2])) AS value FROM t
  UNION ALL SELECT doc_id, 'network_hospitals', unnest(regexp_extract_all(text, '(?i)(\d[\d,]{{3,6}})\+?\s*network hospitals', 1)) FROM t
  UNION ALL SELECT doc_id, 'claim_tat_days', unnest(regexp_extract_all(text, '(?i)average of (\d+) working days', 1)) FROM t
  UNION ALL SELECT doc_id, 'members', unnest(regexp_extract_all(text, '(?i)(\d\.\d) million members', 1)) FROM t),
c AS (SELECT doc_id, list_sort(list_distinct(list('conflicting_fact:' || fact))) AS conflicts FROM f WHERE fact IN (SELECT fact FROM f GROUP BY fact HAVING count(DISTINCT value) > 1) GROUP BY doc_id),
x AS (SELECT doc_id, list_concat(list_filter([
  CASE WHEN regexp_matches(text, '(?i)premium[^.\n]*:\s*0\b|annual premium excl gst:\s*0\b') THEN 'zero_premium_value' END,
  CASE WHEN regexp_matches(text, '(?i)pending approval|tbd|to be confirmed') THEN 'placeholder_value' END,
  CASE WHEN regexp_matches(text, '(?i)THIS LINE IS OUTDATED|legacy text') THEN 'explicit_outdated_statement' END], lambda x: x IS NOT NULL), coalesce(conflicts, [])) AS flags FROM t LEFT JOIN c USING (doc_id))
SELECT doc_id, array_to_string(flags, ',') AS flags FROM x WHERE len(flags) > 0""",
    "kb_categories": rf"""WITH n AS (SELECT doc_id, {_NOTED} AS text, {T.FILE} AS file FROM documents),
t AS (SELECT *, lower(split_part(text, chr(10), 1)) AS title, lower(split_part(text, chr(10), 1) || chr(10) || text) AS whole FROM n),
s AS (SELECT *, list_sort([{_kb_scores()}]) AS s FROM t),
b AS (SELECT doc_id, text, file, CASE WHEN s[1].neg < 0 THEN s[1].name ELSE 'faq' END AS category, CASE WHEN -s[2].neg >= 0.6::DOUBLE * -s[1].neg AND -s[2].neg > 1 THEN s[2].name END AS subcategory, round(-s[1].neg + 0.0, 6) AS category_score FROM s),
i AS (SELECT *, CASE category WHEN 'product' THEN ['product'] WHEN 'premium_pricing' THEN ['product', 'faq'] WHEN 'policy_terms' THEN ['policy'] WHEN 'waiting_periods' THEN ['policy', 'faq'] WHEN 'exclusions' THEN ['policy'] WHEN 'claims' THEN ['policy', 'faq']
  WHEN 'eligibility_underwriting' THEN ['qualification'] WHEN 'qualification_rules' THEN ['qualification'] WHEN 'objection_handling' THEN ['objection'] WHEN 'compliance' THEN ['compliance'] WHEN 'faq' THEN ['faq'] WHEN 'partnership' THEN ['product']
  WHEN 'forms' THEN ['qualification'] WHEN 'customer_service' THEN ['faq'] WHEN 'company' THEN ['product', 'faq'] END AS own FROM b)
SELECT doc_id, category, subcategory, category_score,
 array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)\bessential\b') THEN 'essential' END, CASE WHEN regexp_matches(text, '(?i)\bfamily shield\b') THEN 'family_shield' END, CASE WHEN regexp_matches(text, '(?i)\bsenior care\b') THEN 'senior_care' END,
  CASE WHEN regexp_matches(text, '(?i)\bcritical illness\b') THEN 'critical_illness_rider' END, CASE WHEN regexp_matches(text, '(?i)\bhospital cash\b') THEN 'hospital_cash_rider' END, CASE WHEN regexp_matches(text, '(?i)\bco-payment waiver\b') THEN 'copay_waiver_rider' END,
  CASE WHEN regexp_matches(text, '\bOPD\b') THEN 'opd_rider' END, CASE WHEN regexp_matches(text, '(?i)\bcredit life\b') THEN 'credit_life' END], lambda x: x IS NOT NULL), ',') AS products,
 array_to_string(list_sort(list_distinct(list_concat(own, CASE WHEN file = 'faq.md' THEN ['faq'] ELSE [] END))), ',') AS intents FROM i""",
}

#: All records against all questions, by the definition: no candidates are looked for.
_SYNONYMS = """price=premium;cost=premium;costs=premium;cheap=premium,discount;expensive=premium;kids=children;kid=children;child=children;parents=senior care;father=senior care;mother=senior care;elderly=senior care;old=age;
hospital list=network hospitals;reject=rejected,non-disclosure;sugar=diabetes;bp=hypertension;blood pressure=hypertension;smoke=tobacco;smoking=tobacco;cancel=free-look,cancellation;refund=free-look;pregnancy=maternity;
pregnant=maternity;baby=maternity,newborn;dental=dental treatment;teeth=dental treatment;eye=cataract;cataract=specific illness;pay=payment;emi=monthly;installment=monthly;tax=section 80d;switch=portability;port=portability;
transfer=portability;human=escalation;agent=advisor;manager=escalation;icu=room rent;room=room rent;bariatric=obesity,weight-control;abroad=outside india;overseas=outside india;foreign=outside india;singapore=outside india;
dubai=outside india;usa=outside india;ambulance=road ambulance;ayurveda=ayush;homeopathy=ayush;second opinion=escalation;after how long=waiting period,maternity;difference between=family shield,essential,comparison;
magkano=premium;aso=beneficiary;cicilan=angsuran,installment;dp=down payment;denda=late fee;jatuh tempo=due date;tenor=term"""
_WIDER = ", ".join(f"CASE WHEN regexp_matches(lower(t), '\\b{k.strip()}\\b') THEN [{', '.join(repr(x) for x in v.split(','))}] ELSE [] END" for k, _, v in (x.partition("=") for x in _SYNONYMS.replace("\n", "").split(";")))
_AS_SQL = lambda x: x.replace("AS STRING", "AS VARCHAR")


def _searched(hybrid: bool) -> str:
    base = "0.5 * bm25_norm + 0.5 * least(1.0, greatest(0.0, coalesce(cos, 0)))" if hybrid else "bm25_norm"
    vectors = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), vn AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-9 AS n FROM e)," if hybrid else ""
    cos = "list_sum(list_transform(list_zip(qv.v, dv.v), lambda x: x[1] * x[2])) / (qv.n * dv.n)" if hybrid else "NULL"
    join = "LEFT JOIN vn qv ON qv.vec_id = a.query_id LEFT JOIN vn dv ON dv.vec_id = a.doc_id" if hybrid else ""
    sure = "0.4 * round(coverage, 6) + 0.2 * least(1.0, bm25 / 12.0) + 0.4 * greatest(0.0, coalesce(cos, 0))" if hybrid else "0.65 * round(coverage, 6) + 0.35 * least(1.0, bm25 / 12.0)"
    return rf"""WITH {vectors}
rec AS (SELECT doc_id, source AS title, {_NOTED} AS content, lang, 'c' || (doc_id % 6) AS category, doc_id % 4 = 1 AS faq, CASE WHEN doc_id % 6 = 0 THEN ['faq', 'product'] ELSE ['policy'] END AS intents FROM documents),
r2 AS (SELECT *, list_filter([CASE WHEN regexp_matches(content, '(?i)\bessential\b') THEN 'essential' END, CASE WHEN regexp_matches(content, '(?i)\bfamily shield\b') THEN 'family_shield' END, CASE WHEN regexp_matches(content, '(?i)\bsenior care\b') THEN 'senior_care' END,
  CASE WHEN regexp_matches(content, '(?i)\bcritical illness\b') THEN 'critical_illness_rider' END], lambda x: x IS NOT NULL) AS products FROM rec),
tok AS (SELECT doc_id, {_tokens("title || chr(10) || title || chr(10) || content")} AS tokens FROM rec),
posts AS (SELECT doc_id, len(tokens) AS dl, term, count(*) AS tf FROM (SELECT doc_id, tokens, unnest(tokens) AS term FROM tok) GROUP BY doc_id, len(tokens), term),
sizes AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM tok),
df AS (SELECT term, count(*) AS df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts, sizes GROUP BY term),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
q0 AS (SELECT item_id AS query_id, {_AS_SQL(T.QUESTION)} AS said, {", ".join(f"{v} AS w_{n}" for n, v in T.WANTED.items())}, {T.EXCLUDED} AS without FROM benchmark),
q1 AS (SELECT *, {_rewrites("said", TERMS)} AS t FROM q0),
q2 AS (SELECT *, list_filter(flatten([{_WIDER}]), lambda x: true) AS wider FROM q1),
q3 AS (SELECT *, t || CASE WHEN len(wider) > 0 THEN ' ' || array_to_string(list_filter(list_transform(range(1, len(wider) + 1), lambda i: CASE WHEN list_position(wider, wider[i]) = i THEN wider[i] END), lambda x: x IS NOT NULL), ' ') ELSE '' END AS expanded FROM q2),
q4 AS (SELECT *, {_tokens("expanded")} AS qt, trim(said) LIKE '%?' OR regexp_matches(trim(said), '(?i)^(what|how|can|is|do|does|who|when|why|will|are)\b') AS question,
  list_filter([CASE WHEN regexp_matches(said, '(?i)\bessential\b') THEN 'essential' END, CASE WHEN regexp_matches(said, '(?i)\bfamily (?:shield|floater|plan)\b') THEN 'family_shield' END, CASE WHEN regexp_matches(said, '(?i)\bsenior|parents?\b') THEN 'senior_care' END,
  CASE WHEN regexp_matches(said, '(?i)\bcritical illness\b') THEN 'critical_illness_rider' END], lambda x: x IS NOT NULL) AS named FROM q3),
qterm AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(qt) AS term FROM q4) GROUP BY ALL),
b AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM qterm JOIN idf USING (term) JOIN posts USING (term), sizes GROUP BY query_id, doc_id),
a0 AS (SELECT q.query_id, r.doc_id, coalesce((w_market IS NULL OR lang = w_market) AND (w_category IS NULL OR category = w_category) AND (w_intent IS NULL OR list_contains(intents, w_intent)) AND (w_product IS NULL OR list_contains(products, w_product)), false) AND NOT (without AND category IN ('c2', 'c3')) AS ok,
  CASE WHEN len(list_intersect(named, products)) > 0 THEN 0.08 ELSE 0 END + CASE WHEN question AND faq THEN 0.05 ELSE 0 END AS boost FROM q4 q, r2 r),
a1 AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS passed FROM a0),
a AS (SELECT a1.*, coalesce(bm25, 0) AS bm25 FROM a1 LEFT JOIN b USING (query_id, doc_id) WHERE ok OR NOT passed),
n AS (SELECT a.*, CASE WHEN max(bm25) OVER (PARTITION BY query_id) > 0 THEN bm25 / max(bm25) OVER (PARTITION BY query_id) ELSE 0 END AS bm25_norm, {cos} AS cos FROM a {join}),
s AS (SELECT *, round({base} + boost, 6) AS score FROM n),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3),
hit AS (SELECT top.*, list_filter(list_transform(range(1, len(qt) + 1), lambda i: CASE WHEN list_position(qt, qt[i]) = i AND list_contains(tokens, qt[i]) THEN qt[i] END), lambda x: x IS NOT NULL) AS matched FROM top JOIN q4 USING (query_id) JOIN tok USING (doc_id) WHERE score > 0),
w AS (SELECT DISTINCT query_id, term, greatest(coalesce(idf, (SELECT max(idf) FROM idf)), 0.1) AS w FROM qterm LEFT JOIN idf USING (term)),
cov AS (SELECT h.query_id, sum(CASE WHEN p.term IS NOT NULL THEN w ELSE 0 END) / sum(w) AS coverage FROM hit h JOIN w USING (query_id) LEFT JOIN posts p ON p.doc_id = h.doc_id AND p.term = w.term WHERE h.rank = 1 GROUP BY h.query_id),
conf AS (SELECT q.query_id, q.said, CASE WHEN h.doc_id IS NULL THEN 0 ELSE round({sure.replace("coverage", "coalesce(coverage, 0)")}, 3) END AS c, (SELECT count(*) FROM hit x WHERE x.query_id = q.query_id) AS n_hits FROM q4 q LEFT JOIN hit h ON h.query_id = q.query_id AND h.rank = 1 LEFT JOIN cov ON cov.query_id = q.query_id),
answers AS (SELECT query_id, n_hits, CASE WHEN regexp_matches(said, '(?i)\b(stock price|share price|ceo|cfo|motor insurance|car insurance)\b') THEN least(c, 0.29) ELSE c END AS confidence FROM conf)"""


ORACLES |= {
    "kb_search": f"{_searched(False)} SELECT query_id, rank::INT AS rank, doc_id, score, bm25, md5('matched terms: ' || CASE WHEN len(matched) > 0 THEN array_to_string(matched, ', ') ELSE 'none' END) AS explanation_md5 FROM hit",
    "kb_answers": f"{_searched(False)} SELECT query_id, 'bm25' AS mode, n_hits, confidence, CASE WHEN confidence >= 0.55 THEN 'high' WHEN confidence >= 0.30 THEN 'medium' ELSE 'low' END AS tier, confidence >= 0.55 AS grounded FROM answers",
    "kb_search_hybrid": f"{_searched(True)} SELECT query_id, rank::INT AS rank, doc_id, round(score, 3) AS score, round(cos, 4) AS cosine, 'hybrid' AS mode, round(confidence, 2) AS confidence, n_hits FROM hit JOIN answers USING (query_id)",
}

#: Sentences and their windows: a mark that no text has is put where a sentence ends; the packer is a recursion over windows.
_UNITS = r"""
par AS (SELECT doc_id, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: trim(p, ' ')), lambda p: p <> '') AS p FROM documents),
units AS (SELECT doc_id, text, flatten(list_transform(p, lambda p: CASE WHEN p LIKE '- %' OR p LIKE '(row%' THEN [p] ELSE list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') END)) AS u FROM par)"""
_N_WORDS = r"len(list_filter(string_split_regex({}, '\s+'), lambda w: w <> ''))"
ORACLES |= {
    "sentence_counts": f"WITH {_UNITS} SELECT doc_id, len(u)::BIGINT AS n_sentences, md5(array_to_string(u, '|')) AS sentences_md5 FROM units",
    "sentence_chunks": f"""WITH RECURSIVE {_UNITS},
sized AS (SELECT doc_id, text, u, list_transform(u, lambda x: {_N_WORDS.format("x")}) AS z, {_N_WORDS.format("coalesce(text, '')")} AS n FROM units),
whole AS (SELECT doc_id, coalesce(text, '') AS content, 1::BIGINT AS nth FROM sized WHERE n <= 220),
summed AS (SELECT *, list_transform(range(0, len(z) + 1), lambda i: coalesce(list_sum(z[1:i]), 0)) AS before FROM sized WHERE n > 220),
win AS (
  SELECT doc_id, 0::BIGINT AS first, 0::BIGINT AS stop, 0::BIGINT AS nth FROM summed
  UNION ALL SELECT doc_id, f, greatest(stop + 1, len(list_filter(before, lambda b: b <= before[f + 1] + 140)) - 1), nth + 1 FROM (
    SELECT s.doc_id, s.before, s.z, w.stop, w.nth, w.stop - CASE WHEN w.stop > 0 AND s.z[w.stop] < 73 THEN 1 ELSE 0 END AS f FROM win w JOIN summed s USING (doc_id) WHERE w.stop < len(s.u))),
cuts AS (SELECT doc_id, nth, CASE WHEN len(list_filter(u[first + 1:stop], lambda x: x LIKE '- %' OR x LIKE '(row%')) > 0 THEN array_to_string(u[first + 1:stop], chr(10)) ELSE array_to_string(u[first + 1:stop], ' ') END AS content FROM win JOIN summed USING (doc_id) WHERE nth > 0),
kept AS (SELECT *, {_N_WORDS.format("content")} AS words FROM (SELECT doc_id, content, nth FROM whole UNION ALL SELECT doc_id, content, nth FROM cuts))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS chunk_index, words::BIGINT AS n_words, floor(words * 1.3)::BIGINT AS token_estimate, md5(content) AS content_md5 FROM kept WHERE words >= 4""",
    "explained_hits": f"""WITH {_INDEX}, top AS (SELECT item_id, doc_id FROM ranked WHERE rank = 1 AND bm25 > 0),
m AS (SELECT top.*, {_tokens("b.text")} AS q, tokens FROM top JOIN benchmark b USING (item_id) JOIN tok USING (doc_id)),
x AS (SELECT *, list_filter(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN list_position(q, q[i]) = i AND list_contains(tokens, q[i]) THEN q[i] END), lambda t: t IS NOT NULL) AS matched FROM m)
SELECT item_id, doc_id, 'matched terms: ' || CASE WHEN len(matched) > 0 THEN array_to_string(matched, ', ') ELSE 'none' END AS explanation FROM x""",
}

#: Near duplicates in order, one after the other; `gone` holds what has been superseded.
ORACLES["near_dup_keepers"] = f"""WITH RECURSIVE pairs AS MATERIALIZED ({ORACLES["near_dups"]}),
p AS MATERIALIZED (SELECT a, b, row_number() OVER (ORDER BY a, b) AS n, coalesce(x.source, '0000-00-00') AS ra, coalesce(y.source, '0000-00-00') AS rb FROM pairs JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b),
r AS (
  SELECT 0::BIGINT AS n, CAST([] AS BIGINT[]) AS gone, NULL::BIGINT AS loser, NULL::BIGINT AS keeper
  UNION ALL SELECT n, CASE WHEN loser IS NULL THEN gone ELSE list_append(gone, loser) END, loser, keeper FROM (
    SELECT p.n, gone, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN NULL WHEN rb > ra THEN a ELSE b END AS loser, CASE WHEN rb > ra THEN b ELSE a END AS keeper FROM r JOIN p ON p.n = r.n + 1))
SELECT loser AS id, keeper AS superseded_by FROM r WHERE loser IS NOT NULL"""

_PIECE = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'"


def _found(texts: str, key: str) -> str:
    """texts: (key, t); p: (phrase). found: (key, phrase, run, n, first_at)."""
    return rf"""pc AS (SELECT DISTINCT phrase, regexp_replace(regexp_replace(lower(phrase), '^[^\p{{L}}\p{{N}}_]+', ''), '[^\p{{L}}\p{{N}}_]+$', '') AS run FROM p WHERE phrase IS NOT NULL),
cand AS (SELECT {key}, phrase, run, lower(t) AS t FROM {texts} JOIN pc ON run <> '' AND contains(lower(t), run)),
cut_ AS (SELECT {key}, phrase, run, regexp_extract_all(t, {_PIECE}) AS l, len(regexp_extract_all(run, {_PIECE})) AS m FROM cand),
at_ AS (SELECT {key}, phrase, run, l, list_filter(range(1, len(l) - m + 2), lambda i: array_to_string(l[i:i + m - 1], '') = run) AS a FROM cut_),
found AS (SELECT {key}, phrase, run, len(a)::BIGINT AS n, (1 + len(list_filter(l[1:a[1] - 1], lambda w: regexp_matches(w, '^[\p{{L}}\p{{N}}_]'))))::INT AS first_at FROM at_ WHERE len(a) > 0)"""


def _opening(words: int) -> str:
    return rf"regexp_extract(text, '[\p{{L}}\p{{N}}_]+(?:[^\p{{L}}\p{{N}}_]+[\p{{L}}\p{{N}}_]+){{{words - 1}}}')"


#: Synonyms, as literals of the SQL's own, in their order.
_SYNONYMS = """('price', 'premium'), ('cost', 'premium'), ('costs', 'premium'), ('cheap', 'premium|discount'), ('expensive', 'premium'), ('kids', 'children'), ('kid', 'children'), ('child', 'children'),
('parents', 'senior care'), ('father', 'senior care'), ('mother', 'senior care'), ('elderly', 'senior care'), ('old', 'age'), ('hospital list', 'network hospitals'), ('reject', 'rejected|non-disclosure'),
('sugar', 'diabetes'), ('bp', 'hypertension'), ('blood pressure', 'hypertension'), ('smoke', 'tobacco'), ('smoking', 'tobacco'), ('cancel', 'free-look|cancellation'), ('refund', 'free-look'),
('pregnancy', 'maternity'), ('pregnant', 'maternity'), ('baby', 'maternity|newborn'), ('dental', 'dental treatment'), ('teeth', 'dental treatment'), ('eye', 'cataract'), ('cataract', 'specific illness'),
('pay', 'payment'), ('emi', 'monthly'), ('installment', 'monthly'), ('tax', 'section 80d'), ('switch', 'portability'), ('port', 'portability'), ('transfer', 'portability'), ('human', 'escalation'), ('agent', 'advisor'), ('manager', 'escalation'), ('icu', 'room rent'),
('room', 'room rent'), ('bariatric', 'obesity|weight-control'), ('abroad', 'outside india'), ('overseas', 'outside india'), ('foreign', 'outside india'), ('singapore', 'outside india'), ('dubai', 'outside india'),
('usa', 'outside india'), ('ambulance', 'road ambulance'), ('ayurveda', 'ayush'), ('homeopathy', 'ayush'), ('second opinion', 'escalation'), ('after how long', 'waiting period|maternity'),
('difference between', 'family shield|essential|comparison'), ('magkano', 'premium'), ('aso', 'beneficiary'), ('cicilan', 'angsuran|installment'), ('dp', 'down payment'), ('denda', 'late fee'),
('jatuh tempo', 'due date'), ('tenor', 'term')"""
ORACLES |= {
    "phrase_hits": f"WITH p AS (SELECT {_opening(3)} AS phrase FROM benchmark), d AS (SELECT doc_id, text AS t FROM documents), {_found('d', 'doc_id')} SELECT doc_id, phrase, n, first_at FROM found",
    "phrase_labels": f"""WITH o AS (SELECT 'g' || (item_id % 4) AS label, unnest([{_opening(2)}, {_opening(3)}]) AS phrase FROM benchmark), p AS (SELECT phrase FROM o), d AS (SELECT doc_id, text AS t FROM documents), {_found('d', 'doc_id')},
s AS (SELECT doc_id, label, count(DISTINCT run) AS score FROM found JOIN (SELECT DISTINCT * FROM o) USING (phrase) GROUP BY ALL)
SELECT doc_id, label, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label)::INT AS rank FROM s""",
    "expanded_turns": f"""WITH y AS (SELECT phrase, string_split(words, '|') AS words, row_number() OVER () AS place FROM (VALUES {_SYNONYMS}) v(phrase, words)), said AS (SELECT conv_id, turn, {T.SPOKEN} AS t FROM conversations),
hit AS (SELECT conv_id, turn, unnest(words) AS word, 100 * place + generate_subscripts(words, 1) AS place FROM said JOIN y ON regexp_matches(lower(t), '(^|[^\\p{{L}}\\p{{N}}_])' || phrase || '($|[^\\p{{L}}\\p{{N}}_])')),
once AS (SELECT conv_id, turn, word, min(place) AS place FROM hit GROUP BY ALL),
more AS (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY place) AS more FROM once GROUP BY ALL)
SELECT conv_id, turn, md5(t || coalesce(' ' || more, '')) AS expanded_md5, more IS NOT NULL AS grown FROM said LEFT JOIN more USING (conv_id, turn)""",
}

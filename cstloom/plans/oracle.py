"""DuckDB SQL of the core queries, over the same whole tables."""

from __future__ import annotations

# Fixed values, stated here on their own so that they also check the engine's lists.
STOPWORDS = (
    "a abstract all an and any are as assert async at await be been bool break but by can catch class const constructor continue could def default del dict "
    "did do does else enum enumerate exec export extends false filter finally float for from function global had has have he her him i if import in "
    "instanceof int interface is it lambda len let list map max may me might min module must namespace new nonlocal null of on or pass print private "
    "protected prototype public range reduce return set she should static str sum super that the them these they this those to true try tuple typeof "
    "undefined us var was we were while will with would yield you zip "
).split()
EXTENSION_LANGUAGES = dict([(".py", "python"), (".js", "javascript"), (".jsx", "javascript"), (".mjs", "javascript"), (".rs", "rust"), (".go", "go"), (".cpp", "cpp"), (".cc", "cpp"), (".cxx", "cpp"), (".c++", "cpp"), (".c", "c"), (".h", "c"), (".hpp", "cpp"), (".hxx", "cpp"), (".java", "java"), (".cs", "csharp"), (".ts", "typescript"), (".tsx", "tsx")])
EXCLUDED_PATHS = ['.git', '.svn', '__pycache__', 'node_modules', 'target', 'build', 'dist', '.next', '.terraform']

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_SPACE = r" \t\n\r\f\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _words(column: str, pattern: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({column}, ''), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '{pattern}'))"


_TOKEN = "^[a-zA-Z_][a-zA-Z0-9_]*$"


def _clean(column: str) -> str:
    out = column
    for pattern, by, flags in ((r"(?m)//.*$", "", "g"), (r"(?s)/\*.*?\*/", "", "g"), (r"(?m)#.*$", "", "g"), (r'"[^"]*"', "", "g"), (r"''[^'']*''", "", "g"), (r"`[^`]*`", "", "g"), (rf"[^\p{{L}}\p{{N}}_.{_SPACE}]", " ", "g")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', '{flags}')"
    return out


_VALID = f"(length({{0}}) > 1 AND {{0}} NOT IN ({_STOP}) AND NOT regexp_matches({{0}}, '^[0-9]+$'))"
_CLEANED = rf"cleaned AS (SELECT doc_id, lower({_clean('text')}) AS t FROM documents WHERE text IS NOT NULL), kept AS (SELECT doc_id, t FROM cleaned WHERE regexp_matches(t, '[^{_SPACE}]'))"
_TERMS = f"""
{_CLEANED},
words AS (SELECT doc_id, {_words('t', _TOKEN)} AS w FROM kept),
terms AS (
  SELECT doc_id, unnest(w) AS term FROM words
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM words WHERE len(w) > 1
),
counted AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM terms GROUP BY term),
top AS (SELECT * FROM counted WHERE df >= 2 AND df <= 0.8 * (SELECT count(*) FROM kept) ORDER BY tf DESC, term LIMIT @MOST)
"""
_ALL_VALID = "len(list_filter(string_split(term, ' '), lambda p: NOT " + _VALID.format("p") + ")) = 0"

_DISTANCE = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)))"


def _top(where: str = "") -> str:
    return f"""
SELECT vec_id, round(d, 6) AS distance, {{more}} row_number() OVER (ORDER BY d, vec_id)::INTEGER AS rank FROM (
  SELECT e.vec_id, {_DISTANCE.format(a='e.embedding', b='q.embedding')} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q {where}
) ORDER BY d, vec_id LIMIT 5"""


_JOINED = "CASE WHEN len({0}) > 0 THEN array_to_string(list_filter(list_transform({0}, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> ''), ' | ') END"
_AGAIN = "list_filter(list_transform(string_split({0}, ' | '), lambda x: trim(x)), lambda x: x <> '')"
_LISTED = "CASE WHEN len({0}) > 0 THEN '{1}' || array_to_string(list_slice(list_sort({0}), 1, {2}), ', ') END"
_ENHANCED = f"""concat_ws(chr(10),
  CASE WHEN summary <> '' THEN 'Summary: ' || summary END, 'Type: ' || coalesce(chunk_type, 'unknown'), 'Language: ' || coalesce(language, 'unknown'), 'Name: ' || coalesce(name, 'unnamed'),
  CASE WHEN parent_name <> '' THEN 'Parent: ' || parent_name END, {_LISTED.format('keywords', 'Keywords: ', 10)}, {_LISTED.format('dependencies', 'Uses: ', 5)}, 'Code:' || chr(10) || coalesce(text, ''))"""
_EXTENSION = r"lower(regexp_extract(filepath, '[^/](\.[^./]+)$', 1))"
_LANGUAGES = ", ".join(f"('{e}', '{n}')" for e, n in sorted(EXTENSION_LANGUAGES.items()))

# The weights of a keyword's score.
_SCORE = """round(least(0.1::DOUBLE * ((length(low) - length(replace(low, k, ''))) // length(k)), 1.0::DOUBLE) + least(0.05::DOUBLE * length(word), 0.5::DOUBLE)
  + CASE WHEN known THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(word, '_|^.+[A-Z]') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN strpos(low, k) > 0 THEN greatest(0.0::DOUBLE, 0.2::DOUBLE - 0.2::DOUBLE * (strpos(low, k) - 1) / length(low)) ELSE 0.0::DOUBLE END, 9)"""


def _listed(kind: int, words: str) -> str:
    return f"SELECT doc_id, {kind} AS kind, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS word FROM (SELECT doc_id, {words} AS l FROM docs)"


_KEYWORDS = f"""
WITH {_TERMS.replace("@MOST", "1000")}, vocab AS (SELECT term FROM top WHERE {_ALL_VALID}),
docs AS (SELECT doc_id, text, lower(text) AS low, list_transform({_words(_clean('text'), _TOKEN)}, lambda x: lower(x)) AS w FROM documents WHERE regexp_matches(text, '[^{_SPACE}]')),
said AS ({_listed(1, 'w')}),
pairs AS (SELECT a.doc_id, 5 AS kind, a.pos, a.word || '_' || b.word AS word FROM said a JOIN said b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE length(a.word) > 1 AND length(b.word) > 1 AND a.word NOT IN ({_STOP}) AND b.word NOT IN ({_STOP})),
found AS (
  SELECT said.* FROM said JOIN vocab ON term = word UNION ALL {_listed(2, _words('text', '^[a-z]+([A-Z][a-z]*)+$'))} UNION ALL {_listed(3, _words('text', '^[a-z]+(_[a-z]+)+$'))}
  UNION ALL {_listed(4, f"list_transform(list_filter({_words('text', '^[A-Z]+(_[A-Z]+)*$')}, lambda x: length(x) > 2), lambda x: lower(x))")} UNION ALL SELECT * FROM pairs),
firsts AS (SELECT doc_id, lower(word) AS k, arg_min(word, kind::BIGINT * 1000000000 + pos) AS word, min(kind::BIGINT * 1000000000 + pos) AS place FROM found WHERE length(word) > 1 AND lower(word) NOT IN ({_STOP}) AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY doc_id, lower(word)),
scored AS (SELECT doc_id, word, place, {_SCORE} AS score FROM (SELECT f.*, d.low, v.term IS NOT NULL AS known FROM firsts f JOIN docs d ON f.doc_id = d.doc_id LEFT JOIN vocab v ON v.term = f.k)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS rank FROM scored)
SELECT doc_id, rank::INTEGER AS rank, word AS keyword, round(score, 6) AS score FROM ranked WHERE rank <= 10"""

SQL = {
    "vector_topk": _top().format(more="round(1 - d, 6) AS similarity,"),
    "vector_topk_filtered": _top("WHERE e.label = 3").format(more=""),
    "vector_topk_cosine": """
SELECT vec_id, round(d, 6) AS distance, row_number() OVER (ORDER BY d, vec_id)::INTEGER AS rank FROM (
  SELECT e.vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
) ORDER BY d, vec_id LIMIT 5""",
    "vector_topk_batch": f"""
SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, {_DISTANCE.format(a='e.embedding', b='q.embedding')} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)
) WHERE rank <= 5""",
    "collection_stats": "SELECT count(*) AS vectors, min(len(embedding))::INTEGER AS least_dimension, max(len(embedding))::INTEGER AS dimension FROM embeddings",
    "sample_group_counts": "SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 100) GROUP BY 1",
    "language_counts": "SELECT language, count(*) AS n FROM (SELECT DISTINCT ON (chunk_no) * FROM chunks) GROUP BY language",
    "type_counts": "SELECT chunk_type, count(*) AS n FROM (SELECT DISTINCT ON (chunk_no) * FROM chunks) GROUP BY chunk_type",
    "parse_outcomes": "SELECT count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE NOT success) AS failures, count(*) FILTER (WHERE success IS NULL) AS unknown FROM parse_results",
    "top_keywords": "SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM (SELECT DISTINCT ON (chunk_no) * FROM chunks)) GROUP BY keyword ORDER BY n DESC, keyword LIMIT 10",
    "load_summary": "SELECT count(*) AS total, count(*) FILTER (WHERE len(embedding) = 64) AS loaded, count(*) - count(*) FILTER (WHERE len(embedding) = 64) AS failed, round(100.0 * count(*) FILTER (WHERE len(embedding) = 64) / count(*), 6) AS loaded_percent FROM chunk_vectors",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
    "tokenize": f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {_words('text', _TOKEN)} AS t FROM documents)",
    "identifiers": f"""SELECT doc_id, array_to_string({_words('text', '^[a-z]+([A-Z][a-z]*)+$')}, ' ') AS camel, array_to_string({_words('text', '^[a-z]+(_[a-z]+)+$')}, ' ') AS snake,
  array_to_string(list_transform(list_filter({_words('text', '^[A-Z]+(_[A-Z]+)*$')}, lambda w: length(w) > 2), lambda w: lower(w)), ' ') AS const FROM documents""",
    "bigrams": f"""
WITH words AS (SELECT {_words('text', _TOKEN)} AS w FROM documents),
pairs AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS p FROM words WHERE len(w) > 1)
SELECT lower(p.a || '_' || p.b) AS bigram, count(*) AS n FROM pairs
WHERE length(p.a) > 1 AND length(p.b) > 1 AND lower(p.a) NOT IN ({_STOP}) AND lower(p.b) NOT IN ({_STOP}) GROUP BY 1""",
    "vocab_tfidf": f"WITH {_TERMS.replace("@MOST", "1000")} SELECT term, tf::BIGINT AS tf, df FROM top WHERE {_ALL_VALID}",
    "vocab_frequency": f"""
WITH {_CLEANED}, words AS (SELECT unnest({_words('t', _TOKEN)}) AS term FROM kept),
top AS (SELECT term, count(*) AS tf FROM words WHERE {_VALID.format('term')} GROUP BY term ORDER BY tf DESC, term LIMIT 2000)
SELECT term, tf FROM top WHERE tf > 1 AND tf < 0.8 * (SELECT count(*) FROM kept) ORDER BY tf DESC, term LIMIT 1000""",
    "vocab_containment": f"""
WITH {_TERMS.replace("@MOST", "1000")}, vocab AS (SELECT list(term ORDER BY term) AS v FROM top WHERE {_ALL_VALID})
SELECT doc_id, array_to_string(list_filter(v, lambda x: contains(lower(coalesce(text, '')), x)), '|') AS terms FROM documents, vocab""",
    "truncate_text": "SELECT doc_id, CASE WHEN length(text) > 1000 THEN substring(text, 1, 997) || '...' ELSE text END AS cut FROM documents",
    "enhanced_text": f"SELECT chunk_no, {_ENHANCED} AS document FROM (SELECT DISTINCT ON (chunk_no) * FROM chunks)",
    "extract_code": f"SELECT chunk_no, substring(document, strpos(document, 'Code:' || chr(10)) + 6) AS code FROM (SELECT chunk_no, {_ENHANCED} AS document FROM (SELECT DISTINCT ON (chunk_no) * FROM chunks))",
    "metadata_flatten": f"SELECT chunk_no, {_JOINED.format('keywords')} AS keywords, {_JOINED.format('dependencies')} AS dependencies, CASE WHEN trim(docstring) <> '' THEN trim(docstring) END AS docstring FROM (SELECT DISTINCT ON (chunk_no) * FROM chunks)",
    "metadata_roundtrip": f"SELECT chunk_no, array_to_string({_AGAIN.format('k')}, ',') AS keywords, CASE WHEN k IS NULL THEN NULL ELSE len({_AGAIN.format('k')}) END AS n FROM (SELECT chunk_no, {_JOINED.format('keywords')} AS k FROM (SELECT DISTINCT ON (chunk_no) * FROM chunks))",
    "chunk_ids": "SELECT chunk_no, concat_ws(':', filepath, chunk_type, name, line_start) || '_' || substring(md5(concat_ws(':', filepath, chunk_type, name, line_start, line_end)), 1, 8) AS made_id FROM (SELECT DISTINCT ON (chunk_no) * FROM chunks)",
    "dedupe_ids": """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY chunk_no, loaded_at) AS n FROM chunks),
b AS (SELECT chunk_no, loaded_at, CASE WHEN n = 1 THEN id ELSE id || '_' || substring(md5(filepath || ':' || substring(coalesce(text, ''), 1, 100)), 1, 8) END AS id2 FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY id2 ORDER BY chunk_no, loaded_at) AS m FROM b)
SELECT chunk_no, CASE WHEN m = 1 THEN id2 ELSE id2 || '_' || (m - 1) END AS id FROM c""",
    "batch_assign": "SELECT batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 + 1 AS batch FROM documents) GROUP BY batch",
    "scan_filter": "SELECT DISTINCT filepath FROM parse_results WHERE " + " AND ".join(f"NOT contains(filepath, '{x}')" for x in EXCLUDED_PATHS),
    "language_detect": f"SELECT filepath AS path, l.language FROM (SELECT DISTINCT filepath FROM parse_results) p LEFT JOIN (VALUES {_LANGUAGES}) l(extension, language) ON {_EXTENSION} = l.extension",
    "unsupported_files": f"SELECT filepath, {_EXTENSION} AS extension FROM (SELECT DISTINCT filepath FROM parse_results) WHERE {_EXTENSION} NOT IN (SELECT extension FROM (VALUES {_LANGUAGES}) l(extension, language))",
    "graph_edge_upsert": "SELECT src, dst, type FROM (SELECT o_custkey AS src, o_orderstatus AS dst, o_orderpriority AS type, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "keyword_scores_top10": _KEYWORDS,
    "embed_chunks": f"SELECT id, 384::INTEGER AS dimension, {_ENHANCED} AS document, language, chunk_type FROM (SELECT DISTINCT ON (chunk_no) * FROM chunks) WHERE id IS NOT NULL",
}

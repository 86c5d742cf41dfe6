"""DuckDB SQL for the registered queries, written apart from the operators that it checks."""

from __future__ import annotations

_WORD = r"[A-Za-z]+(?:''[A-Za-z]+)?|\d+(?:\.\d+)?|[^\s]"
_ASCII = "regexp_replace(strip_accents(replace(lower({}), 'ß', 'ss')), '[^\\x00-\\x7F]', '', 'g')"
_SEARCH = _ASCII.format(r"regexp_replace(text, '^\s+|\s+$', '', 'g')")
_WORDS = f"regexp_extract_all(text, '{_WORD}')"
_STRIPPED_WORDS = rf"regexp_extract_all(regexp_replace(text, '^\s+|\s+$', '', 'g'), '{_WORD}')"
_PUNCTUATED = "text"
for _p, _r in ((r"\s*=\s*", " = "), (r",\s*,+", ","), (r"[.,]*\.", "."), (r"\s+([.,:;)\]])", r"\1"), (r"([\[(])\s+", r"\1"), (r"\s+", " ")):
    _PUNCTUATED = f"regexp_replace({_PUNCTUATED}, '{_p}', '{_r}', 'g')"


def _digest(text: str) -> str:
    return f"SELECT doc_id, md5({text}) AS digest, length({text})::BIGINT AS n_chars FROM documents"


_VOCAB = f"""
counted AS (SELECT token, count(*) AS freq FROM (SELECT unnest({_STRIPPED_WORDS}) AS token FROM documents) GROUP BY token HAVING count(*) >= 5),
own AS (SELECT (row_number() OVER (ORDER BY freq DESC, encode(token)) + 1)::BIGINT AS id, token, freq::BIGINT AS freq FROM counted),
vocab AS (SELECT * FROM own UNION ALL SELECT * FROM (VALUES (0::BIGINT, '<pad>', NULL::BIGINT), (1::BIGINT, '<unk>', NULL::BIGINT)))
"""
_ENCODED = f"""{_VOCAB},
words AS (SELECT doc_id AS chunk_id, {_STRIPPED_WORDS} AS w FROM documents),
placed AS (SELECT chunk_id, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM words),
known AS (SELECT chunk_id, place, coalesce(own.id, 1)::BIGINT AS id FROM placed LEFT JOIN own USING (token)),
encoded AS (SELECT words.chunk_id, coalesce(k.ids, []) AS ids FROM words LEFT JOIN (SELECT chunk_id, list(id ORDER BY place) AS ids FROM known GROUP BY chunk_id) k USING (chunk_id))
"""
_LINES = """
parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents),
lines AS (SELECT doc_id, source, unnest(s) AS text, (generate_subscripts(s, 1) - 1)::BIGINT AS section_index FROM parts)
"""
def _split(docs: str, size: int, overlap: int, least: int) -> str:
    """Tables up to `whole` (doc_id, i, text): the chunks of docs (doc_id, s), s without white space other than single spaces."""
    tables = r"""
docs AS (@docs),
long AS (SELECT doc_id, s, length(s) AS n FROM docs WHERE length(s) > @size),
walk AS (
  SELECT doc_id, s, n, 0::BIGINT AS i, 0::BIGINT AS start,
    CASE WHEN strpos(reverse(substr(s, 1, @size)), ' ') BETWEEN 1 AND @size_1 THEN @size - strpos(reverse(substr(s, 1, @size)), ' ')
      WHEN strpos(substr(s, @size1), ' ') > 0 THEN @size + strpos(substr(s, @size1), ' ') - 1 ELSE n END AS cut
  FROM long
  UNION ALL
  SELECT doc_id, s, n, i + 1, next,
    CASE WHEN next + @size >= n THEN n
      WHEN strpos(reverse(substr(s, next + 1, @size)), ' ') BETWEEN 1 AND @size_1 THEN next + @size - strpos(reverse(substr(s, next + 1, @size)), ' ')
      WHEN strpos(substr(s, next + @size1), ' ') > 0 THEN next + @size + strpos(substr(s, next + @size1), ' ') - 1 ELSE n END
  FROM (
    SELECT doc_id, s, n, i, CASE WHEN after > start THEN after ELSE cut + (substr(s, cut + 1, 1) = ' ')::BIGINT END AS next
    FROM (
      SELECT *, word + (substr(s, word + 1, 1) = ' ')::BIGINT AS after
      FROM (
        SELECT *, CASE WHEN back > 0 AND substr(s, back + 1, 1) <> ' ' AND substr(s, back, 1) <> ' '
          THEN CASE WHEN strpos(substr(s, back + 1, cut - back), ' ') > 0 THEN back + strpos(substr(s, back + 1, cut - back), ' ') - 1 ELSE cut END
          ELSE back END AS word
        FROM (SELECT *, greatest(cut - @overlap, 0) AS back FROM walk WHERE cut < n))))
  WHERE next < n),
pieces AS (
  SELECT doc_id, i, trim(substr(s, start + 1, cut - start)) AS text, max(i) OVER (PARTITION BY doc_id) AS last FROM walk),
tails AS (SELECT doc_id, last, text AS tail FROM pieces WHERE i = last AND last > 0 AND length(text) < @least),
joined AS (
  SELECT p.doc_id, p.i, CASE WHEN t.tail IS NOT NULL AND p.i = t.last - 1 AND ltrim(substr(t.tail, @overlap1)) <> '' THEN trim(p.text || ' ' || ltrim(substr(t.tail, @overlap1))) ELSE p.text END AS text
  FROM pieces p LEFT JOIN tails t ON p.doc_id = t.doc_id WHERE t.tail IS NULL OR p.i < t.last),
whole AS (SELECT doc_id, 0::BIGINT AS i, s AS text FROM docs WHERE length(s) <= @size UNION ALL SELECT doc_id, i, text FROM joined)
"""
    for name, value in (("@docs", docs), ("@size1", size + 1), ("@size_1", size - 1), ("@size", size), ("@overlap1", overlap + 1), ("@overlap", overlap), ("@least", least)):
        tables = tables.replace(name, str(value))
    return tables


_COLLAPSED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_CHUNKS = f"""
WITH RECURSIVE {_split(f"SELECT doc_id, {_COLLAPSED.format('text')} AS s FROM documents", 600, 60, 300)}
SELECT doc_id, i AS local_index, md5(text) AS digest, length(text)::BIGINT AS n_chars FROM whole
"""

_CORPUS = rf"""
papers AS (SELECT doc_id, source, CASE WHEN contains(text, chr(10)) THEN strpos(text, chr(10)) ELSE length(text) END AS cut, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
sections AS (
  SELECT doc_id, source, 0 AS section_index, 'opening' AS section, {_COLLAPSED.format("substr(text, 1, cut)")} AS s FROM papers
  UNION ALL SELECT doc_id, source, 1, 'rest', {_COLLAPSED.format("substr(text, cut + 1)")} FROM papers),
{_split("SELECT doc_id || '_s' || section_index AS doc_id, s FROM sections WHERE s <> ''", 1500, 150, 300)},
bare AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '\S+'), lambda t: upper(trim(t, '.,;:!?()[]{{}}<>"''`'))), lambda t: t <> '') AS b FROM whole),
kept AS (SELECT * FROM bare WHERE len({_WORDS}) >= 32 AND (len(b) = 0 OR len(list_filter(b, lambda t: t IN ('MATH', 'NUM', 'EQN', 'CITE', 'REF', 'FIG', 'URL', 'CODE', 'ALG', 'ENV'))) / len(b) <= 0.15)),
chunks AS (
  SELECT k.doc_id || '_c' || i AS chunk_id, p.doc_id, p.source AS title, p.section, i AS local_index, k.text, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.section_index, i) - 1 AS position
  FROM kept k JOIN sections p ON k.doc_id = p.doc_id || '_s' || p.section_index)
"""

_TFIDF = f"""
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT doc_id AS chunk_id, unnest(regexp_extract_all({_SEARCH}, '{_WORD}')) AS term FROM documents) GROUP BY chunk_id, term),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY term),
raw AS (SELECT chunk_id, term, tf * idf AS raw FROM tf JOIN idf USING (term)),
norm AS (SELECT chunk_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY chunk_id)
"""


def _matching(candidates: int) -> str:
    return f"""{_TFIDF},
asked AS (SELECT term, count(*) AS qtf FROM (SELECT unnest(regexp_extract_all({_SEARCH}, '{_WORD}')) AS term FROM benchmark WHERE item_id = 0) GROUP BY term),
query AS (SELECT term, qtf * idf AS q FROM asked JOIN idf USING (term)),
dots AS (SELECT chunk_id, sum(raw * q) AS dot FROM raw JOIN query USING (term) GROUP BY chunk_id),
scores AS (
  SELECT d.doc_id AS chunk_id, coalesce(dot / (norm * (SELECT sqrt(sum(q * q)) FROM query)), 0.0) AS score
  FROM documents d LEFT JOIN norm ON d.doc_id = norm.chunk_id LEFT JOIN dots ON d.doc_id = dots.chunk_id),
lex AS (
  SELECT chunk_id, score AS lex_score, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS lex_rank FROM scores
  QUALIFY lex_rank <= {candidates}),
scored AS (
  SELECT lex.*, coalesce(list_inner_product(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), -1.0::DOUBLE) AS dense FROM lex LEFT JOIN embeddings e ON lex.chunk_id = e.vec_id)
"""


_METHODS = {
    "tfidf": "SELECT chunk_id, lex_rank, lex_score AS score, row_number() OVER (ORDER BY lex_rank) AS rank FROM scored",
    "dense": "SELECT chunk_id, lex_rank, dense AS score, row_number() OVER (ORDER BY round(dense, 9) DESC, lex_rank) AS rank FROM scored",
    "fusion": "SELECT chunk_id, lex_rank, 0.5::DOUBLE * dense + 0.5::DOUBLE * lex_score AS score, row_number() OVER (ORDER BY round(0.5::DOUBLE * dense + 0.5::DOUBLE * lex_score, 9) DESC, lex_rank) AS rank FROM scored",
    "rrf": """
SELECT chunk_id, lex_rank, score, row_number() OVER (ORDER BY round(score, 9) DESC, lex_rank) AS rank
FROM (SELECT chunk_id, lex_rank, 1.0::DOUBLE / (lex_rank + 10) + 1.0::DOUBLE / (dense_rank + 10) AS score
  FROM (SELECT *, row_number() OVER (ORDER BY round(dense, 9) DESC, lex_rank) AS dense_rank FROM scored))""",
    "pin_top": """
SELECT chunk_id, lex_rank, score, row_number() OVER (ORDER BY pinned DESC, capped DESC, CASE WHEN NOT pinned AND NOT capped THEN round(score, 9) END DESC, lex_rank) AS rank
FROM (SELECT chunk_id, lex_rank, pinned, capped, CASE WHEN pinned THEN lex_score WHEN capped THEN cap - 1e-12 ELSE dense END AS score
  FROM (SELECT *, lex_rank <= 10 AS pinned, cap, NOT (lex_rank <= 10) AND coalesce(round(dense, 9) >= round(cap, 9), false) AS capped
    FROM scored, (SELECT arg_max(lex_score, lex_rank) AS cap FROM scored WHERE lex_rank <= 10)))""",
}


def _pooled(candidates: int, level: str, chunks: int, sections: int) -> str:
    top = "SELECT {keys}, avg(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 9) DESC, {tie}) AS place FROM {rows}) WHERE place <= {k} GROUP BY {keys}"
    part = top.format(keys="doc_id, section", tie="rank", rows="located", k=chunks)
    whole = top.format(keys="doc_id", tie="rank", rows="located", k=chunks) if level == "paper" else top.format(keys="doc_id", tie="first", rows="parts", k=sections)
    return f"""{_matching(candidates)},
matches AS ({_METHODS['rrf']}),
located AS (SELECT m.*, d.source AS doc_id, d.lang AS section FROM matches m JOIN documents d ON m.chunk_id = d.doc_id WHERE d.source IS NOT NULL),
parts AS (SELECT s.doc_id, s.section, s.score, n.n_chunks, n.first FROM ({part}) s JOIN (SELECT doc_id, section, count(*) AS n_chunks, min(rank) AS first FROM located GROUP BY doc_id, section) n USING (doc_id, section)),
tops AS ({whole}),
papers AS (
  SELECT t.doc_id, t.score, p.n_chunks, p.found, row_number() OVER (ORDER BY round(t.score, 9) DESC, p.first) AS rank
  FROM tops t JOIN (
    SELECT doc_id, sum(n_chunks)::BIGINT AS n_chunks, min(first) AS first, list({{'section': section, 'n': n_chunks}} ORDER BY round(score, 9) DESC, first) AS found FROM parts GROUP BY doc_id) p USING (doc_id))
"""


def _masked(docs: str) -> str:
    """Tables up to `masked` (doc_id, masked) of docs (doc_id, text): texts are cut into runs joined by dots (with a dot that follows) and single other characters; a run is judged by itself."""
    return rf"""
parts AS (SELECT doc_id, regexp_extract_all(text, '[0-9A-Za-z]+(?:\.[0-9A-Za-z]+)*\.?|[^0-9A-Za-z]') AS p FROM ({docs})),
cut AS (SELECT doc_id, list_transform(p, lambda t: {{'t': t, 'dot': t[-1] = '.' AND len(t) > 1, 'runs': string_split(CASE WHEN t[-1] = '.' AND len(t) > 1 THEN t[:-2] ELSE t END, '.')}}) AS p FROM parts),
judged AS (SELECT doc_id, list_transform(p, lambda x: {{'x': x, 'first': list_position(list_transform(x.runs, lambda r, i: regexp_matches(r, '[0-9]') AND NOT (i = len(x.runs) AND NOT x.dot AND {_STAYS.format("r")})), true)}}) AS p FROM cut),
masked AS (
  SELECT doc_id, array_to_string(list_transform(p, lambda y: CASE WHEN coalesce(y.first, 0) = 0 THEN y.x.t
    ELSE array_to_string(list_append(y.x.runs[1:y.first - 1], ' @@num@@ '), '.') || CASE WHEN y.x.dot THEN '.' ELSE '' END END), '') AS masked FROM judged)"""


_STAYS = "(regexp_full_match({0}, '[A-Za-z]{{0,3}}([0-9]|10|11|26)') OR regexp_full_match({0}, '([0-9]|10|11|26)[A-Za-z]'))"


def _replaced(text: str, *pairs: tuple[str, str]) -> str:
    for pattern, by in pairs:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


def _cleaned() -> str:
    """Tables up to `cleaned` (doc_id, source, lang, c): what the rules make of a text without LaTeX and slashes, whose only placeholders are numbers and keys."""
    bare = r"""regexp_replace(regexp_replace(replace(translate(translate(text, '\{}$%', ''), '"''`', ''), '~', ' '), '\[\s*\]', ' ', 'g'), '\*?\b[A-Za-z]+:\d{4}[A-Za-z0-9]*\b', ' @@cite@@ ', 'g')"""
    mark, tight = "(@@[a-z]+@@)", ((r"([(\[])\s+(@@[a-z]+@@)", r"\1\2"), (r"(@@[a-z]+@@)\s+([.,:;!?)\]])", r"\1\2"))
    lists = ((rf"{mark}\s*[,:;/-]\s*{mark}", r"\1 \2"), (rf"{mark}\s*,?\s*\b(?:and|or)\b\s*{mark}", r"\1 \2"))
    turn = (*tight, *lists * 2, (r"@@cite@@\s+@@num@@", "@@num@@"), (r"@@num@@\s+@@cite@@", "@@num@@"), (rf"{mark}(?:\s+@@[a-z]+@@)+", r"\1"), (rf"[(\[]\s*{mark}\s*[)\]]", r"\1"), *tight)
    rules = (
        *((f"[{c}]{{2,}}", c) for c in "-/:.,;!?="), (r"\s*=\s*", " = "), (r",\s*,+", ","), (r"[.,]*\.", "."), (r"(\S)-(\s)", r"\1 \2"), (r"(\s)-(\S)", r"\1 \2"), *turn * 3,
        (rf"(\w){mark}", r"\1 \2"), (rf"{mark}(\w|[(\[])", r"\1 \2"), (r"\s+([.,:;)\]])", r"\1"), (r"([\[(])\s+", r"\1"), (r"\s+", " "),
    )
    plain = f"replace(replace({_ASCII.format(_replaced('masked', *rules))}, '@@num@@', 'NUM'), '@@cite@@', 'CITE')"
    return f"{_masked(f'SELECT doc_id, {bare} AS text FROM documents')}, cleaned AS (SELECT doc_id, source, lang, trim({plain}) AS c FROM masked JOIN documents USING (doc_id))"


_MASKED = f"WITH {_masked('SELECT doc_id, text FROM documents')} SELECT doc_id, masked FROM masked"

_CLEANED = f"""WITH {_cleaned()}
SELECT doc_id, CASE WHEN {_STAYS.format("source")} THEN source ELSE 'NUM' END || ' [2]#1#2 #1 x eqs EQN ' || c || ' x and MATH in NUM, see CITE. ab a = b end y' AS cleaned FROM cleaned"""

_SECTIONS = rf"""WITH {_cleaned()}, good AS (SELECT * FROM cleaned WHERE length(c) - length(translate(c, '$_^&\\', '')) <= 5)
SELECT doc_id, source AS title, 0::BIGINT AS section_index, 'Opening' AS section, c || ' x and MATH in NUM, see CITE. ' || CASE WHEN {_STAYS.format("source")} THEN source || ' ENV' ELSE 'NUM' END AS text FROM good
UNION ALL SELECT doc_id, source, 1, lang, 'end ENV' FROM good"""

# What the rules make of the query's placeholders, by hand: before the text (MATH), EQN and REF are one EQN; behind it NUM, URL and CITE are one NUM.
_LADDER = r"""
SELECT doc_id, regexp_replace('@@eqn@@ - ' || text || ' @@num@@', '([(\[])\s+@@num@@$', '\1@@num@@') AS merged FROM documents"""

_EXTRACTED = r"""
SELECT doc_id, '{"src":"' || source || '"}' AS noarg, '{"two":2}' AS arg, '{"eqs":"equation"}' AS env, '{"op":"cl"}' AS delim FROM documents"""

_EXPANDED = r"""
SELECT doc_id, '   \newenvironment{eqs}{\begin{equation}}{\end{equation}} \begin{document}\maketitle \section{Opening} ' || translate(text, '\{}$%', '')
  || ' $x$ and $E = mc^2$ in 2021, see \cite{a,b}. ' || source || '\  @@env@@  \begin{equation} a = b \end{equation} \section{' || lang || '} \textbf{end}  @@env@@  \section{References} z \end{document}' AS expanded FROM documents"""


def statements(candidates: int) -> dict[str, str]:
    ranked = {name: f"WITH {_matching(candidates)} SELECT chunk_id, round(score, 6) AS score, rank FROM ({body})" for name, body in _METHODS.items()}
    pool = lambda *a: f"WITH {_pooled(candidates, *a)} SELECT doc_id, round(score, 6) AS score, n_chunks, array_to_string(list_transform(found, lambda s: s.section || ':' || s.n), ',') AS sections, rank FROM papers"
    ids = "array_to_string(list_transform({}, lambda i: i::VARCHAR), ' ')"
    window = "ids[1:160]"
    missing = "greatest(160 - len(ids), 0)"
    return {
        "number_masking": _MASKED,
        "clean_latex": _CLEANED,
        "paper_sections": _SECTIONS,
        "placeholder_ladder": _LADDER,
        "macro_extract": _EXTRACTED,
        "macro_expand": _EXPANDED,
        "tokenize_counts": rf"SELECT doc_id, len({_WORDS})::BIGINT AS n_words, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_runs FROM documents",
        "latinize_text": _digest(_ASCII.format("text") + " || ' finite ... 12 ab 1  C A'"),
        "dash_fold": _digest("regexp_replace(text, '[‐-―−﹣－]', '-', 'g')"),
        "punct_normalize": _digest(_PUNCTUATED),
        "leftover_symbol_gate": r"SELECT doc_id, c AS math_symbol_count, c <= 5 AS kept FROM (SELECT doc_id, (length(text) - length(translate(text, '$_^&\', '')))::BIGINT AS c FROM documents)",
        "macro_merge": "SELECT doc_id, source AS a, lang AS b, 1::BIGINT AS a_args, 3::BIGINT AS b_args FROM documents",
        "sections_split": f"WITH {_LINES} SELECT doc_id, section_index, md5(text) AS digest FROM lines",
        "chunk_split": _CHUNKS,
        "chunk_filter_min_tokens": f"SELECT doc_id FROM documents WHERE len({_WORDS}) >= 32",
        "chunk_filter_placeholder": r"""
WITH heads AS (SELECT doc_id, regexp_replace(text, '([.,]) ', '\1 (MATH), code ', 'g') AS text FROM documents),
bare AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\S+'), lambda t: upper(trim(t, '.,;:!?()[]{}<>"''`'))), lambda t: t <> '') AS b FROM heads)
SELECT doc_id FROM bare WHERE len(b) = 0 OR len(list_filter(b, lambda t: t IN ('MATH', 'NUM', 'EQN', 'CITE', 'REF', 'FIG', 'URL', 'CODE', 'ALG', 'ENV'))) / len(b) <= 0.15""",
        "chunk_ids_positions": f"WITH RECURSIVE {_CORPUS} SELECT chunk_id, local_index, position FROM chunks",
        "corpus_build": f"WITH RECURSIVE {_CORPUS} SELECT chunk_id, doc_id, title, section, md5(text) AS digest, position FROM chunks",
        "corpus_report": rf"""
WITH bare AS (SELECT text, list_filter(list_transform(regexp_extract_all(text, '\S+'), lambda t: upper(trim(t, '.,;:!?()[]{{}}<>"''`'))), lambda t: t <> '') AS b FROM documents),
n AS (SELECT count(*) AS total, count(*) FILTER (WHERE len({_WORDS}) >= 32 AND (len(b) = 0 OR len(list_filter(b, lambda t: t IN ('MATH', 'NUM', 'EQN', 'CITE', 'REF', 'FIG', 'URL', 'CODE', 'ALG', 'ENV'))) / len(b) <= 0.15)) AS kept FROM bare)
SELECT total AS total_chunks, kept AS kept_chunks, round(100.0::DOUBLE * kept / total, 2) AS kept_percent FROM n""",
        "seq_length_estimate": r"""
WITH l AS (SELECT len(regexp_extract_all(text, '\S+')) AS n FROM documents), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS place, count(*) OVER () AS total FROM l WHERE n > 0)
SELECT (ceil(n / 32.0) * 32)::BIGINT AS sequence_length FROM o WHERE place = floor(0.95::DOUBLE * (total - 1))""",
        "vocab_build": f"WITH {_VOCAB} SELECT id, token, coalesce(freq, 0) AS freq FROM vocab",
        "vocab_capped": f"WITH {_VOCAB} SELECT id, token, coalesce(freq, 0) AS freq FROM vocab WHERE id < 500",
        "vocab_encode": f"WITH {_ENCODED} SELECT chunk_id, len(ids)::BIGINT AS n_ids, md5({ids.format('ids')}) AS digest FROM encoded",
        "vocab_decode": f"WITH {_ENCODED}, texts AS (SELECT chunk_id, string_agg(token, ' ' ORDER BY place) AS t FROM known JOIN own USING (id) GROUP BY chunk_id) SELECT encoded.chunk_id, md5(coalesce(t, '')) AS digest FROM encoded LEFT JOIN texts USING (chunk_id)",
        "pad_truncate": f"WITH {_ENCODED} SELECT chunk_id, md5({ids.format(f'list_concat({window}, list_transform(range({missing}), lambda x: 0::BIGINT))')}) AS inputs, md5({ids.format(f'list_concat(list_transform({window}, lambda x: 1), list_transform(range({missing}), lambda x: 0))')}) AS mask FROM encoded",
        "prompt_encode": f"""
WITH {_VOCAB}, asked AS (SELECT item_id, regexp_extract_all({_SEARCH.replace("text", "translate(text, '_^$', '')")}, '{_WORD}') AS w FROM benchmark),
placed AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM asked),
listed AS (SELECT item_id, list(coalesce(own.id, 1) ORDER BY place) AS ids FROM placed LEFT JOIN own USING (token) GROUP BY item_id),
whole AS (SELECT item_id, coalesce(ids, []) AS ids FROM asked LEFT JOIN listed USING (item_id))
SELECT item_id, md5({ids.format(f'list_concat({window}, list_transform(range({missing}), lambda x: 0::BIGINT))')}) AS inputs, md5({ids.format(f'list_concat(list_transform({window}, lambda x: 1), list_transform(range({missing}), lambda x: 0))')}) AS mask FROM whole""",
        "unk_filter": f"WITH {_ENCODED}, r AS (SELECT chunk_id, least(len(ids), 160) AS real, len(list_filter({window}, lambda i: i = 1)) AS unk FROM encoded) SELECT chunk_id FROM r WHERE real > 0 AND NOT ((160 - real) / 160 <= 0.5 AND unk / real > 0.4)",
        "mean_pool_l2": """
WITH p AS (SELECT label::BIGINT AS label, (generate_subscripts(embedding, 1) - 1)::BIGINT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, dim, avg(x) AS m FROM p GROUP BY label, dim) SELECT label, dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM m""",
        "infonce_loss": """
WITH v AS (SELECT vec_id // 128 AS batch, vec_id % 64 AS item, vec_id % 128 // 64 AS half, embedding::DOUBLE[] AS z FROM embeddings),
p AS (SELECT a.batch, a.item, a.z AS zi, b.z AS zj FROM v a JOIN v b ON a.batch = b.batch AND a.item = b.item WHERE a.half = 0 AND b.half = 1),
t AS (SELECT a.batch, a.item AS i, b.item AS j, list_inner_product(a.zi, b.zj) / 0.05::DOUBLE AS x FROM p a JOIN p b ON a.batch = b.batch),
r AS (
  SELECT batch, ln(sum(exp(x))) - max(CASE WHEN i = j THEN x END) AS l FROM t GROUP BY batch, i
  UNION ALL SELECT batch, ln(sum(exp(x))) - max(CASE WHEN i = j THEN x END) AS l FROM t GROUP BY batch, j)
SELECT batch, round(avg(l), 6) AS loss FROM r GROUP BY batch""",
        "metadata_last_wins": "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
        "skip_anti_join": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
        "tfidf_weights": f"WITH {_TFIDF} SELECT chunk_id, term, round(raw / norm, 6) AS weight FROM raw JOIN norm USING (chunk_id)",
        "lexical_topk": f"WITH {_matching(candidates)} SELECT chunk_id, round(lex_score, 6) AS score, lex_rank AS rank FROM lex",
        "index_build": f"WITH {_TFIDF} SELECT term, (SELECT count(*) FROM tf WHERE tf.term = idf.term) AS df, round(idf, 6) AS idf FROM idf",
        "chunk_matches_report": f"WITH {_matching(candidates)} SELECT rank, round(score, 6) AS score, chunk_id, source AS doc_id, lang AS section FROM ({_METHODS['rrf']}) JOIN documents ON chunk_id = documents.doc_id WHERE rank <= 10",
        "index_search": f"WITH {_matching(candidates)} SELECT chunk_id, round(lex_score, 6) AS score, lex_rank AS rank FROM lex",
        "dense_scores": ranked["dense"],
        **{f"rerank_{name}": ranked[name] for name in ("tfidf", "pin_top", "fusion", "rrf")},
        "pool_section": pool("section", 1, 1),
        "pool_paper": pool("paper", 1, 1),
        "pool_topk": pool("section", 3, 2),
        "hybrid_search": pool("section", 2, 2),
        "matches_report": f"""
WITH {_pooled(candidates, 'section', 1, 1)}, meta AS (SELECT source AS doc_id, min(doc_id)::VARCHAR AS title FROM documents GROUP BY source)
SELECT rank, doc_id, title, round(score, 6) AS score, n_chunks, array_to_string(list_transform(list_filter(found, lambda s: s.section <> '')[1:2], lambda s: s.section || ' (' || s.n || ')'), '; ') AS section_list
FROM papers LEFT JOIN meta USING (doc_id) WHERE rank <= 10""",
        "find_papers": f"""
WITH {_pooled(candidates, 'section', 1, 1)}, wanted AS (SELECT unnest(['src0', 'src3', 'absent']) AS doc_id)
SELECT w.doc_id, p.rank IS NOT NULL AS present, coalesce(p.rank, -1) AS best_rank, coalesce(round(p.score, 6), -1.0::DOUBLE) AS best_score FROM wanted w LEFT JOIN papers p USING (doc_id)""",
    }

"""The same queries in SQL for DuckDB, to check results against.

Written from the definitions, not generated from the Spark plans: plain forms of the
patterns, brute force where the Spark query is clever.
"""

from __future__ import annotations

from webdrift import constants as C

ORACLES: dict[str, str] = {}


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(text: str, pattern: str, replacement: str) -> str:
    """Replace all matches; ``replacement`` is SQL."""
    return f"regexp_replace({text}, {quote(pattern)}, {replacement}, 'g')"


def strip(text: str) -> str:
    return sub(text, f"^{C.ASCII_SPACE}+|{C.ASCII_SPACE}+$", "''")


def transliterate(text: str) -> str:
    result = f"translate({text}, {quote(C.TRANSLATE_FROM)}, {quote(C.TRANSLATE_TO)})"
    for char, replacement in C.MULTI_ASCII.items():
        result = f"replace({result}, {quote(char)}, {quote(replacement)})"
    return result


def decode_entities(text: str) -> str:
    names = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in C.ENTITY_CHARS.items())
    name = f"regexp_extract(p, {quote(C.ENTITY_NAME)}, 1)"
    decimal, hexadecimal, plain = (f"regexp_extract(p, {quote(C.ENTITY_OPEN)}, {i})" for i in (1, 2, 3))

    def char(number: str) -> str:
        valid = f"({number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 1114111)"
        return f"CASE WHEN {valid} THEN chr(CAST({number} AS INTEGER)) END"

    def behind(skip: str) -> str:
        return f"regexp_replace(substr(p, {skip}), '^;', '')"

    table = f"(MAP {{{names}}})"
    piece = f"""CASE WHEN {name} <> '' AND {table}[{name}] IS NOT NULL THEN {table}[{name}] || substr(p, length({name}) + 2)
    WHEN {decimal} <> '' THEN coalesce({char(f"CAST({decimal} AS BIGINT)")} || {behind(f"length({decimal}) + 2")}, '&' || p)
    WHEN {hexadecimal} <> '' THEN coalesce({char(f"CAST('0x' || {hexadecimal} AS BIGINT)")} || {behind(f"length({hexadecimal}) + 3")}, '&' || p)
    WHEN {plain} <> '' THEN {table}[{plain}] || {behind(f"length({plain}) + 1")} ELSE '&' || p END"""
    parts = f"string_split({text}, '&')"
    return f"({parts})[1] || array_to_string(list_transform(({parts})[2:], lambda p: {piece}), '')"


def lines(text: str) -> str:
    pieces = f"regexp_split_to_array({text}, {quote(C.LINE_BREAK + '|  ')})"
    kept = f"list_filter(list_transform({pieces}, lambda p: {strip('p')}), lambda p: p <> '')"
    return f"array_to_string({kept}, chr(10))"


def end_lines(text: str) -> str:
    return f"replace({sub(text, C.NEWLINE_AFTER_TEXT, quote(chr(92) + '1. '))}, chr(10), ' ')"


def normalized(text: str) -> str:
    text = sub(sub(text, C.PHONE, quote(C.PHONE_WORD)), C.EMAIL, quote(C.EMAIL_WORD))
    return sub(sub(text, C.MISSING_SPACE, r"'\1 \2'"), C.MISSING_PERIOD, r"'\1. \3'")


def visible_text(source: str, key: str) -> str:
    """CTEs ending in ``visible(key, text)`` from ``source(key, html)``."""
    items = sub(sub("h", r"(?i)(<li\b)", r"chr(1) || '\1'"), r"(?i)(</li\s*>)", r"'\1' || chr(1)")
    first_link = f"regexp_replace(s, {quote(C.FIRST_LINK_END)}, '\\1' || chr(10) || '\\2')"
    tag = f"regexp_extract(html, {quote(C.META_DESCRIPTION)}, 0)"
    content = (
        f"coalesce(nullif(regexp_extract({tag}, {quote(C.META_CONTENT_DOUBLE)}, 1), ''), "
        f"nullif(regexp_extract({tag}, {quote(C.META_CONTENT_SINGLE)}, 1), ''))"
    )
    return f"""
    v0 AS (SELECT {key}, html, {sub('html', C.re2(C.HIDDEN), "''")} AS h FROM ({source})),
    v1 AS (SELECT {key}, html, array_to_string(list_transform(string_split({items}, chr(1)), lambda s: {first_link}), '') AS h FROM v0),
    v2 AS (SELECT {key}, html, {sub('h', C.re2(C.TAG), "''")} AS h FROM v1),
    v3 AS (SELECT {key}, html, {decode_entities('h')} AS h FROM v2),
    v4 AS (SELECT {key}, html, {sub(transliterate('h'), C.MARKUP, "''")} AS h FROM v3),
    v5 AS (SELECT {key}, {end_lines(lines('h'))} AS body, {content} AS raw FROM v4),
    v6 AS (SELECT {key}, body, {decode_entities('raw')} AS about FROM v5),
    visible AS (SELECT {key}, coalesce(about || CASE WHEN regexp_matches(about, '[.!?]$') THEN ' ' ELSE '. ' END || body, body) AS text FROM v6)"""


def clean(source: str) -> str:
    """Texts of ``source`` without left-over markup; empty ones are dropped."""
    text = strip(sub(transliterate("text"), C.MARKUP_REPEATED, "''"))
    return f"SELECT * FROM (SELECT * REPLACE ({text} AS text) FROM ({source})) WHERE text <> ''"


def sentences(text: str, abbreviations: list[str] = ()) -> str:
    """List of the sentences of a text."""
    if abbreviations:
        known = sorted(set(abbreviations), key=lambda a: (-len(a), a))
        choices = "|".join(a.replace(".", r"\.") for a in known)
        for _ in range(2):
            text = sub(text, rf"(?i)(^|[^\w.])({choices})\s+", r"'\1\2' || chr(2)")
    marked = sub(text, C.SENTENCE_END + r"\s+", r"'\1' || chr(1)")
    parts = f"string_split({marked}, chr(1))"
    restored = f"list_transform({parts}, lambda p: {strip('replace(p, chr(2), chr(32))')})"
    return f"list_filter({restored}, lambda p: p <> '')"


def sentence_rows(source: str, columns: str, abbreviations: list[str] = ()) -> str:
    return f"""
    SELECT {columns}, CAST(i - 1 AS INTEGER) AS sent_pos, s[i] AS text
    FROM (SELECT {columns}, s, unnest(range(1, len(s) + 1)) AS i
          FROM (SELECT {columns}, {sentences('text', abbreviations)} AS s FROM ({source})))"""


SPACE_TOKENS = f"list_filter(regexp_split_to_array(text, {quote(C.SPACE + '+')}), lambda t: t <> '')"


def word_list(min_chars: int, text: str = "text") -> str:
    return f"regexp_extract_all(lower({text}), {quote(f'{C.WORD_CHAR}{{{min_chars},}}')})"


def language(source: str, key: str) -> str:
    """(columns of source, lang_code, language)."""
    tokens = r"regexp_extract_all(lower(text), '\p{L}+')"
    votes = ", ".join(
        f"len(list_filter({tokens}, lambda t: t IN ({', '.join(map(quote, words))}))) AS n_{lang}"
        for lang, words in C.FUNCTION_WORDS.items()
    )
    best = "greatest(" + ", ".join(f"n_{lang}" for lang in C.FUNCTION_WORDS) + ")"
    winner = " ".join(f"WHEN n_{lang} = {best} THEN '{lang}'" for lang in C.FUNCTION_WORDS)
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LANGUAGE_NAMES.items())
    return f"""
    SELECT {key}, text, lang_code, CASE lang_code {names} ELSE '{C.DEFAULT_LANGUAGE}' END AS language
    FROM (SELECT {key}, text, CASE WHEN {best} = 0 THEN NULL {winner} END AS lang_code
          FROM (SELECT {key}, text, {votes} FROM ({source})))"""


def numbered(array: str, keys: str, source: str, name: str, first: int = 0) -> str:
    """One row per list element with its position."""
    return f"""
    SELECT {keys}, CAST(i - 1 + {first} AS INTEGER) AS pos, a[i] AS {name}
    FROM (SELECT {keys}, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT {keys}, {array} AS a FROM {source}))"""


# --- derived tables -----------------------------------------------------------------

COMPANIES = "SELECT d.doc_id, d.text, d.lang, d.source, l.quality AS innov FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
ID_MAP = "SELECT doc_id AS id_nhr, CAST(floor(doc_id / 2) AS BIGINT) AS beid FROM documents"
PAIRS = """SELECT a.conv_id, a.turn, a.text AS text_old, b.text AS text_new
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
VECTORS = """SELECT vec_id, embedding, CAST(embedding AS DOUBLE[]) AS e, label, label % 2 AS innov,
label * 10 + vec_id % 10 AS company, CASE WHEN CAST(floor(vec_id / 10) AS BIGINT) % 2 = 0 THEN 3 ELSE 12 END AS scrape,
CAST(vec_id % 20 AS INTEGER) AS cluster FROM embeddings"""
SCORED = f"""SELECT *, CASE WHEN innov = 1 AND rf_pred_lab = 1 AND rf_proba >= 0.75 THEN 'correct_high'
WHEN innov = 0 AND rf_pred_lab = 1 AND rf_proba >= 0.75 THEN 'wrong_high'
WHEN innov = 0 AND rf_pred_lab = 0 AND rf_proba <= 0.35 THEN 'correct_low'
WHEN innov = 1 AND rf_pred_lab = 0 AND rf_proba <= 0.35 THEN 'wrong_low'
WHEN rf_proba > 0.35 AND rf_proba < 0.75 THEN 'middle' END AS bucket
FROM (SELECT *, CAST(rf_proba > 0.5 AS INTEGER) AS rf_pred_lab
      FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-6.0::DOUBLE * e[1])) AS rf_proba FROM ({VECTORS})))"""
PAGE_TEXTS = f"WITH {visible_text('SELECT page_id, html FROM pages', 'page_id')} {clean('SELECT page_id, text FROM visible')}"
RAW_PAGES = f"SELECT page_id, {sub(transliterate('html'), C.MARKUP, chr(39) * 2)} AS text FROM pages"


def is_test(key: str, share: str = "0.2") -> str:
    return f"row_number() OVER (ORDER BY md5(concat({key}, '42'))) <= ceil({share} * count(*) OVER ())"


def six(value: str) -> str:
    return f"round({value}, 6) + 0.0"


# --- sources and sinks --------------------------------------------------------------

ORACLES["scan_pages"] = "SELECT page_id, url, html FROM pages"
ORACLES["page_rejects"] = """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'unreadable' ELSE 'empty' END AS status
FROM pages WHERE page_id % 7 = 0 OR page_id % 11 = 0"""
ORACLES["csv_roundtrip"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
ORACLES["csv_semicolon_roundtrip"] = ORACLES["csv_roundtrip"]
ORACLES["text_files_by_key"] = """SELECT doc_id, replace(text, chr(10), ' ') AS text,
CAST(len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS INTEGER) AS line_count
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"""

# --- pages --------------------------------------------------------------------------

ORACLES["page_visible_text"] = f"WITH {visible_text('SELECT page_id, html FROM pages', 'page_id')} SELECT page_id, text FROM visible"
ORACLES["page_text"] = PAGE_TEXTS
ORACLES["transliterate"] = f"SELECT doc_id, {transliterate('text')} AS text FROM documents"
ORACLES["strip_markup"] = f"SELECT page_id, {sub('html', C.MARKUP, chr(39) * 2)} AS text FROM pages"
ORACLES["strip_markup_repeated"] = f"SELECT page_id, {sub('html', C.MARKUP_REPEATED, chr(39) * 2)} AS text FROM pages"
ORACLES["normalize_lines"] = f"SELECT doc_id, {lines('text')} AS text FROM documents"
ORACLES["newline_to_sentence"] = f"SELECT doc_id, {end_lines('text')} AS text FROM documents"
ORACLES["mask_phone"] = f"SELECT doc_id, {sub('text', C.PHONE, quote(C.PHONE_WORD))} AS text FROM documents"
ORACLES["mask_email"] = f"SELECT doc_id, {sub('text', C.EMAIL, quote(C.EMAIL_WORD))} AS text FROM documents"

_META_PAGES = """SELECT doc_id, '<html><head>' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '<meta content="' ||
CASE WHEN doc_id % 3 = 1 THEN source || '!' ELSE source END || '" name="description">' END ||
'</head><body><p>' || text || '</p></body></html>' AS html FROM documents"""
ORACLES["meta_description_prefix"] = f"WITH {visible_text(_META_PAGES, 'doc_id')} SELECT doc_id, text FROM visible"
ORACLES["id_from_name"] = r"""SELECT page_id, regexp_replace(regexp_replace(url, '\?.*$', ''), '^.*/', '') AS id FROM pages"""
_EMPTIED = r"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' || chr(10) || ' ' WHEN doc_id % 13 = 0 THEN '<<b>>' ELSE text END AS text
FROM documents WHERE doc_id % 7 <> 0"""
ORACLES["drop_empty_text"] = clean(_EMPTIED)

# --- normalisation, sentences, words -------------------------------------------------

ORACLES["fix_missing_space"] = f"SELECT page_id, {sub('text', C.MISSING_SPACE, chr(39) + r'\1 \2' + chr(39))} AS text FROM ({RAW_PAGES})"
ORACLES["fix_missing_period"] = f"SELECT page_id, {sub('text', C.MISSING_PERIOD, chr(39) + r'\1. \3' + chr(39))} AS text FROM ({RAW_PAGES})"
ORACLES["preprocess_text"] = f"SELECT page_id, {normalized('text')} AS text FROM ({PAGE_TEXTS})"
ORACLES["detect_language"] = f"SELECT doc_id, lang_code, language FROM ({language('SELECT doc_id, text FROM documents', 'doc_id')})"
_PIECES = numbered(f"regexp_split_to_array(text, {quote(C.ABBREVIATION_SPLIT)})", "doc_id", "documents", "piece")
ORACLES["abbreviation_dictionary"] = f"""
SELECT abbreviation, doc_id, pos AS piece_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY abbreviation ORDER BY doc_id, pos) AS i FROM (
    SELECT doc_id, pos, {sub('piece', C.ABBREVIATION_NOTE, chr(39) * 2)} AS abbreviation
    FROM (SELECT doc_id, pos, {sub('piece', C.ABBREVIATION_GLOSS, chr(39) * 2)} AS piece FROM ({_PIECES}))
    WHERE regexp_matches(piece, {quote(C.ABBREVIATION_KEEP)}))) WHERE i = 1"""
ORACLES["sentence_split"] = sentence_rows("SELECT doc_id, text FROM documents", "doc_id")
_TITLED = r"SELECT doc_id, regexp_replace(text, ' ([A-Z][a-z]+)', ' o.a. prof. Dr. \1', 'g') AS text FROM documents"
ORACLES["sentence_split_abbrev"] = sentence_rows(_TITLED, "doc_id", [*C.ABBREVIATIONS, "o.a."])
ORACLES["sentence_explode"] = sentence_rows(
    language(f"SELECT doc_id, innov, text FROM ({COMPANIES})", "doc_id, innov"),
    "doc_id, innov, lang_code, language", C.ABBREVIATIONS,
)
ORACLES["filter_nonalpha"] = rf"""SELECT doc_id, text, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \n]')) AS text FROM documents)
WHERE NOT regexp_matches(text, {quote(C.NO_LETTER)}) GROUP BY ALL"""
ORACLES["whitespace_tokens"] = numbered(SPACE_TOKENS, "doc_id", "documents", "token")
ORACLES["word_tokens"] = numbered(word_list(2), "doc_id", "documents", "token")
ORACLES["language_flag"] = "SELECT doc_id, CASE WHEN lang = 'de' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS flag FROM documents"
_PROFILE = sentence_rows(f"SELECT page_id, {normalized('text')} AS text FROM ({PAGE_TEXTS})", "page_id", C.ABBREVIATIONS)
ORACLES["sentence_profile"] = f"""SELECT page_id, count(*) AS n_sentences, {six('avg(length(text))')} AS mean_chars
FROM ({_PROFILE}) WHERE NOT regexp_matches(text, {quote(C.NO_LETTER)}) GROUP BY page_id"""

# --- nulls, distinct, joins, unions ---------------------------------------------------

ORACLES["fill_blank"] = """SELECT doc_id, coalesce(nullif(lang, 'en'), ' ') AS lang, coalesce(source, ' ') AS source,
nullif(n_chars % 5, 0) AS n FROM documents"""
ORACLES["dedup_subset"] = f"SELECT DISTINCT beid, quality AS innov FROM ({ID_MAP}) m JOIN labels l ON m.id_nhr = l.doc_id"
ORACLES["distinct_rows"] = "SELECT DISTINCT lang, source FROM documents"
ORACLES["first_per_key"] = f"SELECT min(id_nhr) AS id_nhr, beid FROM ({ID_MAP}) GROUP BY beid"
ORACLES["key_overlap_counts"] = """SELECT
(SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT doc_id * 2 FROM labels)) AS in_both,
(SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id * 2 FROM labels)) AS only_left,
(SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)) AS only_right"""
ORACLES["join_validated_1to1"] = "SELECT d.doc_id, lang, n_chars, quality AS innov FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
ORACLES["join_renamed_keys"] = """SELECT o_custkey AS id, o_orderkey AS number, o_totalprice AS amount_x, c_custkey AS beid,
c_acctbal AS amount_y FROM orders JOIN customer ON o_custkey = c_custkey"""
ORACLES["join_composite"] = f"""SELECT a.doc_id AS beid, a.innov, a.lang, b.toxic FROM ({COMPANIES}) a
JOIN labels b ON a.doc_id = CAST(floor(b.doc_id / 2) AS BIGINT) AND a.innov = b.quality"""
ORACLES["join_id_map"] = f"SELECT id_nhr, beid, lang, source FROM ({ID_MAP}) m JOIN documents d ON m.id_nhr = d.doc_id"
ORACLES["semi_join"] = "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"
ORACLES["anti_join"] = "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
ORACLES["union_scrapes"] = """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 3 ELSE 12 END AS scrape, text FROM conversations"""
ORACLES["union_missing_columns"] = """SELECT doc_id, lang, CAST(NULL AS INTEGER) AS quality, source FROM documents
UNION ALL SELECT doc_id, NULL, quality, NULL FROM labels"""
_SAMPLE = """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY md5(concat(doc_id, '42'))) AS i
FROM documents) WHERE i <= {n}"""
ORACLES["sample_union_extra"] = f"""SELECT doc_id, lang, CAST(NULL AS INTEGER) AS quality FROM ({_SAMPLE.format(n=150)})
UNION ALL SELECT doc_id, NULL, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM ({_SAMPLE.format(n=150)}))"""

# --- vectors and similarity -----------------------------------------------------------


def components(array: str, keys: str, source: str) -> str:
    rows = numbered(array, keys, source, "v")
    return f"SELECT {keys}, pos, {six('CAST(v AS DOUBLE)')} AS value FROM ({rows})"


ORACLES["vector_slice"] = components("embedding[9:24]", "vec_id", "embeddings")
ORACLES["pack_vector"] = components("embedding", "vec_id", "embeddings")


def mean_vector(keys: str, source: str) -> str:
    """(keys, pos, v): component means per key."""
    rows = numbered("e", f"vec_id, {keys}", f"({source})", "v")
    return f"SELECT {keys}, pos, avg(v) AS v FROM ({rows}) GROUP BY {keys}, pos"


ORACLES["scan_parquet"] = components("embedding", "vec_id, label", "embeddings")
ORACLES["parquet_roundtrip"] = components("embedding", "vec_id, company, innov, scrape", f"({VECTORS})")
ORACLES["mean_vector_by_key"] = f"SELECT company, pos, {six('v')} AS value FROM ({mean_vector('company', VECTORS)})"
ORACLES["cosine_same_key"] = f"""
WITH m AS ({mean_vector('label, scrape', VECTORS)})
SELECT a.label, {six('sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)))')} AS cosine_similarity
FROM m a JOIN m b ON a.label = b.label AND a.pos = b.pos WHERE a.scrape = 3 AND b.scrape = 12 GROUP BY a.label"""


def word_set(text: str) -> str:
    return f"list_distinct({SPACE_TOKENS.replace('(text,', f'({text},')})"


OVERLAP = f"""SELECT conv_id, turn, CAST(a - c AS INTEGER) AS n_only_old, CAST(b - c AS INTEGER) AS n_only_new, CAST(c AS INTEGER) AS n_common,
CAST(c AS DOUBLE) / nullif(a + b - c, 0) AS word_similarity
FROM (SELECT conv_id, turn, len(x) AS a, len(y) AS b, len(list_intersect(x, y)) AS c
      FROM (SELECT conv_id, turn, {word_set('text_old')} AS x, {word_set('text_new')} AS y FROM ({PAIRS})))"""
ORACLES["word_jaccard"] = f"SELECT * REPLACE ({six('word_similarity')} AS word_similarity) FROM ({OVERLAP})"


def summary(value: str, source: str) -> str:
    return f"""SELECT count({value}) AS n, {six(f'min({value})')} AS minimum, {six(f'max({value})')} AS maximum,
{six(f'avg({value})')} AS mean, {six(f'quantile_cont({value}, 0.5)')} AS median FROM ({source})"""


ORACLES["word_similarity_hist"] = f"""WITH o AS ({OVERLAP})
SELECT CAST(least(floor((word_similarity - lo) / (hi - lo) * 100), 99) AS INTEGER) AS bin, count(*) AS n
FROM o, (SELECT min(word_similarity) AS lo, max(word_similarity) AS hi FROM o) GROUP BY 1"""
ORACLES["similarity_summary"] = summary("word_similarity", OVERLAP)
# of a company's two ids the first, which is even, counts
_OLD = f"SELECT vec_id, CAST(floor((vec_id % 60) / 2) AS BIGINT) AS beid, e FROM ({VECTORS}) WHERE scrape = 3 AND (vec_id % 60) % 2 = 0"
_NEW = f"SELECT vec_id, CAST(floor((vec_id % 60) / 2) AS BIGINT) AS beid, e FROM ({VECTORS}) WHERE scrape = 12"
DRIFT = f"""
SELECT a.beid, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS cosine_similarity
FROM ({mean_vector('beid', _OLD)}) a JOIN ({mean_vector('beid', _NEW)}) b ON a.beid = b.beid AND a.pos = b.pos GROUP BY a.beid"""
ORACLES["vector_drift"] = f"SELECT beid, {six('cosine_similarity')} AS cosine_similarity FROM ({DRIFT})"
ORACLES["vector_drift_summary"] = summary("cosine_similarity", DRIFT)
_PAGE_DOCS = visible_text("SELECT page_id AS doc_id, html FROM pages", "doc_id")
ORACLES["labelled_texts"] = f"""WITH {_PAGE_DOCS}
SELECT t.doc_id, t.text, l.quality AS innov, 3 AS scrape FROM ({clean('SELECT doc_id, text FROM visible')}) t
JOIN labels l ON t.doc_id = l.doc_id"""
ORACLES["median_value"] = f"SELECT {six('quantile_cont(l_extendedprice, 0.5)')} AS median FROM lineitem"
ORACLES["histogram_range"] = """SELECT CAST(least(floor((value - lo) / (hi - lo) * 100), 99) AS INTEGER) AS bin, count(*) AS n
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1"""
_UNIT_BIN = "CAST(least(floor(rf_proba * 100), 99) AS INTEGER) AS bin"
ORACLES["histogram_unit"] = f"SELECT {_UNIT_BIN}, count(*) AS n FROM ({SCORED}) GROUP BY 1"
ORACLES["label_match_hist"] = f"SELECT innov = rf_pred_lab AS matched, {_UNIT_BIN}, count(*) AS n FROM ({SCORED}) GROUP BY 1, 2"
_SPLIT = f"SELECT vec_id, e, innov, {is_test('vec_id')} AS is_test FROM ({VECTORS})"
NEAREST = f"""
WITH s AS ({_SPLIT})
SELECT vec_id, neighbour, rank, distance, innov FROM (
  SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.e, b.e) AS distance, b.innov,
    CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS INTEGER) AS rank
  FROM s a, s b WHERE a.is_test AND NOT b.is_test) WHERE rank <= 2"""
ORACLES["knn_topk"] = f"SELECT vec_id, neighbour, rank, {six('distance')} AS distance FROM ({NEAREST})"
ORACLES["knn_classify"] = f"SELECT vec_id, CAST(avg(innov) > 0.5 AS INTEGER) AS pred FROM ({NEAREST}) GROUP BY vec_id"

# --- decisions and reports ------------------------------------------------------------

ORACLES["score_buckets"] = f"SELECT vec_id, bucket FROM ({SCORED})"
ROLLUP = f"""SELECT company, count(*) AS n_sentences, avg(innov) AS mean_innov, avg(rf_pred_lab) AS mean_pred,
avg(rf_proba) AS mean_proba FROM ({SCORED}) GROUP BY company"""
ORACLES["company_rollup"] = f"""SELECT company, n_sentences, {six('mean_innov')} AS mean_innov, {six('mean_pred')} AS mean_pred,
{six('mean_proba')} AS mean_proba FROM ({ROLLUP})"""
DECIDED = f"""SELECT company, mean_innov, 'label' AS rule, 0.5::DOUBLE AS threshold, CAST(mean_pred > 0.5 AS INTEGER) AS decision FROM ({ROLLUP})
UNION ALL SELECT company, mean_innov, 'probability', t, CAST(mean_proba > t AS INTEGER)
FROM ({ROLLUP}), (SELECT unnest([0.5::DOUBLE, 0.55::DOUBLE, 0.6::DOUBLE]) AS t)"""
ORACLES["threshold_sweep"] = f"SELECT company, rule, threshold, decision FROM ({DECIDED})"


def report(source: str, truth: str, guess: str, by: str = "", exact: bool = False) -> str:
    """Classification report with one row per class and the three overall rows."""
    group, lead = (f" GROUP BY {by}", f"{by}, ") if by else ("", "")
    per_class = " UNION ALL ".join(
        f"""SELECT {lead}'{name}' AS row_name,
        coalesce(count(*) FILTER (t = {c} AND p = {c}) / nullif(count(*) FILTER (p = {c}), 0), 0.0) AS precision,
        coalesce(count(*) FILTER (t = {c} AND p = {c}) / nullif(count(*) FILTER (t = {c}), 0), 0.0) AS recall,
        coalesce(2 * count(*) FILTER (t = {c} AND p = {c}) / nullif(count(*) FILTER (p = {c}) + count(*) FILTER (t = {c}), 0), 0.0) AS f1,
        count(*) FILTER (t = {c}) AS support FROM r{group}"""
        for c, name in C.CLASS_NAMES.items()
    )
    fields = ("precision", "recall", "f1")
    weighted = ", ".join(f"sum({f} * support) / sum(support) AS {f}" for f in fields)
    plain = ", ".join(f"avg({f}) AS {f}" for f in fields)
    return f"""
WITH r AS (SELECT {lead}CAST({truth} AS INTEGER) AS t, {guess} AS p FROM ({source})), c AS ({per_class}),
o AS (SELECT * FROM c
  UNION ALL SELECT {lead}'accuracy', NULL, NULL, count(*) FILTER (t = p) / count(*), count(*) FROM r{group}
  UNION ALL SELECT {lead}'macro avg', {plain}, CAST(sum(support) AS BIGINT) FROM c{group}
  UNION ALL SELECT {lead}'weighted avg', {weighted}, CAST(sum(support) AS BIGINT) FROM c{group})
SELECT {lead}row_name, {', '.join(f if exact else f'{six(f)} AS {f}' for f in fields)}, support FROM o"""


ORACLES["threshold_report"] = report(DECIDED, "mean_innov", "decision", "rule, threshold")
ORACLES["classification_report"] = report(SCORED, "innov", "rf_pred_lab")
ORACLES["decision_boundary"] = f"SELECT {six('max(rf_proba) FILTER (rf_pred_lab = 0)')} AS boundary FROM ({SCORED})"
ORACLES["binary_metrics"] = f"""SELECT n, {six('ok / n')} AS accuracy, {six('coalesce(tp / nullif(pp, 0), 0.0)')} AS precision,
{six('coalesce(tp / nullif(ap, 0), 0.0)')} AS recall, {six('coalesce(2 * tp / nullif(pp + ap, 0), 0.0)')} AS f1
FROM (SELECT count(*) AS n, count(*) FILTER (innov = rf_pred_lab) AS ok, count(*) FILTER (innov = 1 AND rf_pred_lab = 1) AS tp,
count(*) FILTER (rf_pred_lab = 1) AS pp, count(*) FILTER (innov = 1) AS ap FROM ({SCORED}))"""
ORACLES["confusion_matrix"] = f"SELECT innov AS truth, rf_pred_lab AS prediction, count(*) AS n FROM ({SCORED}) GROUP BY ALL"
DISTANCES = f"""
WITH s AS ({SCORED}), m AS ({mean_vector('cluster', VECTORS)}),
x AS (SELECT vec_id, cluster, pos, v FROM ({numbered('e', 'vec_id, cluster', f'({VECTORS})', 'v')}))
SELECT x.vec_id, x.cluster, any_value(s.bucket) AS bucket,
  {six('1 - sum(x.v * m.v) / (sqrt(sum(x.v * x.v)) * sqrt(sum(m.v * m.v)))')} AS distance_from_centroid
FROM x JOIN m ON x.cluster = m.cluster AND x.pos = m.pos JOIN s ON s.vec_id = x.vec_id GROUP BY x.vec_id, x.cluster"""
ORACLES["centroid_distance"] = f"SELECT vec_id, cluster, distance_from_centroid FROM ({DISTANCES})"


def extremes(source: str, order: str, n: int) -> str:
    return f"""SELECT * FROM (SELECT bucket, cluster, CAST(row_number() OVER (PARTITION BY bucket, cluster
ORDER BY distance_from_centroid {order}, vec_id) AS INTEGER) AS rank, vec_id FROM ({source})) WHERE rank <= {n}"""


_CORRECT = f"SELECT * FROM ({DISTANCES}) WHERE bucket IN ('correct_high', 'correct_low')"
ORACLES["cluster_top_n"] = extremes(DISTANCES, "ASC", 50)
ORACLES["cluster_bottom_n"] = extremes(DISTANCES, "DESC", 50)
ORACLES["cluster_review"] = f"""SELECT *, 'nearest' AS side FROM ({extremes(_CORRECT, 'ASC', 50)})
UNION ALL SELECT *, 'farthest' FROM ({extremes(_CORRECT, 'DESC', 50)})"""

# --- terms and features ---------------------------------------------------------------


def counts(source: str) -> str:
    return f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({word_list(3)}) AS term FROM ({source})) GROUP BY ALL"


def frequency(source: str, min_df: int) -> str:
    return f"SELECT term, count(*) AS df FROM ({counts(source)}) GROUP BY term HAVING count(*) >= {min_df}"


def tfidf(source: str, train: str, min_df: int) -> str:
    return f"""SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM (
  SELECT doc_id, c.term, (1 + ln(n)) * (ln((1.0 + total) / (1.0 + df)) + 1) AS w
  FROM ({counts(source)}) c JOIN ({frequency(train, min_df)}) f ON c.term = f.term, (SELECT CAST(count(*) AS DOUBLE) AS total FROM ({train})))"""


_DOCS = "SELECT doc_id, text FROM documents"
_LABELLED = f"SELECT *, {is_test('doc_id')} AS is_test FROM ({COMPANIES})"
_TRAIN = f"SELECT * FROM ({_LABELLED}) WHERE NOT is_test"
ORACLES["term_counts"] = counts(_DOCS)
ORACLES["doc_frequency"] = frequency(_DOCS, 100)
ORACLES["tfidf_sublinear"] = f"SELECT doc_id, term, {six('tfidf')} AS tfidf FROM ({tfidf(_DOCS, _DOCS, 100)})"
ORACLES["count_vectorize"] = f"SELECT doc_id, term, n FROM ({counts(COMPANIES)}) WHERE term IN (SELECT term FROM ({frequency(_TRAIN, 20)}))"
ORACLES["assemble_features"] = f"""SELECT doc_id, term AS name, {six('tfidf')} AS value FROM ({tfidf(COMPANIES, _TRAIN, 20)})
UNION ALL SELECT doc_id, 'Feature_taal', 1.0 FROM ({COMPANIES}) WHERE lang <> 'de'"""
ORACLES["feature_names"] = f"SELECT term AS name FROM ({frequency(_TRAIN, 20)}) UNION ALL SELECT 'Feature_taal'"
_WORDS = f"SELECT doc_id, unnest({SPACE_TOKENS}) AS word FROM documents"
_BYTES = ", ".join(f"CAST('0x' || substr(md5(word), {1 + 2 * i}, 2) AS INTEGER) / 257.0::DOUBLE" for i in range(8))
ORACLES["mean_word_vector"] = f"""
WITH w AS ({_WORDS}), k AS (SELECT word FROM (SELECT DISTINCT doc_id, word FROM w) GROUP BY word HAVING count(*) >= 20),
v AS (SELECT word, pos, value FROM ({numbered(f'[{_BYTES}]', 'word', 'k', 'value')})),
m AS (SELECT doc_id, pos, avg(value) AS value FROM w JOIN v ON w.word = v.word GROUP BY ALL)
SELECT d.doc_id, CAST(p.pos AS INTEGER) AS pos, {six('coalesce(m.value, 0.0::DOUBLE)')} AS value
FROM documents d CROSS JOIN (SELECT unnest(range(8)) AS pos) p LEFT JOIN m ON m.doc_id = d.doc_id AND m.pos = p.pos"""
ORACLES["embed_texts"] = f"""SELECT doc_id, 768 AS n_values,
CASE WHEN len({word_list(1)}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length FROM ({COMPANIES})"""
ORACLES["word2vec_vectors"] = f"SELECT word, 200 AS n_values FROM ({_WORDS}) GROUP BY word HAVING count(*) >= 5"
ORACLES["word_cooccurrence"] = f"""WITH t AS (SELECT row_number() OVER () AS r, {SPACE_TOKENS} AS tokens FROM documents),
p AS (SELECT r, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM t),
k AS (SELECT * FROM p WHERE w IN (SELECT w FROM p GROUP BY w HAVING count(*) >= 5))
SELECT a.w AS word, b.w AS context, count(*) AS n FROM k a JOIN k b ON a.r = b.r AND b.i <> a.i AND b.i BETWEEN a.i - 5 AND a.i + 5
GROUP BY a.w, b.w"""
ORACLES["split_train_test"] = f"SELECT doc_id, {is_test('doc_id')} AS is_test FROM documents"
ORACLES["sample_n"] = _SAMPLE.format(n=120)

# --- models ---------------------------------------------------------------------------

_VALUES = numbered("e", "vec_id, innov, is_test", f"({_SPLIT})", "v")
ORACLES["clf_bernoulli_nb"] = f"""
WITH x AS (SELECT vec_id, innov, is_test, pos, CAST(v > 0 AS INTEGER) AS b FROM ({_VALUES})),
prior AS (SELECT innov AS c, count(*) AS n, sum(count(*)) OVER () AS total FROM ({_SPLIT}) WHERE NOT is_test GROUP BY innov),
theta AS (SELECT innov AS c, pos, (sum(b) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) AS q FROM x WHERE NOT is_test GROUP BY ALL),
fit AS (SELECT x.vec_id, any_value(x.innov) AS innov, t.c, sum(CASE WHEN b = 1 THEN ln(q) ELSE ln(1 - q) END) AS s
  FROM x JOIN theta t ON x.pos = t.pos WHERE is_test GROUP BY x.vec_id, t.c),
score AS (SELECT f.vec_id, f.innov, f.c, f.s + ln((p.n + 1.0::DOUBLE) / (p.total + 2.0::DOUBLE)) AS s FROM fit f JOIN prior p ON p.c = f.c),
wide AS (SELECT vec_id, any_value(innov) AS innov, max(s) FILTER (c = 0) AS s0, max(s) FILTER (c = 1) AS s1 FROM score GROUP BY vec_id)
SELECT vec_id, innov, CAST(s1 > s0 AS INTEGER) AS pred, {six('1.0::DOUBLE / (1.0::DOUBLE + exp(s0 - s1))')} AS proba FROM wide"""
_COMPONENTS = numbered("e", "vec_id, innov", f"({VECTORS})", "v")
ORACLES["class_mean_cov"] = f"""
WITH x AS ({_COMPONENTS})
SELECT a.innov AS label, a.pos AS i, b.pos AS j, {six('avg(a.v)')} AS mean_i, {six('covar_samp(a.v, b.v)')} AS covariance
FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY a.innov, a.pos, b.pos"""


def bernoulli(train: str, rows: str, columns: str) -> str:
    """(columns of rows, pred, proba) of a Bernoulli model fitted on ``train``."""
    return f"""
WITH t AS ({numbered('e', 'vec_id, innov', f'({train})', 'v')}), x AS ({numbered('e', 'vec_id', f'({rows})', 'v')}),
prior AS (SELECT innov AS c, count(*) AS n, sum(count(*)) OVER () AS total FROM ({train}) GROUP BY innov),
theta AS (SELECT innov AS c, pos, (count(*) FILTER (v > 0) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) AS q FROM t GROUP BY ALL),
fit AS (SELECT vec_id, c, sum(CASE WHEN v > 0 THEN ln(q) ELSE ln(1 - q) END) AS s FROM x JOIN theta ON x.pos = theta.pos GROUP BY vec_id, c),
score AS (SELECT vec_id, f.c, s + ln((n + 1.0::DOUBLE) / (total + 2.0::DOUBLE)) AS s FROM fit f JOIN prior p ON p.c = f.c),
wide AS (SELECT vec_id, max(s) FILTER (c = 0) AS s0, max(s) FILTER (c = 1) AS s1 FROM score GROUP BY vec_id)
SELECT {columns}, CAST(s1 > s0 AS INTEGER) AS pred, 1.0::DOUBLE / (1.0::DOUBLE + exp(s0 - s1)) AS proba
FROM wide JOIN ({rows}) r ON r.vec_id = wide.vec_id"""


def by_company(scored: str, exact: bool = False) -> str:
    companies = f"""SELECT company, avg(innov) AS mean_innov, CAST(avg(proba) > {C.BEST_THRESHOLD}::DOUBLE AS INTEGER) AS decision
    FROM ({scored}) GROUP BY company"""
    return report(companies, "mean_innov", "decision", exact=exact)


_EARLY, _LATE = f"SELECT * FROM ({VECTORS}) WHERE scrape = 3", f"SELECT * FROM ({VECTORS}) WHERE scrape = 12"
ORACLES["nb_save_load_score"] = f"SELECT vec_id, innov, pred, {six('proba')} AS proba FROM ({bernoulli(_EARLY, _LATE, 'r.vec_id, innov')})"
ORACLES["nb_score_rows"] = f"SELECT vec_id, company, pred, {six('proba')} AS proba FROM ({bernoulli(VECTORS, VECTORS, 'r.vec_id, company')})"
_MARKED = f"SELECT *, {is_test('vec_id')} AS is_test FROM ({_EARLY})"
_SEEN, _HELD = (f"SELECT * EXCLUDE (is_test) FROM ({_MARKED}) WHERE {c}" for c in ("NOT is_test", "is_test"))
_BEFORE = by_company(bernoulli(_SEEN, _HELD, "company, innov"), exact=True)
_AFTER = by_company(bernoulli(_SEEN, _LATE, "company, innov"), exact=True)
ORACLES["nb_concept_drift_report"] = f"""SELECT a.row_name, {', '.join(f'{six("a." + f)} AS {f}' for f in ('precision', 'recall', 'f1'))},
a.support, {six('a.f1 - b.f1')} AS f1_change FROM ({_AFTER}) a JOIN ({_BEFORE}) b ON a.row_name = b.row_name"""
_KNOWN = f"SELECT * FROM ({VECTORS}) WHERE scrape = 3 AND company % 3 <> 0"
_UNSEEN = f"SELECT * FROM ({VECTORS}) WHERE company NOT IN (SELECT company FROM ({_KNOWN}))"
_EXTERNAL = bernoulli(_KNOWN, _UNSEEN, "company, innov")
ORACLES["nb_external_validation_report"] = f"""SELECT 'sentence' AS level, * FROM ({report(_EXTERNAL, 'innov', 'pred')})
UNION ALL SELECT 'company', * FROM ({by_company(_EXTERNAL)})"""

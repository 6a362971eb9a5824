"""SQL of the training-data queries in an independent database: the consistent form as an expression, and what follows from it.

It has no decomposition of characters, so the letters that decompose into a look-alike and an accent are replaced beforehand.
"""

from __future__ import annotations

import unicodedata

from termlode.llm.lookalikes import ARMENIAN, CYRILLIC, GREEK, HYPHENS, OTHER

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F)))
_HIDDEN = r"[\p{Cf}\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{034F}\x{FE00}-\x{FE0F}\x{115F}\x{1160}\x{3164}\x{FFA0}]"
_LOOK = CYRILLIC | GREEK | ARMENIAN | OTHER


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _translate(x: str, pairs: dict[str, str]) -> str:
    return f"translate({x}, {_quoted(''.join(pairs))}, {_quoted(''.join(pairs.values()))})"


def _accented() -> dict[str, str]:
    """Composed letters whose base is a look-alike, and their decomposition."""
    codes = (*range(0x370, 0x530), *range(0x1F00, 0x2000))
    found = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in codes}
    return {c: d for c, d in found.items() if len(d) > 1 and d[0] in _LOOK}


def form(text: str) -> str:
    """The consistent form of a text column."""
    x = f"regexp_replace(regexp_replace({text}, {_quoted(_HIDDEN)}, '', 'g'), '\\p{{Zs}}', ' ', 'g')"
    x = _translate(x, dict(zip(_WIDE, _PLAIN, strict=True)) | dict.fromkeys(HYPHENS, "-"))
    for code in range(0xFB00, 0xFB07):
        x = f"replace({x}, '{chr(code)}', '{unicodedata.normalize('NFKC', chr(code))}')"
    for c, d in _accented().items():
        x = f"replace({x}, '{c}', '{d}')"
    latin = _translate("w", _LOOK)
    back = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN}
    own = " ".join(f"WHEN regexp_matches(l, '\\p{{{s}}}') THEN {_translate('l', {b: a for a, b in reversed(pairs.items())})}" for s, pairs in back.items())
    scripts = " + ".join(f"CAST(regexp_matches(l, '\\p{{{s}}}') AS INTEGER)" for s in back)
    one = f"list_transform([{latin}], lambda l: CASE WHEN {scripts} > 1 THEN w {own} ELSE l END)[1]"
    pieces = f"regexp_extract_all({x}, '[\\p{{L}}\\x{{0300}}-\\x{{036F}}]+|[^\\p{{L}}\\x{{0300}}-\\x{{036F}}]+')"
    return f"CASE WHEN regexp_matches({text}, '[^\\x00-\\x7F]') THEN nfc_normalize(array_to_string(list_transform({pieces}, lambda w: CASE WHEN regexp_matches(w, '^[\\x00-\\x7F]*$') THEN w ELSE {one} END), '')) ELSE regexp_replace({text}, {_quoted(_HIDDEN)}, '', 'g') END"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


def _records(name: str, table: str, key: str, text: str, where: str = "TRUE") -> str:
    """Common table ``name(id, text, form, words)`` of the records with a word, one for each key."""
    return f"""{name}_forms AS MATERIALIZED (SELECT id, text, {form('text')} AS form FROM (SELECT {key} AS id, min({text}) AS text FROM {table} WHERE {where} AND {key} IS NOT NULL GROUP BY 1) WHERE text IS NOT NULL),
        {name} AS MATERIALIZED (SELECT *, {words('form')} AS words FROM {name}_forms WHERE len({words('form')}) > 0)"""


ARTICLES = _records("articles", "test_tbl_3", "article_id", "article_text")
QUERIES = _records("asked", "queries", "query_id", "query", "tbl = 3")
_TERMS = "counts AS MATERIALIZED (SELECT id, term, count(*) AS f FROM (SELECT id, unnest(words) AS term FROM articles) GROUP BY ALL), terms AS MATERIALIZED (SELECT term, CAST(sum(f) AS BIGINT) AS occurrences, count(*) AS records FROM counts GROUP BY term), total AS (SELECT count(*) AS n FROM articles)"
_MARK = "CASE WHEN records < 3 THEN 'rare' WHEN records > 0.1 * n THEN 'common' END"


def _pairs_alike(rel: str, name: str) -> str:
    return f"SELECT '{rel}' AS rel, CAST(a.id AS BIGINT) AS key_a, CAST(b.id AS BIGINT) AS key_b FROM {name} a JOIN {name} b ON a.form = b.form AND a.id < b.id AND a.text <> b.text"


def _canonical(rel: str, name: str) -> str:
    return f"SELECT '{rel}' AS rel, CAST(id AS BIGINT) AS rec_id, form AS canonical, CAST(min(id) OVER (PARTITION BY form) AS BIGINT) AS class_id, n - 1 AS links FROM {name} JOIN (SELECT form, count(DISTINCT text) AS n FROM {name} GROUP BY form) USING (form)"


def _best_terms(rel: str, name: str) -> str:
    return f"""SELECT '{rel}' AS rel, CAST(id AS BIGINT) AS rec_id, term FROM (
            SELECT id, term, round((1 + log2(f)) * log2(n / records), 6) AS w FROM (SELECT id, term, count(*) AS f FROM (SELECT id, unnest(words) AS term FROM {name}) GROUP BY ALL) JOIN terms USING (term), total
        ) WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, term) <= 3"""


#: Distinct sets of words with their least id, and the links between them.
_SETS = """sets AS MATERIALIZED (SELECT id, list_sort(list_distinct(words)) AS s FROM articles), nodes AS MATERIALIZED (SELECT min(id) AS node, s FROM sets GROUP BY s),
        member AS MATERIALIZED (SELECT id, node FROM sets JOIN nodes USING (s)), held AS MATERIALIZED (SELECT node, len(s) AS n, unnest(s) AS w FROM nodes),
        links AS MATERIALIZED (SELECT x.node AS a, y.node AS b FROM held x JOIN held y ON x.w = y.w AND x.node < y.node GROUP BY x.node, y.node, x.n, y.n HAVING 10 * count(*) >= 7 * (x.n + y.n - count(*)))"""
_FIELDS = r"""parts AS (SELECT id, unnest(string_split_regex(form, '[;|\r\n]')) AS p FROM articles WHERE regexp_matches(form, '[;|:=]')),
        fields AS (SELECT id, regexp_extract(p, '^([^:=]*)', 1) AS label, regexp_extract(p, '^[^:=]*[:=](.*)$', 1) AS value FROM parts),
        keys AS MATERIALIZED (
            SELECT id, 'w ' || array_to_string(words, ' ') AS k FROM articles
            UNION ALL SELECT id, 'f ' || array_to_string(list_sort(list_distinct(list(array_to_string(LABEL, ' ') || ':' || array_to_string(VALUE, ' ')))), ';') FROM fields WHERE len(LABEL) + len(VALUE) > 0 GROUP BY id
        ),
        reach AS (SELECT id, id AS r FROM articles UNION SELECT reach.id, b.id FROM reach JOIN keys a ON a.id = reach.r JOIN keys b ON a.k = b.k),
        classes AS MATERIALIZED (SELECT id, min(r) AS keep_id, count(*) AS copies FROM reach GROUP BY id)""".replace("LABEL", words("label")).replace("VALUE", words("value"))
_RUNS = f"""items AS (SELECT DISTINCT item_id, {words(form('item_text'))} AS w FROM eval_items WHERE item_id IS NOT NULL AND item_text IS NOT NULL), docs AS (SELECT doc_id, {words(form('text'))} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        item_runs AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 9], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM items)),
        doc_runs AS (SELECT doc_id, array_to_string(w[k : k + 9], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM docs))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {ARTICLES}, {QUERIES} {_pairs_alike('test_tbl_3', 'articles')} UNION ALL {_pairs_alike('queries', 'asked')}",
        "p1_canonical": f"WITH {ARTICLES}, {QUERIES} {_canonical('test_tbl_3', 'articles')} UNION ALL {_canonical('queries', 'asked')}",
        "p2_found": f"WITH {ARTICLES}, {_SETS} SELECT x.id AS article_id_a, y.id AS article_id_b FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links UNION ALL SELECT node, node FROM nodes) l JOIN member x ON x.node = l.a JOIN member y ON y.node = l.b WHERE x.id < y.id",
        "p2_groups": f"""WITH RECURSIVE {ARTICLES}, {_SETS}, edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (SELECT node, node AS r FROM nodes UNION SELECT reach.node, b FROM reach JOIN edges ON a = reach.r)
            SELECT id AS article_id, group_id, links FROM member JOIN (SELECT node, min(r) AS group_id FROM reach GROUP BY node) USING (node) JOIN (SELECT node, count(b) AS links FROM nodes LEFT JOIN edges ON a = node GROUP BY node) USING (node)""",
        "p3_found": f"WITH RECURSIVE {ARTICLES}, {_FIELDS} SELECT keep_id, id AS copy_id FROM classes WHERE id <> keep_id",
        "p3_collapsed": f"WITH RECURSIVE {ARTICLES}, {_FIELDS} SELECT article_id, coalesce(copies, 1) AS copies FROM (SELECT DISTINCT article_id FROM test_tbl_3 WHERE article_id IS NOT NULL) LEFT JOIN classes ON id = article_id WHERE keep_id IS NULL OR keep_id = article_id",
        "p4_found": f"WITH {ARTICLES}, {QUERIES}, {_TERMS} {_best_terms('test_tbl_3', 'articles')} UNION ALL {_best_terms('queries', 'asked')}",
        "p5_found": f"WITH {ARTICLES}, {_TERMS} SELECT term, {_MARK} AS mark FROM terms, total WHERE {_MARK} IS NOT NULL",
        "p5_frequencies": f"WITH {ARTICLES}, {_TERMS} SELECT term, occurrences, records, {_MARK} AS mark FROM terms, total",
        "p8_found": f"WITH {_RUNS} SELECT DISTINCT doc_id, item_id FROM item_runs JOIN doc_runs USING (run)",
    }

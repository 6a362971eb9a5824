"""The engine's expressions in the SQL of an independent database, whose regular expressions know no look-around.

A mark that stays between two neighbours is protected by a placeholder, in two passes because matches may share a neighbour; what is left of
the mark becomes a space, and the placeholder the mark again.
"""

from __future__ import annotations

from termlode.functions.stopwords import ENGLISH
from termlode.functions.text import ENDS, SYMBOLS

BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
LETTER, DIGIT, WORD = r"[\p{L}\p{Nl}\p{No}]", r"\p{Nd}", r"[\p{L}\p{N}_]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANK}', ' ', 'g'))"


def lonely(x: str, mark: str, neighbour: str) -> str:
    plain = mark.replace("\\", "")
    for _ in range(2):
        x = f"regexp_replace({x}, {quoted(f'({neighbour}){mark}({neighbour})')}, '\\1' || chr(1) || '\\2', 'g')"
    return f"replace(regexp_replace({x}, {quoted(mark + '+')}, ' ', 'g'), chr(1), {quoted(plain)})"


def spaces(x: str, characters: str) -> str:
    return f"translate({x}, {quoted(characters)}, '{' ' * len(characters)}')"


STEPS = {
    "clean_lower": lambda x: f"lower({x})",
    "accents_to_ascii": lambda x: rf"regexp_replace(strip_accents({x}), '[^\x00-\x7f]', '', 'g')",
    "remove_accents": lambda x: f"strip_accents({x})",
    "remove_non_ascii": lambda x: rf"regexp_replace({x}, '[^\x00-\x7f]', '', 'g')",
    "printable_ascii": lambda x: rf"regexp_replace(strip_accents({x}), '[^\x20-\x7e]+', '', 'g')",
    "unescape_quotes": lambda x: f"replace({x}, '\\''', '''')",
    "clean_quotes": lambda x: collapse(lonely(x, "'", LETTER)),
    "clean_commas": lambda x: collapse(lonely(x, ",", DIGIT)),
    "clean_dashes": lambda x: collapse(lonely(x, "-", WORD)),
    "clean_dots": lambda x: collapse(lonely(x, r"\.", WORD)),
    "clean_symbols": lambda x: collapse(spaces(x, SYMBOLS)),
    "clean_qmark": lambda x: collapse(spaces(x, ENDS)),
    "clean_apostrophe_s": lambda x: collapse(f"replace({x}, '''s ', ' ')"),
}
ORDER = ("clean_lower", "accents_to_ascii", "unescape_quotes", "clean_quotes", "clean_commas", "clean_dashes", "clean_dots", "clean_symbols", "clean_qmark", "clean_apostrophe_s")


def clean(x: str) -> str:
    for step in ORDER:
        x = STEPS[step](x)
    return x


STOP = ", ".join(map(quoted, ENGLISH))


_V, _SHORT = "aeiouy", "(^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$)"
# Fixed values of the published stemmer.
_WHOLE = "skis ski skies sky dying die lying lie tying tie idly idl gently gentl ugly ugli early earli only onli singly singl sky sky news news howe howe atlas atlas cosmos cosmos bias bias andes andes".split()
_STEP2 = (
    "ization ize ational ate fulness ful ousness ous iveness ive tional tion biliti ble lessli less entli ent ation ate alism al aliti al ousli ous iviti ive fulli ful enci ence anci ance abli able izer ize ator ate alli al "
    "bli ble ogi og li -"
).split()
_STEP3 = "ational ate tional tion alize al icate ic iciti ic ative - ical ic ness - ful -".split()
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()


def _suffix(name: str, before: str, endings: list[str], to: str, when: str) -> str:
    """A step that replaces the longest of some endings: ``e`` is the ending, ``x`` what stands before it."""
    found = f"SELECT *, regexp_extract(w, '({'|'.join(endings)})$', 1) AS e FROM {before}"
    return f"{name} AS (SELECT * EXCLUDE (w, e, x), CASE WHEN e <> '' AND NOT whole AND ({when}) THEN x || {to} ELSE w END AS w FROM (SELECT *, substr(w, 1, length(w) - length(e)) AS x FROM ({found})))"


def _replaced(pairs: list[str]) -> str:
    return "CASE e " + " ".join(f"WHEN '{a}' THEN '{b.strip('-')}'" for a, b in zip(pairs[::2], pairs[1::2], strict=True)) + " END"


def stems(words: str, name: str) -> str:
    """Common table ``name(term, stem)`` of the English stemmer over the query ``words(term)``, step by step and without a program."""
    k = [f"{name}{i}" for i in range(9)]
    whole = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(_WHOLE[::2], _WHOLE[1::2], strict=True))
    region, special = f"^[^{_V}]*[{_V}]+[^{_V}]", "^(gener|commun|arsen)"
    at_r1, at_r2 = "length(x) >= r1", "length(x) >= r2"
    ending = f"CASE WHEN e IN ('eed', 'eedly') THEN 'ee' WHEN regexp_matches(x, '(at|bl|iz)$') OR (regexp_matches(x, '{_SHORT}') AND r1 >= length(x)) THEN 'e' ELSE '' END"
    return rf"""
        {k[0]} AS MATERIALIZED (
            SELECT term, CASE term {whole} END AS fixed, regexp_replace(regexp_replace(regexp_replace(term, '^''', ''), '^y', 'Y'), '([{_V}])y', '\1Y', 'g') AS w FROM (SELECT DISTINCT term FROM ({words}))
        ),
        {k[1]} AS (
            SELECT *, CASE WHEN regexp_matches(w, '{special}') THEN length(regexp_extract(w, '{special}')) WHEN regexp_matches(w, '{region}') THEN length(regexp_extract(w, '{region}')) ELSE length(w) END AS r1 FROM {k[0]}
        ),
        {k[2]} AS (
            SELECT term, fixed, r1, CASE WHEN regexp_matches(substr(w, r1 + 1), '{region}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{region}')) ELSE length(w) END AS r2, regexp_replace(w, '(''s''|''s|'')$', '') AS w
            FROM {k[1]}
        ),
        {k[3]} AS MATERIALIZED (
            SELECT *, w IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') AS whole FROM (
                SELECT * EXCLUDE (w), CASE WHEN w LIKE '%sses' THEN substr(w, 1, length(w) - 2)
                    WHEN regexp_matches(w, 'ie[ds]$') THEN substr(w, 1, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
                    WHEN regexp_matches(w, '[^us]s$') AND regexp_matches(substr(w, 1, length(w) - 2), '[{_V}]') THEN substr(w, 1, length(w) - 1) ELSE w END AS w FROM {k[2]})
        ),
        {_suffix(k[4] + "a", k[3], ["eedly", "ingly", "edly", "eed", "ing", "ed"], ending, f"CASE WHEN e IN ('eed', 'eedly') THEN {at_r1} ELSE regexp_matches(x, '[{_V}]') END")},
        {k[4]} AS (
            SELECT * EXCLUDE (w, was), CASE WHEN w <> was AND regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN substr(w, 1, length(w) - 1) ELSE w END AS w FROM {k[4]}a JOIN (SELECT term, w AS was FROM {k[3]}) USING (term)
        ),
        {k[5]} AS (SELECT * EXCLUDE (w), CASE WHEN NOT whole AND regexp_matches(w, '.[^{_V}][yY]$') THEN substr(w, 1, length(w) - 1) || 'i' ELSE w END AS w FROM {k[4]}),
        {_suffix(k[6], k[5], _STEP2[::2], _replaced(_STEP2), f"{at_r1} AND (e <> 'ogi' OR x LIKE '%l') AND (e <> 'li' OR regexp_matches(x, '[cdeghkmnrt]$'))")},
        {_suffix(k[7], k[6], _STEP3[::2], _replaced(_STEP3), f"{at_r1} AND (e <> 'ative' OR {at_r2})")},
        {_suffix(k[8], k[7], _STEP4, "''", f"{at_r2} AND (e <> 'ion' OR regexp_matches(x, '[st]$'))")},
        {name} AS MATERIALIZED (
            SELECT term, CASE WHEN length(term) <= 2 THEN term WHEN fixed IS NOT NULL THEN fixed ELSE replace(CASE
                WHEN whole THEN w
                WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(substr(w, 1, length(w) - 1), '{_SHORT}'))) THEN substr(w, 1, length(w) - 1)
                WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN substr(w, 1, length(w) - 1) ELSE w END, 'Y', 'y') END AS stem
            FROM {k[8]}
        )"""


def _counts(source: str, key: str, profile: str, text: str) -> str:
    """``(key, term, tf)`` of ``source(key, text)`` before stemming."""
    split, term, keep = (r"'[ \t\n\r]+'", "t", f"t <> '' AND strlen(t) > 1 AND t NOT IN ({STOP})") if profile == "engine" else ("'[ ,.!?:;/]'", "lower(t)", f"t <> '' AND lower(t) NOT IN ({STOP})")
    return rf"SELECT {key}, {term} AS term, count(*) AS tf FROM (SELECT {key}, unnest(regexp_split_to_array(x, {split})) AS t FROM (SELECT {key}, {text} AS x FROM {source})) WHERE {keep} GROUP BY ALL"


def _table(name: str, counts: str, key: str, stem: bool) -> str:
    if not stem:
        return f"{name} AS MATERIALIZED ({counts})"
    return f"""{name}_raw AS MATERIALIZED ({counts}), {stems(f"SELECT term FROM {name}_raw", name + "_stems")},
        {name} AS MATERIALIZED (SELECT {key}, stem AS term, CAST(sum(tf) AS BIGINT) AS tf FROM {name}_raw JOIN {name}_stems USING (term) GROUP BY ALL)"""


def model(docs: str, profile: str = "engine", *, stem: bool = False, cleaned: bool = True) -> str:
    """The common tables of a model over ``docs`` (a query with doc_id and text), to be followed by a SELECT."""
    n = "(SELECT count(*) FROM docs)" if profile == "engine" else "(SELECT count(DISTINCT doc_id) FROM tf)"
    return rf"""
        WITH docs AS MATERIALIZED ({docs}),
        {_table("tf", _counts("docs", "doc_id", profile, clean("text") if cleaned else "text"), "doc_id", stem)},
        meta AS MATERIALIZED (SELECT {n} AS n_docs),
        vocab AS MATERIALIZED (SELECT term, count(*) AS df, log2(any_value(n_docs) / count(*)) AS idf FROM tf, meta GROUP BY term),
        postings AS MATERIALIZED (SELECT doc_id, term, tf, (1 + log2(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
        norms AS MATERIALIZED (SELECT doc_id, coalesce(norm, 0) AS norm FROM docs LEFT JOIN (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM postings GROUP BY doc_id) USING (doc_id))
    """


def scores(queries: str, profile: str = "engine", *, stem: bool = False, cleaned: bool = True) -> str:
    """More common tables: query vectors, norms and the score of every document with every query of ``queries(query_id, text)``."""
    return rf""",
        asked AS MATERIALIZED ({queries}),
        {_table("qtf", _counts("asked", "query_id", profile, clean("text") if cleaned else "lower(text)"), "query_id", stem)},
        qvec AS MATERIALIZED (SELECT query_id, term, tf, (1 + log2(tf)) * coalesce(idf, 0) AS w FROM qtf LEFT JOIN vocab USING (term)),
        qnorm AS (SELECT query_id, coalesce(norm, 0) AS norm FROM (SELECT DISTINCT query_id FROM asked) LEFT JOIN (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qvec GROUP BY query_id) USING (query_id)),
        dots AS MATERIALIZED (SELECT query_id, doc_id, sum(p.w * q.w) AS dot FROM postings p JOIN qvec q USING (term) WHERE p.w > 0 AND q.w > 0 GROUP BY ALL),
        sims AS (
            SELECT query_id, doc_id, CASE WHEN dot IS NULL OR q.norm * n.norm <= 0 THEN 0.0 ELSE round(dot / (q.norm * n.norm), 6) END AS similarity
            FROM qnorm q CROSS JOIN norms n LEFT JOIN dots USING (query_id, doc_id)
        ),
        ranked AS (SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM sims)
    """

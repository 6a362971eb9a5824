"""Portuguese stemmer after the published Snowball description."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = frozenset("aeiouáéíóúâêô")
# Fixed values of the published algorithm: suffixes of each step.
_REMOVED = (
    "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância"
).split()
_VERBS = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo "
    "indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis "
    "iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos emos aremos eremos iremos ássemos êssemos íssemos imos "
    "armos ermos irmos eu iu ou ira iras"
).split()
_REMOVED.sort(key=len, reverse=True)
_VERBS.sort(key=len, reverse=True)


def _regions(word: str) -> tuple[int, int, int]:
    n = len(word)

    def after(start: int) -> int:
        return next((i + 1 for i in range(start + 1, n) if word[i] not in _VOWELS and word[i - 1] in _VOWELS), n)

    r1 = after(0)
    r2 = after(r1)
    rv = n
    if n > 3:
        if word[1] not in _VOWELS:
            rv = next((i + 1 for i in range(2, n) if word[i] in _VOWELS), n)
        elif word[0] in _VOWELS:
            rv = next((i + 1 for i in range(2, n) if word[i] not in _VOWELS), n)
        else:
            rv = 3
    return r1, r2, rv


def _cut(word: str, suffix: str, region: int) -> bool:
    return word.endswith(suffix) and len(word) - len(suffix) >= region


def _standard(word: str, r1: int, r2: int, rv: int) -> str | None:
    """Step 1; None if nothing was changed."""
    ends = [s for s in (*_REMOVED, "logia", "logias", "ução", "uções", "ência", "ências", "amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras", "uça~o", "uço~es") if word.endswith(s)]
    if not ends:
        return None
    end = max(ends, key=len)
    at = len(word) - len(end)
    stem = word[:at]
    if end in _REMOVED:
        return stem if at >= r2 else None
    if end in ("logia", "logias"):
        return stem + "log" if at >= r2 else None
    if end in ("uça~o", "uço~es"):
        return stem + "u" if at >= r2 else None
    if end in ("ência", "ências"):
        return stem + "ente" if at >= r2 else None
    if end == "amente":
        if at < r1:
            return None
        if _cut(stem, "iv", r2):
            stem = stem[:-2]
            return stem[:-2] if _cut(stem, "at", r2) else stem
        return next((stem[:-2] for s in ("os", "ic", "ad") if _cut(stem, s, r2)), stem)
    if at < r2 and end not in ("ira", "iras"):
        return None
    if end == "mente":
        return next((stem[: -len(s)] for s in ("ante", "avel", "ável", "ível") if _cut(stem, s, r2)), stem)
    if end in ("idade", "idades"):
        return next((stem[: -len(s)] for s in ("abil", "ic", "iv") if _cut(stem, s, r2)), stem)
    if end in ("iva", "ivo", "ivas", "ivos"):
        return stem[:-2] if _cut(stem, "at", r2) else stem
    return stem + "ir" if at >= rv and stem.endswith("e") else None


@lru_cache(maxsize=200_000)
def stem_portuguese(word: str) -> str:
    word = word.replace("ã", "a~").replace("õ", "o~")
    r1, r2, rv = _regions(word)
    changed = _standard(word, r1, r2, rv)
    if changed is None:
        verb = next((s for s in _VERBS if _cut(word, s, rv)), None)
        changed = word[: -len(verb)] if verb else None
    if changed is not None:
        word = changed
        if _cut(word, "i", rv) and word[-2:-1] == "c":
            word = word[:-1]
    else:
        end = next((s for s in ("os", "a", "i", "o", "á", "í", "ó") if _cut(word, s, rv)), None)
        if end:
            word = word[: -len(end)]
    end = next((s for s in ("e", "é", "ê") if _cut(word, s, rv)), None)
    if end:
        word = word[:-1]
        if (word.endswith("gu") and _cut(word, "u", rv)) or (word.endswith("ci") and _cut(word, "i", rv)):
            word = word[:-1]
    elif word.endswith("ç"):
        word = word[:-1] + "c"
    return word.replace("a~", "ã").replace("o~", "õ")

"""Template residue and error-page text (problem 9).

1. Normalised lines (lower case, blanks collapsed, digits as ``#``) are counted by host over the host's different texts: copies of a text
   count once, so that a text with many copies can't turn its own lines into boilerplate.  Sentences are counted over all hosts, and so are the
   names of fields in slots that can be nothing else (``{{name}}``).
2. Lines that recur in a host are its page frame and are subtracted from its records, unless they hold evidence themselves.
3. A record is residue if a template slot, or the trace of an empty one, stands outside quotation marks, or if what remains is less than an
   article and holds evidence: error, filler, placeholder and script-required sentences, stock sentences that recur over hosts with no word
   of the record's own beside them, or mostly words of the web's own business.

What is a slot in single braces or brackets, where people also write remarks, is learned from the collection: a name counts as a field if it is
one in unmistakable slots elsewhere, or if it is one of a few that all forms have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlode.llm.words import sized
from termlode.plans.scratch import cut_lineage

# Fields that all forms have.
FORM_FIELDS = frozenset(
    "name,first name,last name,full name,title,subject,date,time,year,day,month,address,street,city,state,country,zip,email,phone,url,link,id,number,text,value,body,content,author,company,product,price,amount,quantity,user,username,"
    "password,message,recipient,sender,customer,description,keyword,tag,image,placeholder".split(",")
)
_NAME = r"[A-Za-z_][\w.\- ]*"
_FIELD = r"[\w.\-]+(?:\s+[\w.\-]+){0,3}"  # in round brackets, where sentences stand too, up to four words
_SURE = [
    rf"\{{\{{\{{?\s*({_NAME}?)\s*\}}?\}}\}}",  # {{name}}
    rf"[$#]\{{\s*({_NAME}?)\s*\}}",  # ${name} #{name}
    rf"<%[=\-]?\s*({_NAME}?)\s*%>", rf"\{{%\s*({_NAME}?)\s*%\}}", rf"%\(({_NAME})\)[sdif]", rf"%%({_NAME})%%", rf"@@({_NAME})@@", rf"\*\|({_NAME})\|\*", rf"<<\s*({_NAME}?)\s*>>", rf"&lt;\s*({_NAME}?)\s*&gt;",
    rf"\[\[\s*({_NAME}?)\s*\]\]", rf"(?<![\w])__({_NAME}?)__(?!\w)", r"[\[<]\s*insert\s+([^\]>)\n]+?)(?:\s+here)?\s*[\]>]",
    rf"\(\s*insert\s+({_FIELD}?)(?:\s+here)?\s*\)",
]
_SLOTS = [
    *(x.replace("(_", "(?:_").replace(f"({_NAME}", f"(?:{_NAME}").replace(f"({_FIELD}", f"(?:{_FIELD}").replace(r"([^\]", r"(?:[^\]") for x in _SURE),
    r"<%[^%<>\n]+%>", r"\{%[^%{}\n]+%\}",
    r"\$(?:[A-Za-z_][\w.]+|[A-Z][A-Z ]+)\$",
    r"[\[<]\s*(?:insert|enter|your|add)\s+[^\]>)\n]+[\]>]",
    rf"\(\s*(?:insert|enter|your|add)\s+{_FIELD}\s*\)",
    r"[\[<][^\]>\n]+\s(?:goes here|to be confirmed[^\]>\n]*|to come|here)[\]>]",
    r"\[object object\]",
    r"#(?:ref|name|value|n/a|null|num|div/0)[!?]",
    r"!![\w.]{2,}!!|\?\?[\w.]{2,}\?\?",
    r"\{(?:\w+[._]\w[\w.]*|\d{1,2})\}", r"(?<!\w)\[\w+[._]\w[\w.]*\]",
]
#: Told by capitals; of no use in a text that is in capitals altogether.
_CASED_SLOTS = [r"(?<!\w)[{\[](?!SIC\b)[A-Z][A-Z_]+(?: [A-Z]+)*[}\]]", r"(?<![\w.,%])%[sd](?![\w%])", r"(?<![\w-])(?:NaN|\(null\)|\(undefined\))(?![\w-])", r"(?<!\w)(?:FIXME|TODO)(?!\w)"]
#: Words that stand for a word to come, in texts of any case.
_DUMMIES = [r"(?<![\w-])X{3,}(?![\w-])", r"(?<!\w)(?:TBD|TBA|TBC)(?!\w)", r"(?<!\w)[A-Z]+(?:_[A-Z]+)+(?!\w)"]
SLOT = re.compile("|".join(_SLOTS), re.IGNORECASE)
SURE = re.compile("|".join(_SURE), re.IGNORECASE)
CASED_SLOT = re.compile("|".join(_CASED_SLOTS))
DUMMY_SLOT = re.compile("|".join(_DUMMIES))
SINGLE = re.compile(rf"(?<!\w)[{{\[]\s*({_NAME}?)\s*[}}\]]")
#: An undefined value printed as a word; not the adjective of a thing that can be undefined.
UNDEFINED = re.compile(r"(?<![\w-])undefined(?![\w-])(?! (?:border|boundar\w+|behaviou?r|limits?|terms?|role|status|period)\b)", re.IGNORECASE)
#: A field in guillemets, which are quotation marks too: searched before quotations in them are removed.
GUILLEMETS = re.compile(rf"«\s*({_NAME}?)\s*»")
#: What a slot can't be without, besides what ``_WORD_HINT`` finds.
_HINTS = ("{", "[", "<", "%", "$", "#", "@@", "*|", "!!", "??", "_", "XXX", "«", "NaN", "(null)", "TB", "TODO", "FIXME")
_WORD_HINT = re.compile(r"\(\s*(?:insert|enter|your|add)\s|&lt;|undefined", re.IGNORECASE)
_QUOTES = r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|`[^`\n]+`"
QUOTED_OTHERWISE = re.compile(_QUOTES)
QUOTED = re.compile(_QUOTES + r"|«[^»\n]*»")

# Words of the web's own business, by language; no matter of an article is told mostly in them.
WEB_WORDS = frozenset(
    "page pages site website webpage url link server servers browser browsers javascript java script scripts cookies cookie error errors request requests response available unavailable maintenance offline timeout timed gateway "
    "denied forbidden permission unauthorized login log logged sign signed session expired refresh reload reloading redirected redirecting loading captcha robot robots verify verification human content load loaded exist exists "
    "removed retry again later support administrator webmaster account subscribe placeholder template default enable enabled disable disabled required supported unsupported update upgrade adblock blocker traffic unusual security check click view visit button confirm reset connection resource deleted moved blocked block restricted exceeded limit device network unexpected encountered invalid suspended "
    "heading caption paragraph sample dummy text insert edit body "
    "página páginas sítio enlace servidor navegador erro solicitud disponible disponível indisponível manutenção mantenimiento acesso acceso denegado negado permissão permiso sessão sesión expirou expirado carregar cargar carregando "
    "cargando existe encontrada encontrado recarregue recargue atualize actualice ative active novamente nuevo conteúdo contenido verifique sou soy robô "
    "sitio vuelva visita confirme pulse botón botão recurso bloqueado bloqueada conexión conexão texto ejemplo exemplo "
    "seite seiten webseite fehler anfrage verfügbar erreichbar wartung wartungsarbeiten zugriff zugang verweigert berechtigung sitzung abgelaufen laden lädt geladen existiert gefunden aktualisieren inhalt platzhalter anmelden anmeldung gesperrt verbindung klicken schaltfläche bestätigen roboter beispieltext".split()
)

# What sites print in place of an article, by language.
_EVIDENCE = [
    # scripts demanded
    r"\b(?:java ?script|scripts?|cookies|js)\b.{0,60}\b(?:enable[d]?|disabled|required?|requires?|needs?|needed|must be|turn(?:ed)? (?:it )?on|switch(?:ed)? (?:them |it )?on|allow(?:ed)?|blocking|blocked|support(?:ed)?|off)\b",
    r"\b(?:enable|needs?|requires?|require|activate|allow|turn on|switch on|blocking|support for|with|without)\b.{0,30}\b(?:java ?script|scripts|js|cookies)\b",
    r"\bjs support\b", r"\bbrowser settings\b", r"^(?:please )?(?:turn|switch) (?:it|them) on\b", r"\bchecking your browser\b", r"^this takes about # seconds", r"^loading\b",
    r"\b(?:ative|habilite|active|habilite-os|habilítelos|aktivieren|aktiviere|activez|einschalten)\b.{0,40}\b(?:java ?script|scripts?|navegador|browser)\b",
    r"\b(?:precisa de|requiere|necesita|requer|exige|benötigt|erfordert|braucht)\b.{0,20}\b(?:scripts?|skripte|java ?script)\b", r"\bschalten sie\b.{0,30}\bein\b", r"\bjava ?script\b.{0,60}\b(?:aktivieren|einschalten|deaktiviert|desactivado|desativado|continuar|leyendo|leitura|lesen)\b",
    # errors
    r"\b(?:fatal|internal server|parse|syntax|runtime|uncaught|database|connection|unexpected) error\b", r"\b(?:fatal|parse) error:", r"^(?:http )?(?:error|erro|fehler|código de error|fehlercode) ?#", r"^error\b", r"^# (?:not found|forbidden|error|bad gateway|internal)", r"\b(?:page|file|article|document|url)\b.{0,20}\b(?:not found|no longer exists|does not exist|cannot be found|was not found)\b",
    r"^not found\b", r"\bwe (?:can't|can’t|cannot|could not|couldn't) find\b", r"\bcheck the (?:address|url|link)\b", r"\bbad gateway\b", r"\bupstream\b.{0,20}\b(?:time|answer|respond|response)\b", r"\b(?:gateway|connection|request) time-?d?\s?out\b", r"\bservice (?:is )?(?:temporarily |currently )?unavailable\b", r"\btry again (?:in|later)\b",
    r"\btoo many requests\b", r"^wait # ", r"\baccess (?:is |was )?denied\b", r"\b(?:lack|have no|don't have|do not have) permission\b", r"^incident #", r"^incident [\w#]+$", r"\bsession (?:has )?expired\b", r"\bsign in (?:again )?to\b", r"^(?:oops|sorry)\b", r"\bsomething went wrong\b", r"\bcould not (?:be loaded|complete your request|connect|load)\b",
    r"\bdatabase connection\b", r"\btraceback \(most recent call last\)", r"^file \".{0,60}\", line #", r"^\w*(?:error|exception): ?", r"\bstack trace\b", r"\bon line #", r"\bno se (?:encuentra|encontró)\b", r"\bpágina n(?:ão|o) encontrada\b", r"\bo endereço pode ter mudado\b", r"\bcompruebe la dirección\b", r"\bverifique o endereço\b",
    r"\bacc?es[os]+ (?:negado|denegado|refusé|verweigert)\b", r"\bzugriff verweigert\b", r"\bserviço (?:está )?indisponível\b", r"\bservicio no está disponible\b", r"\b(?:tente|inténtelo|intente) de n[ou]e?vo\b", r"\binténtelo en # ", r"\btente (?:de novo )?em # ", r"\b(?:dienst|seite) (?:ist|nicht|wurde)\b.{0,30}\b(?:erreichbar|gefunden|verfügbar)\b", r"\bprüfen sie die adresse\b", r"\bversuchen sie es\b", r"\bpermissão para\b", r"\bpermiso para\b", r"\bberechtigung\b",
    r"\byou (?:do not|don't) have access\b",
    # filler and placeholders
    r"\blorem ipsum\b", r"\bplaceholder (?:copy|text|content)\b", r"\bcontent goes here\b", r"\btext goes here\b", r"\breplace it with your own\b", r"\bsample (?:paragraph|text|copy)\b", r"\byour (?:article )?(?:text|content|story)\b.{0,20}\b(?:here|appear)\b", r"\bdummy (?:body|text|copy|closing|content)\b", r"\bblindtext\b", r"\bplatzhalter", r"\bmustertext\b", r"\bbeispieltext\b",
    r"\bhier steht (?:später )?der (?:text|inhalt)", r"\baqu[ií] vai? (?:el|o|la|a) (?:cuerpo|texto|text|notícia|noticia|conteúdo|contenido)\b", r"\btexto de (?:exemplo|ejemplo|relleno|preenchimento|prueba|teste)\b", r"\b(?:substitua|sustituya|ersetzen sie) (?:este|esta|diesen|diese)\b", r"\b(?:parágrafo|párrafo|absatz) (?:fict[íi]cio|dient nur|de (?:exemplo|ejemplo|prueba|teste))\b", r"\bapenas para testar\b", r"\bsolo para probar\b", r"\bnur zur ansicht\b",
    r"\bthis is (?:a )?(?:test|placeholder|dummy|sample)\b", r"\bcoming soon\b", r"\bunder construction\b",
]
EVIDENCE = re.compile("|".join(_EVIDENCE), re.IGNORECASE)
#: Words of which every kind of evidence holds at least one, or else one of ``KEY_PARTS`` anywhere; sentences without any skip the patterns.
#: Words here are runs of letters, as ``\b`` sees them: "javascript-enabled" holds "javascript".
KEYS = frozenset(
    "javascript java script scripts cookies js browser navegador skripte loading turn switch found exists exist find check bad gateway upstream timeout connection request unavailable again later requests wait "
    "denied permission incident expired sign oops sorry wrong loaded load connect complete database traceback file stack line encuentra encontró encontrada encontrado mudado compruebe verifique negado denegado refusé "
    "verweigert zugriff indisponível disponible tente inténtelo intente dienst seite prüfen versuchen permissão permiso berechtigung lorem placeholder goes replace sample your dummy blindtext mustertext beispieltext "
    "hier aqui aquí exemplo ejemplo relleno preenchimento prueba teste substitua sustituya ersetzen parágrafo párrafo absatz testar probar ansicht test soon construction ative habilite active habilítelos "
    "aktivieren aktiviere activez einschalten precisa requiere necesita requer exige benötigt erfordert braucht schalten deaktiviert desactivado desativado access not endereço dirección código erro fehler fehlercode".split()
)
KEY_PARTS = ("error", "exception", "platzhalter", "# seconds", "# forbidden", "# internal")  # their patterns leave a side open
_LIKE_ASCII = str.maketrans("ıſ", "is")  # letters that patterns take for these without regard to case
_PART = re.compile(r"[^\W_]+")


def has_evidence(sentence: str, words: list[str]) -> bool:
    """Whether a normalised sentence holds one of the fixed messages; ``words``: its words."""
    ascii_only = sentence.isascii()
    plain = sentence if ascii_only else sentence.translate(_LIKE_ASCII)
    if not ascii_only or "-" in plain or "'" in plain:
        words = _PART.findall(plain)
    if KEYS.isdisjoint(words) and not any(x in plain for x in KEY_PARTS):
        return False
    return bool(EVIDENCE.search(sentence))


# Words of the usual pseudo-Latin filler, and programmers' dummy words.
PSEUDO_LATIN = frozenset(
    "lorem ipsum dolor sit amet consec consectetur consectetuer adipiscing adipisci elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua aliq enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident "
    "sunt culpa qui officia deserunt mollit anim id est laborum massa felis augue nunc porta vitae vestibulum pellentesque mauris donec aenean vivamus praesent sodales ornare lacus".split()
)
DUMMY = frozenset("foo bar baz qux quux blah bla asdf qwerty xyz xxx test testing dummy".split())
_BLANK = re.compile(r"\s+")
_DIGITS = re.compile(r"\b[0-9a-f]*\d[0-9a-f]*\b|\d+")  # codes in hexadecimal too
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")


def field_names(text: str) -> set[str]:
    """Names of fields in slots that can be nothing else."""
    if not any(c in text for c in _HINTS) and not _WORD_HINT.search(text):
        return set()
    found = {_BLANK.sub(" ", next(g for g in m.groups() if g is not None)).strip().lower() for m in SURE.finditer(QUOTED.sub(" ", text)) if any(g is not None for g in m.groups())}
    return {x for x in found if x}


def _is_field(name: str, fields: frozenset[int]) -> bool:
    name = _BLANK.sub(" ", name).strip().lower()
    return name in FORM_FIELDS or line_number("{" + name) in fields


def has_slot(text: str, fields: frozenset[int] = frozenset()) -> bool:
    """A template slot, or the trace of an empty one, outside quotation marks; ``fields``: numbers of learned field names."""
    if not any(c in text for c in _HINTS) and not _WORD_HINT.search(text):
        return False
    if "«" in text and any(_is_field(m.group(1), fields) for m in GUILLEMETS.finditer(QUOTED_OTHERWISE.sub(" ", text))):
        return True
    bare = QUOTED.sub(" ", text) if any(c in text for c in "\"“„«`") else text
    if SLOT.search(bare) or DUMMY_SLOT.search(bare) or UNDEFINED.search(_BLANK.sub(" ", bare)):
        return True
    if any(_is_field(m.group(1), fields) for m in SINGLE.finditer(bare)):
        return True
    return text.upper() != text and bool(CASED_SLOT.search(bare))


def normal_line(line: str) -> str:
    return _DIGITS.sub("#", _BLANK.sub(" ", line).strip().lower())


def line_number(plain: str) -> int:
    """64-bit hash of a normalised line."""
    n = xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def is_evidence(sentence: str) -> bool:
    """Whether a normalised sentence is an error message, a demand for scripts, a placeholder or filler."""
    words = _TOKEN.findall(sentence)
    return has_evidence(sentence, words) or is_filler(words)


def is_filler(words: list[str]) -> bool:
    """Mostly pseudo-Latin or dummy words (three or more), or a few words repeated over and over."""
    if len(words) < 3:
        return False
    odd = sum(w in PSEUDO_LATIN for w in words)
    dummy = sum(w in DUMMY for w in words)
    kinds = len(set(words))
    return odd >= 0.7 * len(words) or dummy >= 0.7 * len(words) or kinds == 1 or (len(words) >= 8 and kinds <= min(6, len(words) / 4))


@lru_cache(4096)
def _bears_evidence(plain: str) -> bool:
    return any(is_evidence(x) for x in _SENTENCE.split(plain))


def is_residue(
    text: str | None, frame: frozenset[int] | set[int] = frozenset(), stock: frozenset[int] | set[int] = frozenset(), fields: frozenset[int] = frozenset(), *, article_words: int = 12, frame_words: int = 6, web_share: float = 0.2
) -> bool:
    """Whether a text is template residue or stands in place of an article.

    ``frame``, ``stock``, ``fields``: numbers of the lines to subtract unless they hold evidence, of the sentences that recur over hosts, and of
    learned field names.  A text with ``article_words`` words of its own, in sentences that are neither evidence nor stock nor a title or menu
    (up to ``frame_words`` words without an end mark), is an article, whatever else it holds; the whole text is searched for slots.
    """
    if not text or not text.strip():
        return False
    if has_slot(text, fields):
        return True
    evidence, own, stocked = 0, 0, 0
    seen: list[str] = []
    for line in text.split("\n"):
        plain = normal_line(line)
        if not plain or (frame and line_number(plain) in frame and not _bears_evidence(plain)):
            continue
        for sentence in _SENTENCE.split(plain):
            words = _TOKEN.findall(sentence)
            seen += words
            if has_evidence(sentence, words) or is_filler(words):
                evidence += 1
            elif stock and line_number(sentence) in stock:
                stocked += len(words)
            elif not (len(words) <= frame_words and sentence[-1:] not in ".!?…"):  # a short line without an end is a title or a menu
                own += len(words)
                if own >= article_words:
                    return False
    return bool(evidence) or is_filler(seen) or (not own and stocked >= 4) or sum(w in WEB_WORDS for w in seen) >= max(2, web_share * len(seen))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different lines, sentences and field names of each text, by number: a line's length doesn't matter to what is shuffled."""
    for b in batches:
        hosts, numbers, kinds = [], [], []
        for host, text in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
            lines = {normal_line(x) for x in text.split("\n")} if "\n" in text else {normal_line(text)}
            lines.discard("")
            sentences = {x for line in lines for x in _SENTENCE.split(line)}
            made = {line_number(x): 2 for x in sentences}
            if "\n" in text:
                for x in lines:
                    k = line_number(x)
                    made[k] = made.get(k, 0) | 1
            for x in field_names(text):
                made[line_number("{" + x)] = 4
            hosts += [host] * len(made)
            numbers += made
            kinds += made.values()
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(numbers, pa.int64()), pa.array(kinds, pa.int8())], names=["host", "line", "kind"])


def _judge(known):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames, stock, fields = known.value
        none: frozenset[int] = frozenset()
        for b in batches:
            docs, hosts, texts, own = (b.column(k).to_pylist() for k in range(4))
            bad = [d for d, h, t, f in zip(docs, hosts, texts, own, strict=True) if is_residue(t, frames.get(h, none) if f is None else set(f), stock, fields)]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64())], names=["doc_id"])

    return judge


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(d, h, line_number(x)) for d, h, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for x in {normal_line(y) for y in t.split("\n")} if x]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["doc_id", "host", "line"])


def template_residue(
    df: DataFrame, key: str, text: str, host: str, *, least_copies: int = 5, least_share: float = 0.001, stock_copies: int = 10, stock_share: float = 1e-4, field_copies: int = 3, field_share: float = 1e-5, most_frame: int = 200_000
) -> DataFrame:
    """``(doc_id)``: the records that are residue instead of an article.

    A line is page frame if it stands in ``least_copies`` or more different texts of its host and in ``least_share`` or more of them; a sentence is
    stock if it stands in ``stock_copies`` different texts and ``stock_share`` of all, over two hosts or more; a name is a field if it is one in
    ``field_copies`` texts and ``field_share`` of all.  The shares bound how many stock sentences and fields there can be by the sentences of
    an average text.  Frame lines are broadcast up to ``most_frame`` of them and beyond that joined to the texts that hold them.

    NULL is a host of its own; lines of any length count, by a 64-bit hash.  NULL, empty and blank texts are no case; rows with a NULL key are
    left out; repeated rows of a key count once if their texts are equal, and else are judged one by one and named once.
    """
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{host}`").cast("string"), F.lit(""))).alias("host"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    marked = rows.select("doc_id", "host", F.xxhash64("text").alias("h"))
    copied = marked.groupBy("host", "h").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    again = cut_lineage(marked.join(copied, ["host", "h"]).where("doc_id != kept").select("doc_id").distinct(), "again")
    counted = rows.join(sized(again), "doc_id", "left_anti").select("host", "text").mapInArrow(_counted, "host bigint, line bigint, kind tinyint")
    per_host = counted.groupBy("host", "line").agg(*[F.sum(F.col("kind").bitwiseAND(F.lit(bit)).cast("bigint") / bit).cast("bigint").alias(name) for bit, name in ((1, "lines"), (2, "sentences"), (4, "fields"))])
    per_host = cut_lineage(per_host, "lines")
    size = marked.join(sized(again), "doc_id", "left_anti").groupBy("host").agg(F.count("*").alias("n"))
    frame = cut_lineage(per_host.where(F.col("lines") >= least_copies).join(size, "host").where(F.col("lines") >= F.col("n") * least_share).select("host", "line"), "frame")
    texts = size.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    over = per_host.groupBy("line").agg(F.sum("sentences").alias("s"), F.sum("fields").alias("f"), F.count("*").alias("hosts"))
    is_stock = (F.col("s") >= max(stock_copies, stock_share * texts)) & (F.col("hosts") > 1)
    found = over.where(is_stock | (F.col("f") >= max(field_copies, field_share * texts))).select("line", is_stock.alias("stock")).collect()
    frames: dict[int, set[int]] = {}
    small = frame.count() <= most_frame
    for r in frame.collect() if small else ():
        frames.setdefault(r["host"], set()).add(r["line"])
    known = df.sparkSession.sparkContext.broadcast((frames, frozenset(r["line"] for r in found if r["stock"]), frozenset(r["line"] for r in found if not r["stock"])))
    if small:
        judged = rows.select("doc_id", "host", "text", F.lit(None).cast("array<bigint>").alias("frame"))
    else:
        held = rows.where(F.col("text").contains("\n")).select("doc_id", "host", "text").mapInArrow(_framed, "doc_id bigint, host bigint, line bigint")
        framed = held.join(frame, ["host", "line"]).groupBy("doc_id").agg(F.collect_set("line").alias("frame"))
        judged = rows.join(framed, "doc_id", "left").select("doc_id", "host", "text", "frame")
    return judged.mapInArrow(_judge(known), "doc_id bigint").distinct()

"""Problem 6: template residue, filler, error pages and other stand-ins, by a multi-pattern automaton."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least share of a text's letters that must be covered by matches.
COVERAGE = 0.72

# Phrases that a page, server, template or form shows in place of content.
PHRASES = """
page not found|file not found|not found|error|http status|http error|status|forbidden|unauthorized|unauthorised|bad request
bad gateway|gateway timeout|gateway time-out|request timeout|request time-out|too many requests|internal server error
internal error|server error|service unavailable|service temporarily unavailable|temporarily unavailable|unavailable|gone
method not allowed|payment required|not acceptable|connection timed out|connection refused|connection reset|timed out
server replied|request blocked|request rejected|request failed|rate limit exceeded|retry in|try again later|missing parameter
exception|traceback most recent call last|stack trace|undefined variable|fatal error|warning|segmentation fault|null pointer
title|oops|null|nan|none|undefined|object object|unknown|n a|not available|no title|no title available|untitled|untitled document
access denied|access to this page has been denied|access restricted|permission denied|you do not have permission
has been blocked|has been removed|has been suspended|resource you are looking for|cannot be found|can t be found|could not be found
couldn t find|could not find|does not exist|no longer exists|no longer available|no results found|nothing found
content is currently unavailable|page is currently unavailable|item is currently unavailable|in the resolver|doi cannot be found
javascript|java script|scripting|cookies|cookie policy|enable javascript|javascript is required|requires javascript
javascript and cookies|javascript support|your browser|browser is not supported|unsupported browser|switched off|turned off
please turn it on|turn on|must be enabled|must be active|must be allowed|is disabled|is blocked|reload the page|reload
are you a robot|are you human|verify you are a human|verify you are human|verify that you are|captcha|security check
checking your browser|checking your browser before accessing|attention required|just a moment|one more step|ddos protection
please wait|please wait while|while we load|loading|now loading|redirecting|you are being redirected|click here
sign in|sign in to continue|log in|login|log on|log out|institutional login|choose your institution|register|create an account
subscription required|subscribe|purchase access|buy this article|access options|get access|session has expired|session expired
your session has expired|accept cookies|to continue reading|under maintenance|scheduled maintenance|under construction
site under maintenance|coming soon|maintenance|home|homepage|home page|welcome|snapshot|new page|main page|index|search results
table of contents|view article|view pdf|download pdf|full text|pdf|test|testing|asdf|qwerty|xxx|foo|bar|foo bar|blah|tbd|tba|todo
to be determined|to do|placeholder|title placeholder|insert title|insert title here|enter title|enter the title|your title goes here
your title here|your title|title goes here|the title|preferred title|subtitle goes here|article title|page title|document title|document name|document|add title|type title
replace with|headline|title here|sample title|example title|default title|lorem ipsum|dolor sit amet|sed ut perspiciatis
unde omnis iste natus|consectetur adipiscing elit|dummy text|sample text|draft|ip address
seite nicht gefunden|nicht gefunden|zugriff verweigert|zugang verweigert|bitte aktivieren sie javascript|bitte warten|fehler|anmelden
wird geladen|startseite|ohne titel|seite nicht verfügbar|server nicht erreichbar|interner serverfehler|nicht verfügbar|sitzung abgelaufen
page introuvable|page non trouvée|accès refusé|accès interdit|veuillez activer javascript|veuillez patienter|erreur|chargement|accueil
sans titre|connexion requise|contenu indisponible|se connecter|votre session a expiré
página no encontrada|acceso denegado|acceso prohibido|active javascript|habilite javascript|espere por favor|por favor espere|cargando
inicio|sin título|contenido no disponible|iniciar sesión|su sesión ha caducado|no encontrado
página não encontrada|acesso negado|acesso proibido|ative o javascript|por favor aguarde|aguarde|carregando|sem título|não encontrada
conteúdo indisponível|iniciar sessão|sua sessão expirou|erro
stránka nenalezena|přístup odepřen|přístup zamítnut|povolte javascript|prosím čekejte|načítání|bez názvu|chyba|přihlásit se|nenalezeno
страница не найдена|доступ запрещён|доступ запрещен|включите javascript|пожалуйста подождите|подождите|загрузка|без названия|ошибка
страница недоступна|войти|главная|сессия истекла|не найдено
页面不存在|页面未找到|找不到页面|访问被拒绝|拒绝访问|请启用|请稍候|正在加载|加载中|无标题|未命名|错误|服务器错误|请登录|首页
pagina non trovata|accesso negato|errore|pagina niet gevonden|toegang geweigerd|nie znaleziono strony|sidan hittades inte
"""
# Words that only fill such messages, and the usual words of filler text.
FILLERS = """
a an the to this that your you are we our is was be been has have must please and or for with in of it on off by before accessing
page article document content site website reader view show open load continue sorry oops while because while currently reference
number line title name required below here support s t can could cannot not no t requested request id record call last
most recent enable enabled disabled blocked allowed active verify need needs browser app run http https www html status code
return back try again later seconds s enter insert add type your goes item heading resource paper site journal library online
microsoft word docx doc missing parameter author authors
"""
LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim
veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit
esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est
laborum perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam
"""

_NAME = r"[\w.\-]+(?:[ _\-][\w.\-]+){0,2}"
#: A variable, tag or marker of a template language.
PLACEHOLDER = re.compile(
    r"\$?\{\{[^{}]*\}\}|\{%[^{}]*%?\}|<%[^<>]*%?>|\[\[[^\[\]]*\]\]|[#$]\{\s*[^{},]*\}|\{\s*" + _NAME + r"\s*\}|\{\d*\}"
    r"|%\(" + _NAME + r"\)s|%[a-z][\w.\-]*%|\$[a-z][\w.\-]*\$|##[\w.\-]+##|@@[\w.\-]+@@|__[\w\-]+?__|«[\w. \-]+»?"
    r"|<(?:[a-z]+[_\-.])*(?:title|site|name|headline|heading|journal|document|paper|doc)(?:[_\-.][a-z]+)*>|(?<!\w):[a-z_.]+:(?!\w)"
    r"|\[\s*(?:[a-z]+[ _.])*(?:title|site|name|headline|heading|journal|document)(?:[ _][a-z]+)*\s*\]"
    r"|\b[a-z]+_(?:placeholder|title|headline|name)\b|\[object object\]",
    re.IGNORECASE,
)
#: The name of a file or the address of a page.
FILE = re.compile(
    r"^\W*(?:microsoft word - )?[\w\-. ()]*\.(?:pdf|html?|xhtml|php|aspx?|jsp|docx?|tex|txt|rtf|xml|png|jpe?g|gif|tiff?|ps|eps|epub|pptx?|xlsx?|zip)\W*$"
    r"|^\W*(?:https?://|www\.)\S+$|^\W*(?:document|untitled|draft|scan|image|page|file)[ _\-]?\d*\W*$",
    re.IGNORECASE,
)
#: The bare address of a site: lower case, with a usual ending, or a country's after two names or before a path. Other dotted words may be titles.
HOST = re.compile(r"^\W*(?:[a-z0-9\-]+\.)+(?:com|org|net|edu|gov|info|example)(?:/\S*)?\W*$|^\W*(?:[a-z0-9\-]+\.){2,}[a-z]{2}(?:/\S*)?\W*$|^\W*[a-z0-9\-]+\.[a-z]{2}/\S*$")
#: A number alone that is the code of an error; other numbers may be titles.
CODE = re.compile(r"^\W*[45]\d\d\W*$")
#: A site's name beside or in place of a title; a cut-off end counts.
SITE = re.compile(r"^\w+ (?:l|li|lib|libr|libra|librar|library|o|on|onl|onli|onlin|online)$", re.IGNORECASE)
SEPARATOR = re.compile(r"\s+(?:\||-|–|—|::|»|·)(?:\s+|$)|^(?:\||::|»|·)\s+|\s\|$")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for strong, text in ((False, FILLERS), (False, LATIN)):
        for word in text.split():
            found.add_word(f" {word} ", (len(word), strong))
    for phrase in re.split(r"[|\n]", PHRASES):
        if phrase.strip():
            phrase = " ".join(re.findall(r"[^\W\d_]+", phrase))
            cjk = "㐀" <= phrase[0] <= "鿿"
            # a word that alone is a message is none where a title speaks of it
            found.add_word(phrase if cjk else f" {phrase} ", (len(phrase), True if cjk or " " in phrase else None))
    found.make_automaton()
    return found


_LATIN_WORDS = frozenset(LATIN.split())
_PHRASES = sorted({" ".join(re.findall(r"[^\W\d_]+", p)) for p in re.split(r"[|\n]", PHRASES) if p.strip()})
_WORDS = sorted({w for text in (PHRASES.replace("|", " "), FILLERS) for w in text.split()})
#: A site's name that closes a message without a mark between.
CLOSING_SITE = re.compile(r"\s\w+ (?:library|librar|libra|libr|online|onlin|onli|onl)$", re.IGNORECASE)


def _begun(word: str) -> bool:
    """Whether a cut-off word begins a known one."""
    at = bisect_left(_WORDS, word)
    return len(word) >= 2 and at < len(_WORDS) and _WORDS[at].startswith(word)


def coverage(text: str | None, sites: frozenset[str] = frozenset()) -> float:
    """Share of the letters of a title that matches cover; 0 without a phrase, placeholder or filler, or for no text.

    Names of sites at either end are set aside; a title of nothing else, of no letters, or of a
    file or address is covered whole.
    """
    if text is None or not text.strip():
        return 0.0
    plain = re.sub(r"[\s ]+", " ", text).strip()
    if " " not in plain and plain.count("_") > 1 and not re.fullmatch(PLACEHOLDER, plain):
        # blanks written as underscores, those of markers such as __TITLE__ aside
        plain = re.sub(r"(?<!_)_(?!_)", " ", plain)
    if FILE.match(plain) or HOST.match(plain):
        return 1.0
    parts = [p.strip() for p in SEPARATOR.split(plain)]
    cut = lambda p: len(text) >= 99 and len(p) >= 4 and any(s.startswith(p) for s in sites)
    rest = [p for p in parts if p and not (SITE.match(p) or p.lower() in sites)]
    if len(rest) > 1 and cut(rest[-1].lower()):
        rest = rest[:-1]
    if not rest:
        return 1.0
    body = CLOSING_SITE.sub("", " ".join(rest))
    for name in sites:
        if len(body) > len(name) and body.lower().endswith(" " + name):
            body = body[: -len(name)]
    masked = PLACEHOLDER.sub(" \x00 ", body)
    strong = "\x00" in masked
    body_letters = sum(map(str.isalpha, re.sub("\x00", "", masked)))
    words = re.findall(r"[^\W\d_]+", masked.lower())
    if not body_letters:
        # marks alone are no title, but a number may be one
        return 1.0 if strong or not re.search(r"\d", masked) or CODE.match(masked) else 0.0
    if words and words[-1] not in _LATIN_WORDS and _begun(words[-1]):
        words[-1] = _WORDS[bisect_left(_WORDS, words[-1])]
    latin = sum(w in _LATIN_WORDS for w in words)
    if len(words) >= 3 and latin >= 0.8 * len(words):
        strong = True
    single = f" {' '.join(words)} "
    covered = bytearray(len(single))
    for end, (length, is_phrase) in _automaton().iter(single):
        if single[end] == " ":
            covered[end - length : end] = b"\x01" * length
        else:
            covered[end - length + 1 : end + 1] = b"\x01" * length
        strong |= is_phrase if is_phrase is not None else not ("of" in words and not any(map(str.isdigit, body)))
    # a phrase that the end of the text cuts off
    for k in range(len(words)):
        tail = " ".join(words[k:])
        at = bisect_left(_PHRASES, tail)
        if len(tail) >= 8 and at < len(_PHRASES) and _PHRASES[at].startswith(tail):
            covered[len(single) - 1 - len(tail) : len(single) - 1] = b"\x01" * len(tail)
            strong = True
            break
    if not strong:
        return 0.0
    return sum(c for c, ch in zip(covered, single) if ch != " ") / max(1, sum(ch != " " for ch in single))


def find_stand_ins(
    records: DataFrame, id_col: str, text_col: str, sites: DataFrame | None = None, threshold: float = COVERAGE
) -> DataFrame:
    """(id, coverage) of the records whose text is residue, filler, a message or another stand-in.

    ``sites`` is a one-column table of names of publishers and sites, which may stand beside a
    title; a record is compared with the names its own parts equal. Null and empty texts are no
    cases. A text of any length is matched whole; repeated rows stay repeated.
    """
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and trim(text) <> ''")
    if sites is None:
        named = rows.withColumn("names", F.array().cast("array<string>"))
    else:
        names = sites.toDF("name").select(F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
        low = F.lower(F.trim("text"))
        closing = [F.substring_index(low, " ", -k) for k in range(1, 6)]
        parts = F.split(low, r"\s+(?:\||-|–|—|::|»|·)(?:\s+|$)|^(?:\||::|»|·)\s+")
        pieces = F.explode(F.array_distinct(F.concat(parts, F.array(*closing))))
        first = rows.select("text").distinct().select("text", pieces.alias("piece")).withColumn("name", F.trim("piece"))
        known = first.join(names, "name").groupBy("text").agg(F.collect_set("name").alias("names"))
        named = rows.join(known, "text", "left")

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            marks = [coverage(t, frozenset(n if n is not None else ())) for t, n in zip(b["text"], b["names"])]
            yield pd.DataFrame({"id": b["id"], "coverage": marks})

    schema = f"id {rows.schema['id'].dataType.simpleString()}, coverage double"
    return named.select("id", "text", "names").mapInPandas(scored, schema).where(F.col("coverage") >= threshold)

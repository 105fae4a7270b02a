"""Template residue, filler and error-page text (inverted index of exemplars, TF-IDF containment).

Labelled exemplars, each one passage, are indexed by term. A document is cut into passages, and these
into overlapping windows. For each window the index gives the exemplars that share a term with it; its
containment is the largest IDF-weighted share of its terms that one exemplar holds, with IDF weights
from the document counts of the whole corpus. Covered windows of messages (errors, script notices)
exclude a document when they hold a good part of its weight; filler counts wherever it stands as prose.
Placeholders are exemplars as well: a delimited name is retrieved by
its opening sign and contained in an exemplar if its signs and the form of its name are the same;
marks that code, a tool or an explanation accounts for don't count.

Defined results: NULL and empty texts are no residue; repeated rows are judged alike; very long
texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Exemplars by class, one a line: status texts of RFC 9110 and the default pages of public servers,
#: frameworks, hosts, proxies and browsers; notices of public script bundles; filler of editors.
EXEMPLARS = {
    "error": """
400 Bad Request. Your browser sent a request that this server could not understand
401 Unauthorized. Authorization required
This server could not verify that you are authorized to access the document requested
403 Forbidden. You don't have permission to access this resource on this server
Access denied. You are not authorized to access this page
Access to this resource on the server is denied
You do not have sufficient permissions to view this folder, file or repository
404 Not Found. The requested URL was not found on this server
The page you are looking for could not be found
The page you requested does not exist or is no longer available
Sorry, we can't find that page. It may have been moved or deleted
The file was not found. This file does not exist anymore
The file or directory you requested has been removed, renamed or deleted
This repository does not exist or has not been published. Branch not found
The resource you are looking for might have been removed, had its name changed, or is temporarily unavailable
The page you were looking for doesn't exist. You may have mistyped the address or the page may have moved
There isn't a page here. The main branch of this repository does not contain the path
No such key. The specified key does not exist
405 Method Not Allowed. The requested method is not allowed for this URL
408 Request Timeout. 410 Gone
429 Too Many Requests. You have sent too many requests in a given amount of time
API rate limit exceeded for your IP address. You have exceeded a secondary rate limit
Please reduce your request rate. Please wait a few minutes before you try again
You have exceeded the request limit per hour of your account. Retry after
500 Internal Server Error. Something went wrong
The server encountered an internal error or misconfiguration and was unable to complete your request
The server encountered an unexpected condition that prevented it from fulfilling the request
We're sorry, but something went wrong on our side. An error occurred while processing your request
An unexpected error has occurred. The request failed because of an internal failure
Whitelabel Error Page. This application has no explicit mapping for error, so you are seeing this as a fallback
There was an unexpected error, type not found, status
Application error: a client side exception has occurred, see the browser console for more information
502 Bad Gateway nginx
The proxy server received an invalid response from an upstream server
Upstream connect error or disconnect, reset before headers. The origin server did not respond
503 Service Unavailable. The server is temporarily unable to service your request due to maintenance downtime or capacity problems
The service is temporarily overloaded or down for maintenance, please come back later. The server is currently unable to handle the request
We are down for scheduled maintenance. We'll be back soon
504 Gateway Timeout. The gateway did not receive a timely response from the upstream server
The server took too long to respond. The request or connection timed out while loading
This site can't be reached. The server refused to connect. DNS address could not be found
The page could not be loaded. Check your connection and try again
This page isn't working. The site didn't send any data. The page was not shown
Your session has expired. Please log in again to continue
You need to sign in or sign up before continuing. Please sign in to view this page
You must be logged in to access this file or folder. This page requires a login
Sign in to your account. Log in with your user name and password. Forgot your password
You have been blocked by network security. To continue, log in to your account or use your developer token
If you think you've been blocked by mistake, file a ticket
Sorry, you have been blocked. You are unable to access this website
Access to this page has been denied because we believe you are using automation tools
You need permission or access rights to view this content. This project is private and not open to the public
Additionally, a 404 Not Found error was encountered while trying to use an ErrorDocument to handle the request
Oops. Whoops. Sorry. Page not found. Error
Go back to the home page. Return to the start page. Go to the front page
Please try again later. Try the search box. Check the address and try again
If the problem persists, contact the administrator, owner or support and quote the error code
Reference number, ray id, request id, incident id
This domain is parked. Domain for sale
error code status message reason detail title type instance kind note id documentation url timestamp path trace request errors fault
Seite nicht gefunden. Die angeforderte Seite konnte nicht gefunden werden
Der angeforderte URL konnte auf dem Server nicht gefunden werden. Objekt nicht gefunden
Diese Seite existiert nicht oder ist nicht mehr verfügbar. Die Datei wurde nicht gefunden
Die Datei wurde gelöscht, verschoben oder umbenannt. Die Webseite kann nicht geladen werden
Zugriff verweigert. Zugriff nicht erlaubt. Sie haben keine Berechtigung
Bitte melden Sie sich an. Sie müssen angemeldet sein, um diese Seite zu sehen. Anmeldung erforderlich
Interner Serverfehler. Der Server antwortet nicht. Ein Fehler ist aufgetreten
Zu viele Anfragen. Bitte versuchen Sie es später noch einmal
Diese Domain ist geparkt. Diese Domain steht zum Verkauf
Page non trouvée. La page demandée est introuvable ou n'existe pas
L'URL demandée n'a pas pu être trouvée sur ce serveur. Le fichier est introuvable
Le fichier a été supprimé ou déplacé. Cette page n'existe plus
Accès refusé. Accès interdit. Vous n'avez pas l'autorisation d'accéder à cette page
Veuillez vous connecter. Vous devez être connecté pour accéder à cette page ou à ce fichier. Connexion requise
Erreur interne du serveur. Le serveur ne répond pas. Le délai d'attente a été dépassé. Une erreur est survenue
Trop de requêtes. Veuillez réessayer plus tard
Página no encontrada. La página solicitada no existe. No se encontró la página
No se ha localizado la URL solicitada en este servidor. El archivo no existe
El archivo fue eliminado o movido. No se puede acceder a esta página ni cargar el sitio
Acceso denegado. No tiene permiso para acceder a esta página
Inicie sesión para continuar. Esta página requiere iniciar sesión
Error interno del servidor. El servidor no responde. Se ha producido un error
Demasiadas solicitudes. Inténtelo de nuevo más tarde""",
    "script": """
You need to enable JavaScript to run this app
Please enable JavaScript to continue using this application
Enable JavaScript and cookies to continue. This page requires JavaScript and cookies enabled
JavaScript is required to view this site. This site requires JavaScript
JavaScript is disabled in your browser. Please turn on JavaScript in your browser settings and reload or refresh the page
We've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser
Your browser does not support JavaScript or has scripts turned off
This site does not work properly without JavaScript enabled. Scripts must be enabled
Some parts of the site will not display or work while JavaScript is turned off in your browser
For full functionality of this site it is necessary to enable JavaScript
Checking your browser before accessing the site. Checking if the site connection is secure
Just a moment. Please wait while we verify that you are not a robot
Verify you are human by completing the action below. Please complete the captcha
This process is automatic. Your browser will redirect to your requested content shortly
Bitte aktivieren Sie JavaScript in Ihrem Browser, um fortzufahren. JavaScript muss aktiviert sein
Veuillez activer JavaScript dans votre navigateur pour afficher ce contenu ou ce fichier
Active JavaScript en su navegador. Habilite el JavaScript para continuar y mostrar el contenido""",
    "filler": """
Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum pellentesque habitant morbi tristique senectus et netus malesuada fames ac turpis egestas vestibulum tortor quam feugiat vitae ultricies eget donec libero semper aenean mi mauris placerat eleifend leo quisque sapien ullamcorper pharetra curabitur vivamus suspendisse tincidunt maecenas fringilla sodales lectus risus porta augue urna massa ornare cursus nunc
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti
Your content goes here. Your text here. Your content here. Text goes here
Insert text here. Insert your description here. Insert content here
Add your content here. Add a description here. Add text here. Add a summary here
Put your text here. Put your description here
Enter your text here. Type your text here. Write something here. Write your description here
This is a paragraph. Click here to add your own text and edit me
Sample text. Sample text goes here. Sample page
Placeholder text. Dummy text. Filler text. Example text goes here
Title goes here. Heading goes here. Description goes here. Subtitle goes here. Caption goes here
Replace this text with your own content. Delete this text
This is dummy copy, it is not meant to be read
Coming soon. Under construction. To be written. More to come
TBD. TODO. N/A
xxx xxxx xxxxx xx
asdf asdfasdf asdf qwerty qwer zxcv
blah blah blah, bla bla bla""",
    #: Signs and the form of the name in between, as generators of projects write them.
    "placeholder": """
{{ project_name }}
{{cookiecutter.project_slug}}
{{ Project Name }}
{{PROJECT}}
{% project_name %}
<% name %>
<%= app_name %>
%APP_NAME%
$$NAME$$
@@NAME@@
##NAME##
%%NAME%%
__PROJECT_NAME__
<your name>
<insert your name here>
[INSERT NAME]
[YOUR NAME HERE]
[ADD TEXT]
[ENTER NAME]
[REPLACE THIS]
[PUT NAME HERE]
[FILL IN]
#{name}
<<name>>
${PROJECT_NAME}
${AUTHOR}
XX_NAME_XX""",
}
_DIGIT = re.compile(r"\d")
_TERM = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?:;\n]+(?=\s|$)|\n")
_CODE = re.compile(r"\.(?:py|js|ts|rs|go|cs)$")
_TAGGED = re.compile(r"^\s*(?:<!|<\?|<[a-zA-Z])")
_ASIDE = re.compile(r"(?is)<(style|title|script|ul|nav|code|pre|q|blockquote)\b.*?</\1\s*>|<!--.*?-->|`[^`\n]*`")
_TAG = re.compile(r"<[^>]*>")
_COMMENT = re.compile(r"(?m)^[ \t]*(?://+!?|#+|\*|--)[ \t]?(.*)$")

#: A delimited name: an opening sign, what stands between, the closing sign.
_DELIMITED = re.compile(
    r"(?P<o>(?<![${\\{])\{\{-?|\{%-?|<%=?|(?<![$\w])\$\{|(?<!#)#\{|(?<!<)<<(?!<))(?P<a> ?[A-Za-z][\w. -]{0,60}? ?)(?P<c>-?\}\}(?!\})|-?%\}|%>|\}|>>)"
    r"|(?P<o2>\$\$|@@|##|%%|(?<!%)%)(?P<a2>[A-Z][A-Z_0-9]+)(?P<c2>(?P=o2))|(?<!\w)(?P<o3>__|XX_)(?P<a3>[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*)(?P<c3>__|_XX)(?!\w)"
    r"|(?P<o4>\[)(?P<a4>[A-Z]+(?: [A-Z]+)*)(?P<c4>\])|(?P<o5><)(?P<a5>[a-z]+(?:[ _-][a-z]+)+)(?P<c5>>)"
)
#: What a delimited name may begin with: found fast, then looked at closely.
_QUICK = re.compile(r"\{\{|\{%|<%|<<|\$\{|#\{|\$\$|@@|##|%%|%[A-Z]|__[A-Z]|XX_|\[[A-Z]|<[a-z]")
_WHOLE_WORDS = frozenset("your insert enter add my replace put fill".split())
_MADE_ONCE = re.compile(r"(?:^|_)(?:PROJECT|TITLE|NAME|AUTHOR|COMPANY|VERSION|DESCRIPTION|PACKAGE|MODULE|COMPONENT|YOUR|ORG|LICEN[CS]E|YEAR)(?:_|$)")
_LOGIC = re.compile(r"(?:<%-?|\{%-?)\s*(?:if|else|elsif|elif|end\w*|for|each|while|block|include|extends|set)\b")
_CREDENTIAL = re.compile(r"(?i)key|token|secret|passw|pwd|credential|bearer|auth(?!or)|_ref\b|Ref\b")
_EXPLAINED = re.compile(r"(?i)\b(?:filled|fills|replaced|placeholder|placeholders|engine|stand-in|syntax|expanded|substituted|rendered|renders|interpolat\w+|such as|looks? like|written as)\b")
_STRING = re.compile(r"""(?:\b[rbfuRBFU]{1,2})?("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)""")
#: Terms of a window, and how far apart windows of a passage begin.
WINDOW, STEP = 5, 2


#: Words compare by so many first letters, a crude stemmer for any language.
STEM = 5


_STEMMED = re.compile(rf"([^\W_]{{1,{STEM}}})[^\W_]*")


def words(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def terms(text: str) -> list[str]:
    return _STEMMED.findall(text.lower())


def mark_shape(m: re.Match) -> tuple[str, str, str] | None:
    """(opening sign, form of the name, closing sign) of a delimited name, without blanks and dashes."""
    for k in ("", "2", "3", "4", "5"):
        o, a, c = (m[x + k] for x in "oac")
        if o is not None:
            a = a.strip()
            words = re.split(r"[ _.-]+", a)
            if k in ("4", "5"):  # single brackets are common: an asking word must open them
                return (o, "asks", c) if words[0].lower() in _WHOLE_WORDS else None
            if o == "${":
                return (o, "made once", c) if a.isupper() and _MADE_ONCE.search(a) else None
            if o in ("#{", "<<", "<%", "<%=", "{%", "{%-"):
                return (o.rstrip("-"), "lower", c.lstrip("-")) if a == a.lower() and (len(words) == 1 or "_" in a or "." in a or o == "<<") else None
            form = "name" if o.startswith("{{") else "upper" if len(words) > 1 or o not in ("%", "__") else None
            return (o.rstrip("-"), form, c.lstrip("-")) if form else None
    return None


def _mark_index() -> dict[str, set[tuple[str, str]]]:
    """opening sign -> {(form, closing sign)} of the exemplars."""
    index: dict[str, set[tuple[str, str]]] = {}
    for line in EXEMPLARS["placeholder"].strip().split("\n"):
        for m in _DELIMITED.finditer(line):
            if shape := mark_shape(m):
                index.setdefault(shape[0], set()).add(shape[1:])
    return index


class Exemplars:
    """The inverted index: term -> exemplars that hold it, and the class of each exemplar."""

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.index: dict[str, list[int]] = {}
        for kind in ("error", "script", "filler"):
            for line in EXEMPLARS[kind].strip().split("\n"):
                # A line's sentences tell one thing and are met together or alone.
                self.kinds.append(kind)
                for t in set(terms(line)):
                    self.index.setdefault(t, []).append(len(self.kinds) - 1)
        self.vocabulary = sorted(self.index)
        self.messages = {t for t, xs in self.index.items() if any(self.kinds[x] != "filler" for x in xs)}
        self.filler = {t for t, xs in self.index.items() if any(self.kinds[x] == "filler" for x in xs)}


_EX = Exemplars()
_MARKS = _mark_index()


def placeholders(text: str, path: str) -> bool:
    """Does the text hold a mark that should have been replaced?"""
    code = bool(_CODE.search(path))
    if re.search(r"(?:^|/)templates?/", path) and not code:
        return False
    strings: list[tuple[int, int]] | None = None
    logic: bool | None = None
    for q in _QUICK.finditer(text):
        m = _DELIMITED.match(text, q.start())
        shape = m and mark_shape(m)
        if not shape or shape[1:] not in _MARKS.get(shape[0], ()):
            continue
        lo = text.rfind("\n", 0, m.start()) + 1
        hi = text.find("\n", m.end())
        line = text[lo : hi if hi >= 0 else len(text)]
        if _CREDENTIAL.search(line[: m.start() - lo]) or _CREDENTIAL.search(m[0]):
            continue
        if _EXPLAINED.search(line):
            continue
        if code:
            if strings is None:
                strings = [s.span() for s in _STRING.finditer(text)]
            comment = line.lstrip().startswith(("//", "#", "*", "/*", "--"))
            if not comment and any(a <= m.start() and m.end() <= b for a, b in strings):
                continue
        elif shape[0] in ("<%", "<%=", "{%"):
            if logic is None:
                logic = bool(_LOGIC.search(text))
            if logic:  # a template with conditions or loops is filled by its engine
                continue
        return True
    return False


def visible(text: str) -> str:
    """What a reader sees as content: no tags, titles, lists of links, code spans or quotations."""
    if _TAGGED.match(text):
        return _TAG.sub("\n", _ASIDE.sub("\n", text))
    return text


def prose(text: str, path: str) -> str:
    """Where filler would stand: the visible text, of code only its comments, of data nothing."""
    if _TAGGED.match(text):
        return _ASIDE.sub("\n", visible(text))
    if _CODE.search(path):
        return re.sub(r"\n(?=[a-z])", " ", "\n".join(_COMMENT.findall(text)))
    return "" if path.endswith((".json", ".yaml", ".env")) else _ASIDE.sub("\n", text)


def passages(text: str) -> list[list[str]]:
    return [t for t in map(terms, _SENTENCE.split(text)) if t]


def windows(passage: Sequence[str]) -> Iterator[tuple[int, Sequence[str]]]:
    """Windows of a passage with their first place; a short passage is one."""
    for k in range(0, max(1, len(passage) - WINDOW + STEP), STEP):
        yield k, passage[k : k + WINDOW]


class _Weights(dict):
    """IDF weights of the exemplar terms; other terms weigh ``unknown``, ids and numbers nothing."""

    unknown = 1.0

    def __missing__(self, t: str) -> float:
        if len(self) > 500_000:  # memory stays bounded
            for x in [x for x in self if x not in _EX.index]:
                del self[x]
        got = self[t] = 0.0 if _DIGIT.search(t) else self.unknown
        return got


class Weigher:
    """Containment of windows in exemplars, by the IDF weights of one corpus."""

    def __init__(self, counts: dict[str, int], n_docs: int):
        self.weight = _Weights((t, math.log((n_docs + 1) / (counts.get(t, 0) + 0.5))) for t in _EX.vocabulary)
        held = sorted(w for t, w in self.weight.items() if counts.get(t))
        if held:
            self.weight.unknown = held[len(held) // 2]  # as the middle one of the terms that the corpus holds
        self.message = {t: self.weight[t] for t in _EX.messages}

    def best(self, window: Sequence[str], kinds: tuple[str, ...]) -> tuple[float, int]:
        """(largest share of the window's weight that one exemplar of these kinds holds, that exemplar).

        A single term of several is no containment.
        """
        distinct = set(window)
        total, by, shared = 0.0, Counter(), Counter()
        for t in distinct:
            w = self.weight[t]
            total += w
            for x in _EX.index.get(t, ()):
                by[x] += w
                shared[x] += 1
        least = min(2, len(distinct))
        by = [(w, -x) for x, w in by.items() if shared[x] >= least and _EX.kinds[x] in kinds]
        if not by or not total:
            return 0.0, -1
        w, x = max(by)
        return w / total, -x

    def contained(self, passage: Sequence[str], kinds: tuple[str, ...], share: float) -> dict[str, float]:
        """Weight of the terms that exemplars hold in covered windows, by class."""
        by: dict[int, str] = {}
        for k, win in windows(passage):
            got, x = self.best(win, kinds)
            if got >= share:
                for j, t in enumerate(win, k):
                    if x in _EX.index.get(t, ()):
                        by.setdefault(j, _EX.kinds[x])
        out = Counter()
        for j, kind in by.items():
            out[kind] += self.weight[passage[j]]
        return out


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents of this task by exemplar term held; one row a term and task."""
    known, counts = set(_EX.vocabulary), Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                counts.update(known.intersection(terms(text)))
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])


def filler(text: str, path: str, w: Weigher, share: float) -> float:
    """The best containment of a window of prose in a filler exemplar, or 0 if it is below the share."""
    top = 0.0
    times = Counter(map(tuple, passages(prose(text, path))))
    for p, n in times.items():
        if len(p) < 3:
            continue
        if len(set(p)) == 1 and p[0].isalpha():
            return 1.0  # one word over and over
        known = [x in _EX.filler for x in p]
        if not any(known):
            continue
        # Text that stands there again and again is likely to be none: a smaller share will do.
        least = share * (2 / 3 if n >= 3 else 1)
        for k, win in windows(p):
            near = known[k : k + WINDOW]
            if sum(near) * 2 >= len(win) and (len({x for x, y in zip(win, near) if y}) > 2 or len(win) == len(p)) and (got := w.best(win, ("filler",))[0]) >= least:
                top = max(top, got)
    return top


def judge(text: str, path: str, w: Weigher, message_share: float, window_share: float, filler_share: float) -> tuple[str | None, float]:
    """(class or None, coverage) of a text."""
    if placeholders(text, path):
        return "placeholder", 1.0
    if got := filler(text, path, w, filler_share):
        return "filler", got
    seen = visible(text)
    every = terms(seen)
    total = sum(map(w.weight.__getitem__, every))
    # No more can be contained than is known at all.
    if not total or sum(map(w.message.get, every, repeat(0.0))) < message_share * total:
        return None, 0.0
    by, split = Counter(), passages(seen)
    # Single terms tell something beside a message of several only, such as names of fields.
    for p in sorted(split, key=len, reverse=True):
        if len(p) > 1 or by or len(split) == 1:
            by.update(w.contained(p, ("error", "script"), window_share))
    contained = sum(by.values())
    return (max(by, key=by.get), contained / total) if contained >= message_share * total else (None, 0.0)


def residue(documents: DataFrame, message_share: float = 0.3, window_share: float = 0.5, filler_share: float = 0.6) -> DataFrame:
    """(doc_id, kind, coverage) of documents that are template residue; kind: placeholder, filler, error, script.

    ``coverage`` is the share of a document's weight that exemplars hold in covered windows (messages), or
    the containment of its best window (filler).
    """
    # One row per exemplar term at most: bounded by the exemplars, whatever the corpus.
    counts = {r["term"]: r["n"] for r in documents.select("text").mapInArrow(_held, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    w = Weigher(counts, max(1, documents.count()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for doc, text, path in zip(*(b.column(i).to_pylist() for i in range(3))):
                kind, score = judge(text, path or "", w, message_share, window_share, filler_share) if text else (None, 0.0)
                if kind:
                    for c, x in zip(out, (doc, kind, round(score, 6))):
                        c.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["doc_id", "kind", "coverage"])

    return documents.select("doc_id", "text", "path").mapInArrow(weigh, "doc_id bigint, kind string, coverage double").distinct()

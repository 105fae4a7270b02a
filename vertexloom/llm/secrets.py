"""Credentials in source text (linear-chain conditional random field over lexical tokens).

Every line of every text is labelled: its tokens get shape and context features, and the Viterbi path
of a two-label chain marks the tokens that form a usable secret. Most lines need no path: a bound on
what a token can score in any context, computed once a distinct token from the weights, proves that
the best path marks nothing. Adjacent marked tokens are one span, the exact characters to be redacted.
Private keys are marked from their BEGIN line to the END line, as their format says. The weights are
trained by ``secrets_train`` on lines it makes itself and lie beside this module.

Defined results: NULL and empty texts hold nothing; a value split over string pieces counts at its
first piece; line numbers count line feeds; repeated rows are judged alike; long texts are read whole.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from importlib.resources import files
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"[A-Za-z0-9_+/.\-%!#$^*~\\|]+={0,2}|[^\sA-Za-z0-9]")
#: The tokens that can matter for a line: single characters are ruled out, which ``Crf`` makes sure of.
_LONG = re.compile(r"[A-Za-z0-9_+/.\-%!#$^*~\\|]{2,}={0,2}")
_INSIDE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/.-%!#$^*~\\|").__contains__
_PARAM = re.compile(r"[?&]\s*[A-Za-z0-9_+/.\-%!#$^*~\\|]+\s*=")
#: Types of a value, which stand between its name and it.
_TYPES = frozenset("str String string char byte bytes".split())
#: Signs that tokens of several characters hold.
TOKEN_SIGNS = re.compile(r"[_+/.\-%!#$^*~\\|=]")
_LOW, _UP, _DIGIT, _OTHER = (re.compile(x).search for x in ("[a-z]", "[A-Z]", r"\d", "[^A-Za-z0-9]"))
_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
_KEYS = frozenset("password passwd pass pwd passphrase secret token key apikey auth authorization bearer basic credential credentials signing private access sig signature login authtoken".split())
#: Names that end in one of these without a mark of their own, such as PGPASSWORD.
_KEY_ENDS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "pwd", "credentials")
_INERT = frozenset("hash digest sum checksum integrity uuid id ref name field label header realm public cert certificate rev revision commit tree trace etag verify icon pixel image sha md5 fingerprint content nonce version page".split())
_STAND_IN = re.compile(r"(?i)change_?me|replace|example|dummy|redacted|placeholder|your|insert|xxxx|\*\*\*|\.\.\.|^<|todo|sample|^password$|^secret$|^token$|^x-[a-z-]+$|^none$|^null$|^true$|^false$|^test$|secret_?here|not_?set|deploy time")
MODEL = Path(__file__).with_name("secrets_model.json")


@lru_cache(1 << 16)
def shape_features(t: str) -> tuple[str, ...]:
    """What a token's characters tell."""
    n = len(t)
    if n == 1 and not t.isalnum():
        return ("p=" + t,)
    low, up, dig = (sum(map(f, t)) for f in (str.islower, str.isupper, str.isdigit))
    other = n - low - up - dig
    f = ["len=" + str(min(n, 8) if n < 8 else 8 + min(n - 8, 56) // 8), f"cls={int(low > 0)}{int(up > 0)}{int(dig > 0)}{int(other > 0)}"]
    runs = len(re.findall(r"[a-z]+|[A-Z]+|\d+|[^A-Za-z0-9]+", t))
    f.append("runs=" + str(min(runs * 10 // n, 9) if n > 7 else "s"))
    counts = Counter(t)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    f.append("ent=" + str(int(entropy * 2)))
    if re.fullmatch(r"[0-9a-f]+", t) and n >= 16:
        f.append("hex=" + ("digest" if n in (32, 40, 56, 64, 96, 128) else "odd"))
    if _UUID.fullmatch(t):
        f.append("uuid")
    if re.fullmatch(r"[A-Za-z]+", t):
        f.append("word" if t.islower() or t.istitle() or t.isupper() else "camel")
    if re.fullmatch(r"[A-Za-z][a-z]*(?:[_-][a-z]+)+", t):
        f.append("dashed")
    if re.fullmatch(r"[A-Za-z][A-Za-z_-]*\d{1,4}", t):
        f.append("worddigits")
    if re.match(r"[a-z]{2,6}[_.-](?:[a-z]{2,6}[_.-])?[A-Za-z0-9]{16,}$", t) and re.search(r"\d", t) and re.search("[A-Z]", t):
        f.append("prefixed")
    if re.fullmatch(r"[A-Z]{2,6}[A-Z0-9]{12,}", t) and re.search(r"\d", t):
        f.append("upperid")
    if t.startswith("eyJ"):
        f.append("jwt")
    if re.match(r"sha(?:1|256|384|512)-", t):
        f.append("sri")
    if _STAND_IN.search(t):
        f.append("standin")
    if t.startswith(("$", "//")):
        f.append("lead=" + t[:2])
    if n >= 12 and re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", t) and (t.endswith("=") or runs * 4 > n):
        plain = _decoded(t)
        if plain:
            f.append("b64text" + ("pair" if ":" in plain else ""))
            if _STAND_IN.search(plain):
                f.append("standin")
    return tuple(f)


def _decoded(t: str) -> str | None:
    try:
        raw = base64.b64decode(t + "=" * (-len(t) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    return raw.decode("ascii") if len(raw) > 5 and all(32 <= c < 127 for c in raw) else None


@lru_cache(1 << 16)
def name_words(t: str) -> tuple[str, ...]:
    return tuple(x.lower() for x in _PART.findall(t))


@lru_cache(1 << 16)
def is_key_name(t: str) -> bool:
    """Does a name speak of a credential?"""
    ws = name_words(t)
    return any(w in _KEYS or w.endswith(_KEY_ENDS) for w in ws) and not any(w in _INERT for w in ws)


_COMMENT = re.compile(r"\s*(?://|#|\*|--)")


def features(tokens: list[str], line: str) -> list[list[str]]:
    """One list of features a token."""
    comment = bool(_COMMENT.match(line))
    return [token_features(tokens, k, comment) for k in range(len(tokens))]


def token_features(tokens: list[str], k: int, comment: bool) -> list[str]:
    t = tokens[k]
    f = list(shape_features(t))
    if len(t) == 1 and not t.isalnum():
        return f
    before = tokens[max(0, k - 3) : k]
    f.append("b1=" + (before[-1] if before and not before[-1][0].isalnum() else "w"))
    f.append("b2=" + "".join(x if not x[0].isalnum() else "w" for x in before[-2:]))
    nxt = tokens[k + 1] if k + 1 < len(tokens) else "$"
    f.append("n1=" + (nxt if not nxt[0].isalnum() else "w"))
    key = inert = False
    hop = 0
    for x in reversed(tokens[max(0, k - 8) : k]):
        if (x[0].isalpha() or x[0] == "_") and x not in _TYPES:
            hop += 1
            if is_key_name(x):
                key = key or hop
            if hop == 1 and any(w in _INERT for w in name_words(x)):
                inert = True
            if hop == 3:
                break
    f.append(f"key={key or 0}{'i' if inert else ''}")
    quoted = any(x in "\"'`" for x in before[-1:]) and nxt[0] in "\"'`;)"
    f.append("quoted" if quoted else "bare")
    if key and quoted:
        f.append("keyquoted")
    if nxt == "@" and before and before[-1] == ":":
        f.append("userinfo")
    if inert and "hex=digest" in f:
        f.append("digest")
    low = [x.lower() for x in tokens[max(0, k - 4) : k]]
    if "identified" in low:
        f.append("statement")
    if low[-1:] and low[-1] in ("bearer", "basic"):
        f.append("scheme")
    if low[-1:] == ["="] and len(low) > 1 and low[-2] in ("rev", "page", "id", "ref", "v", "commit"):
        f.append("param=inert")
    elif low[-1:] == ["="] and len(low) > 2 and low[-3] in ("?", "&"):
        f.append("param=" + ("key" if is_key_name(low[-2]) else "other"))
    if comment:
        f.append("comment" + ("key" if key else ""))
    return f


def _places(text: str, t: str) -> Iterator[int]:
    """Where ``t`` stands as a token of its own."""
    at, n = text.find(t), len(t)
    while at >= 0:
        if not (at and _INSIDE(text[at - 1])) and not _INSIDE(text[at + n : at + n + 1]):
            yield at
        at = text.find(t, at + n)


def addressed(text: str) -> Iterator[int]:
    """Places of an @ after a token, as the password of an address has it, and of parameters after ? or &."""
    at = text.find("@")
    while at >= 0:
        before = text[max(0, at - 20) : at].rstrip()
        if before and (before[-1].isalnum() or TOKEN_SIGNS.match(before[-1])):
            yield at
        at = text.find("@", at + 1)
    for m in _PARAM.finditer(text):
        yield m.start()


class Crf:
    """Weights of a two-label chain: label 1 is part of a secret."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]]):
        # Only the difference between the labels matters for a feature.
        self.weights, self.moves = weights, moves
        (m00, m01), (m10, m11) = moves
        #: What a marked token adds for going on, and what the tokens of a span must add together to pay for it.
        self.stay = m11 - m00
        self.least = self.stay - max(m01 + m10 - 2 * m00, m01 - m00)
        if self.least < 0:
            raise ValueError("these moves allow a span of tokens that all score below zero")
        if weights.get("len=1", 0.0) > -20 or max([0.0, *(x + self.stay for f, x in weights.items() if f.startswith("p="))]) > 0:
            raise ValueError("single characters must be ruled out")
        self.context = [max(self._sides(b, n, told) for b in self._ends("b", told) for n in self._ends("n", told)) + self._rest(comment, told) for told in (False, True) for comment in (False, True)]
        self.beside: dict[tuple[str, str, bool], float] = {}
        self.rest = [self._rest(bool(k & 1), bool(k & 2)) for k in range(4)]
        #: The most that features of a shape other than length and classes can add.
        groups: dict[str, float] = {}
        for f, x in weights.items():
            if not f.startswith(("len=", "cls=", "p=", "b1=", "b2=", "n1=", "key", "param", "quoted", "bare", "userinfo", "digest", "statement", "scheme", "comment")):
                groups[f.split("=")[0]] = max(groups.get(f.split("=")[0], 0.0), x)
        self.loose = sum(groups.values())
        self.reach: dict[str, int] = {}
        self.clean: set[str] = set()  # lines without a mark
        self.own: dict[str, float] = {}  # what a token adds by itself

    def _ends(self, side: str, told: bool) -> set[str]:
        """The characters that features of the sides can have next to a token; "" for the end of the line."""
        if side == "b":
            return {"", "w", *(f[-1] for f in self.weights if f.startswith(("b1=", "b2=")) and len(f) > 3)}
        return {"", "w", *(f[3] for f in self.weights if f.startswith("n1=") and len(f) > 3 and (told or f != "n1=@"))}

    def _sides(self, b: str, n: str, told: bool) -> float:
        """The most that the tokens beside a token can add when ``b`` and ``n`` are the characters next to it."""
        w = self.weights
        word = not b or b.isalnum() or TOKEN_SIGNS.match(b) is not None
        most = lambda start: max([0.0, *(x for f, x in w.items() if f.startswith(start) and (f[-1] == b and len(f) > 3 or word and f[-1] == "w"))])
        after = max([0.0, *(x for f, x in w.items() if f.startswith("n1=") and (f[3:4] == (n or "$") or n.isalnum() and f == "n1=w"))])
        quoted = w.get("quoted" if b and b in "\"'`" and n and n in "\"'`;)" else "bare", 0.0)
        return most("b1=") + most("b2=") + after + quoted

    def _rest(self, comment: bool, told: bool) -> float:
        """The most that other features can add, in comments or not, with or without what tells of a credential."""
        w = self.weights
        best = lambda *fs: sum(max(0.0, w.get(f, 0.0)) for f in fs)
        keys = [x for f, x in w.items() if f.startswith("key=") and (told or f[4] == "0")] or [0.0]
        more = best("keyquoted", "userinfo", "statement", "scheme") + max([0.0, *(x for f, x in w.items() if f.startswith("param="))]) if told else best("param=inert")
        return max(keys) + best("digest") + more + (best("comment", "commentkey") if comment else 0.0)

    def _dull(self, t: str) -> bool:
        """Do length and classes of characters alone rule a mark out, whatever else the shape and the sides tell?

        Words that ``features`` looks for are judged in full.
        """
        n = len(t)
        known = self.weights.get("len=" + str(min(n, 8) if n < 8 else 8 + min(n - 8, 56) // 8), 0.0)
        known += self.weights.get(f"cls={int(_LOW(t) is not None)}{int(_UP(t) is not None)}{int(_DIGIT(t) is not None)}{int(_OTHER(t) is not None)}", 0.0)
        return known + self.loose + self.stay + self.context[1] <= 0 and t.lower() not in ("identified", "bearer", "basic")

    def reaches(self, t: str) -> int:
        """In which lines the token can add to a span: bits 1 plain, 2 comment, 4 told, 8 told in a comment; + 16: it
        tells so itself, as a key name or as a word or sign that ``features`` looks for."""
        got = self.reach.get(t)
        if got is None:
            if len(self.reach) > 300_000:  # memory stays bounded
                self.reach.clear()
                self.own.clear()
            if len(t) > 1 and self._dull(t):
                # Whatever else its shape tells, only a line that tells of a credential could mark it.
                got = self.reach[t] = 12 + 16 * is_key_name(t)
                return got
            own = self.own[t] = self.score(shape_features(t)) + self.stay
            if len(t) > 1 or t.isalnum():
                got = sum(1 << k for k, c in enumerate(self.context) if own + c > 0)
                got += 16 * ((t[0].isalpha() or t[0] == "_") and is_key_name(t) or t.lower() in ("identified", "bearer", "basic"))
            else:
                got = 15 * (own > 0)
            self.reach[t] = got
        return got

    def lines(self, text: str) -> list[tuple[int, int]]:
        """Bounds of the lines some token of which can add to a span.

        Distinct tokens are judged once a text; where one that matters stands, what is beside it counts too.
        """
        hot, seen, own = {}, self.reach.get, self.own
        for t in set(_LONG.findall(text)):
            got = seen(t)
            if got is None:
                got = self.reaches(t)
            if got & 19:
                hot[t] = got, own.get(t, 0.0)  # kept here: later tokens may empty what is known
        told: dict[int, int] = {}
        out: dict[int, int] = {}
        beside, rest = self.beside, self.rest
        places = ((at, t) for t in hot for at in _places(text, t)) if len(hot) < 50 else ((m.start(), m[0]) for m in _LONG.finditer(text) if m[0] in hot)
        for at, t in places:
            lo = text.rfind("\n", 0, at) + 1
            if lo in out:
                continue
            (got, score), end = hot[t], at + len(t)
            hi = text.find("\n", end)
            hi = len(text) if hi < 0 else hi
            if got & 16:
                told[lo] = hi
            if got & 3:
                key = (text[lo:at].rstrip()[-1:], text[end : end + 20].lstrip(" \t\r")[:1].strip(), False)
                side = beside.get(key)
                if side is None:
                    side = beside[key] = self._sides(*key)
                if score + side + rest[0] > 0 or score + side + rest[1] > 0 and _COMMENT.match(text, lo, hi):
                    out[lo] = hi
        for at in addressed(text):
            lo = text.rfind("\n", 0, at) + 1
            if lo not in told:
                hi = text.find("\n", at)
                told[lo] = len(text) if hi < 0 else hi
        for lo, hi in told.items():
            if lo not in out and any(seen(t, 15) & (8 if _COMMENT.match(text, lo, hi) else 4) for t in _LONG.findall(text, lo, hi)):
                out[lo] = hi
        return sorted(out.items())

    def marks(self, tokens: list[str], line: str) -> list[int] | None:
        """The labels of a line's tokens, or None if none is marked.

        The gain of any span is at most the sum of what its tokens add, less what a span costs.
        """
        comment = bool(_COMMENT.match(line))
        seen, beside = self.reach.get, self.beside
        codes = [c if (c := seen(t)) is not None else self.reaches(t) for t in tokens]
        told = max(codes, default=0) > 15 or next(addressed(line), None) is not None
        bit, rest = (2 if comment else 1) << (2 if told else 0), self.rest[comment + 2 * told]
        total, last = 0.0, len(tokens) - 1
        for k, c in enumerate(codes):
            if c & bit:
                key = (tokens[k - 1][-1] if k else "", tokens[k + 1][0] if k < last else "", told)
                side = beside.get(key)
                if side is None:
                    side = beside[key] = self._sides(*key)
                if self.own.get(tokens[k], 1e9) + side + rest <= 0:
                    continue
                total += max(0.0, self.score(token_features(tokens, k, comment)) + self.stay)
                if total > self.least:
                    labels = self.viterbi(features(tokens, line))
                    return labels if 1 in labels else None
        return None

    @classmethod
    def load(cls) -> Crf:
        m = json.loads(files(__package__).joinpath(MODEL.name).read_text())  # also from a zipped package
        return cls(m["weights"], m["moves"])

    def score(self, f: Iterable[str]) -> float:
        get = self.weights.get
        return sum(get(x, 0.0) for x in f)

    def viterbi(self, feats: list[list[str]]) -> list[int]:
        a, back = (0.0, -1e9), []
        (m00, m01), (m10, m11) = self.moves
        for f in feats:
            s = self.score(f)
            from0 = (a[0] + m00, a[1] + m10)
            from1 = (a[0] + m01, a[1] + m11)
            back.append((int(from0[1] > from0[0]), int(from1[1] > from1[0])))
            a = (max(from0), max(from1) + s)
        path = [int(a[1] > a[0])]
        for b in reversed(back[1:]):
            path.append(b[path[-1]])
        return path[::-1]


_crf: list[Crf] = []


def spans(text: str) -> list[tuple[int, int]]:
    """Bounds of the characters that form secrets, in order; a split value gives a span a piece."""
    if not _crf:
        _crf.append(Crf.load())
    crf, out = _crf[0], []
    for m in _BEGIN.finditer(text):
        end = re.compile(rf"-----END {m[1]}-----").search(text, m.end())
        hi = end.end() if end else min([x for x in (text.find("\n\n", m.end()), len(text)) if x > 0])
        body = re.sub(r"-----(?:BEGIN|END)[^-]*-----", "", text[m.start() : hi])
        body = re.sub(r"\\[nr]|[\s\"'+,;`\\]", "", body)
        if len(re.sub(r"[^A-Za-z0-9/=]", "", body)) >= 40 and not re.search(r"\.\.\.|<|xxxx|\*\*\*", body):
            out.append((m.start(), hi))
    blocks = list(out)
    for lo, hi in crf.lines(text):
        if any(a <= lo < b for a, b in blocks):
            continue
        line = text[lo:hi]
        if line in crf.clean:  # lines that recur are labelled once
            continue
        got = [(m.start(), m[0]) for m in TOKEN.finditer(line)]
        labels = crf.marks([t for _, t in got], line)
        if not labels:
            if len(line) < 200:
                if len(crf.clean) > 200_000:  # memory stays bounded
                    crf.clean.clear()
                crf.clean.add(line)
            continue
        open_at = None
        for (at, t), y in zip(got, labels):
            if y and (len(t) > 1 or open_at is not None):
                if open_at is not None and not line[end_at:at].strip():
                    end_at = at + len(t)
                else:
                    if open_at is not None:
                        out.append((lo + open_at, lo + end_at))
                    open_at, end_at = at, at + len(t)
            elif open_at is not None:
                out.append((lo + open_at, lo + end_at))
                open_at = None
        if open_at is not None:
            out.append((lo + open_at, lo + end_at))
    return sorted(set(out))


_GLUE = re.compile(r"""\s*["'`]\s*(?:[+.&\\]|\|\|)?\s*\n?\s*[+.]?\s*[rbfu]?["'`]\s*$""")


def first_pieces(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without those that go on with the value of the span before."""
    out = []
    last = None
    for a, b in found:
        if last is None or not _GLUE.match(text[last:a]):
            out.append((a, b))
        last = b
    return out


def redact(text: str | None, mark: str = "REDACTED") -> str | None:
    """The text with every secret's characters replaced; quotes, line ends and all else stay."""
    if not text:
        return text
    out, at = [], 0
    for a, b in spans(text):
        if a < at:
            continue
        out += [text[at:a], mark + "\n" * text.count("\n", a, b)]
        at = b
    return "".join([*out, text[at:]])


def find_secrets(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, column_no, length) of every secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    for a, e in first_pieces(text, spans(text)):
                        out.append((doc, 1 + text.count("\n", 0, a), a - text.rfind("\n", 0, a), e - a))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "line_no", "column_no", "length"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, line_no bigint, column_no bigint, length bigint")


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text) of all documents, secrets replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redact(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string")

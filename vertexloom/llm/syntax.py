"""Source files that do not parse (error-correcting chart parsing, bottom up).

A file is parsed by the language its path claims. Tokens become terminals; bracket groups, for Python
and YAML also indented blocks, are completed innermost first. Every distinct constituent is derived
once and looked up afterwards. Its cost is the least number of terminals to insert, delete or replace
before one of its right sides derives it (``repair.Automaton``, exact at any size and cost); brackets
without a partner cost one edit each. The cost of a file is the sum over its constituents, so it is
least among the repairs that keep its bracket structure. A file of cost 0 is valid. Where the edits
lie tells truncation, merge conflict, mismatch (another language or prose) and other faults apart.

The grammars of the languages accept a superset. For Python the interpreter's own parser then checks
each file, and has the last word. A YAML terminal is a line.

Defined results: NULL text counts as empty; an empty code or YAML file is valid, an empty JSON file is
not; other endings are never flagged; repeated rows are judged alike.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.grammars import GRAMMARS
from vertexloom.llm.layout import PythonParser, YamlParser
from vertexloom.llm.repair import Chart, balanced

#: Equal neighbours in a list of literals are one: they derive alike.
_LISTED = re.compile(r"((?<![^,])m?[ns],)(?:m?[ns],)+")
_ASI = re.compile(r"([insPLBOMpRZ)\]}])\n+(?=[insKReETGDFCJYuZkad({\[]|$)")
_INNER = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")


_RETURN = re.compile("(?:Ku?P|[eE]|ic)*R")


class Parser(Chart):
    """A language whose blocks are bracket groups."""

    def __init__(self, lang: str):
        self.lang, self.g = lang, GRAMMARS[lang]
        super().__init__({side: getattr(self.g, side) for side in ("stmt", "last", "fields", "paren", "square")})
        self.letter: dict[str, str] = dict(self.g.words)
        self.done: dict[tuple[str, bool], int] = {}

    def terminals(self, text: str, lines: bool = False) -> str:
        g, letter = self.g, self.letter
        out = []
        for t in g.scan(text):
            if lines and t.isspace() and "\n" in t:
                out.append("\n")
                continue
            c = letter.get(t)
            if c is None:
                c = self.classify(t)
                if len(t) < 40 and len(letter) < self.limit:
                    letter[t] = c
            out.append(c)
        return "".join(out)

    def classify(self, t: str) -> str:
        a = t[0]
        if t.isspace():
            return "\n" if self.g.newline and "\n" in t else ""
        if t.startswith(("//", "/*")) or (a == "#" and self.lang == "cs"):
            return "\n" if self.g.newline and "\n" in t else ""
        if a in "\"`" or t[-1] in "\"`" and len(t) > 1:
            return "s"
        if self.lang == "json":
            return "n" if a in "-0123456789" else "!"
        if a == "'":
            return "s" if t[-1] == "'" and len(t) > 2 else ("l" if self.lang == "rs" and len(t) > 1 else "\x01")
        if a.isdigit() or a == "." and len(t) > 1:
            return "n"
        if a.isalpha() or a == "_" or a in "$#@" and len(t) > 1:
            return "i"
        if "/" in t and self.lang in ("js", "ts") and len(t.strip()) > 2:
            return "s"
        return "\x01"

    def group(self, whole: str) -> tuple[str, int]:
        g, inner = self.g, whole[1:-1]
        inner = _LISTED.sub(r"\1", inner)
        for rx, by in g.late:
            inner = rx.sub(by, inner)
        if whole[0] == "{":
            stmts = self.statements(inner)
            fields = 0 if g.fields_re.fullmatch(inner) else self.cost("fields", inner) if stmts else 1
            if not stmts or not fields:
                return "M" if not stmts and not fields else "O" if stmts else "B", 0
            return "M", min(stmts, fields)
        side, letter = ("paren", "P") if whole[0] == "(" else ("square", "L")
        if g.newline and ";" in inner and self.cost(side, inner):
            inner = inner.replace(";", "")
        lost = inner.count("c") - inner.count("q") if g.ternary and letter == "P" else 0
        return letter, self.cost(side, inner) or max(0, lost)

    def statements(self, inner: str) -> int:
        parts = self.g.split(inner)[:-1]
        return sum(self.statement(x, k == len(parts) - 1) for k, x in enumerate(parts))

    def statement(self, s: str, last: bool) -> int:
        key = (s, last)
        got = self.done.get(key)
        if got is None:
            g = self.g
            if not s or g.stmt_re.fullmatch(s) or last and g.last_re.fullmatch(s):
                got = max(0, s.count("c") - s.count("q") - len(re.findall("^(?:k|dc|ic)", s))) if g.ternary else 0
            else:
                got = max(1, min(self.edits("stmt", s), self.edits("last", s) if last else len(s)))
            if len(self.done) > self.limit:
                self.done.clear()
            self.done[key] = got
        return got

    def repair(self, text: str) -> tuple[int, int]:
        """(least cost, edits of it at the very end)."""
        got = self.derive(text, False)
        if got[0] and self.lang in ("js", "ts"):
            got = min(got, self.derive(text, True))  # once more, with semicolons inserted at line ends
        return got

    def derive(self, text: str, asi: bool) -> tuple[int, int]:
        g = self.g
        s = self.terminals(text, asi)
        odd = s.count("\x01")
        if odd:
            s = s.replace("\x01", "")
        if asi:
            s = _ASI.sub(r"\1;", s).replace("\n", "")
        elif g.newline:
            s = re.sub(rf"(?<=[{re.escape(g.newline)}])\n+", ";", s + "\n").replace("\n", "")
        for rx, by in g.folds:
            s = rx.sub(by, s)
        s, edits, at_end = balanced(s)
        s, cost = self.reduced(s, _INNER)
        for rx, by in g.late:
            s = rx.sub(by, s)
        if self.lang == "json":
            return odd + edits + cost + (not re.fullmatch("[insLOM]", s)) * max(1, len(s) - 1), at_end
        # A module's own statements return from nothing.
        returns = sum(bool(_RETURN.match(x)) for x in g.split(s)) if self.lang in ("js", "ts") else 0
        return odd + edits + cost + returns + self.statements(s), at_end


_MARKER = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?: .*)?\r?$")
_ENDING = re.compile(r"\.(py|js|ts|rs|go|cs|json|yaml)$")
_parsers: dict[str, Parser | PythonParser | YamlParser] = {}


def parser(lang: str, quick: bool = False) -> Parser | PythonParser | YamlParser:
    key = lang + " quick" * quick
    if key not in _parsers:
        _parsers[key] = PythonParser() if lang == "py" else YamlParser() if lang == "yaml" else Parser(lang)
        _parsers[key].quick = quick
    return _parsers[key]


def repair(lang: str, text: str) -> tuple[int, int]:
    """(least cost of a repair, edits of it at the very end); cost 0 for a valid file."""
    if not text.strip():
        return int(lang == "json"), 0
    got = parser(lang).repair(text.removeprefix("\ufeff") if lang != "json" else text)
    if lang == "py":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            return 0, 0
        except (SyntaxError, ValueError):
            return max(1, got[0]), got[1]
        except (MemoryError, RecursionError):
            pass  # too deep for the interpreter: the chart decides
    return got


def fault_kind(lang: str, text: str, cost: int, at_end: int) -> str:
    """conflict, mismatch (another language, mark-up or prose), truncation or other, by where the edits lie."""
    if _MARKER.search(text) and repair(lang, _MARKER.sub("", text))[0] < cost:
        return "conflict"  # edits on the marker lines
    if at_end and (cost - at_end) <= at_end + 1:
        return "truncation"
    if cost > 2 and cost * 8 > len(text.split()) or text.lstrip().startswith("<") and lang not in ("js", "ts"):
        return "mismatch"  # edits all over
    for other in ("json", "rs", "go", "cs", "ts", "py"):
        if other != lang and {other, lang} != {"js", "ts"} and text.strip() and not parser(other, True).repair(text)[0]:
            return "mismatch"
    return "truncation" if at_end else "other"


def _check(batches: Iterator[pa.RecordBatch], kinds: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in range(6)]
        for doc, source, path, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            m = _ENDING.search(path or "")
            if not m:
                continue
            cost, at_end = repair(m[1], text or "")
            kind = fault_kind(m[1], text or "", cost, at_end) if cost and kinds else None
            for c, x in zip(out, (doc, source, m[1], cost > 0, cost, kind)):
                c.append(x)
        types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string()]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], names=["doc_id", "source", "language", "invalid", "cost", "kind"])


def check_syntax(documents: DataFrame, kinds: bool = True) -> DataFrame:
    """(doc_id, source, language, invalid, cost, kind) of every file whose ending names a known language.

    ``cost`` is the least number of edits (0: valid); ``kind`` is left out without ``kinds``.
    """
    schema = "doc_id bigint, source string, language string, invalid boolean, cost int, kind string"
    return documents.select("doc_id", "source", "path", "text").mapInArrow(lambda it: _check(it, kinds), schema)


def fault_rates(documents: DataFrame) -> DataFrame:
    """(source, language, n_files, n_invalid, rate), reduced before the shuffle."""
    rates = check_syntax(documents, False).groupBy("source", "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.col("invalid").cast("bigint")).alias("n_invalid"))
    return rates.withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))

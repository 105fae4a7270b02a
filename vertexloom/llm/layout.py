"""Parsers of the languages whose blocks are told by indentation: Python and YAML.

Indented blocks are brackets like any other: they are completed first and stand as one letter in the
line or list they belong to.
"""

from __future__ import annotations

import re

from vertexloom.llm.grammars import _words
from vertexloom.llm.repair import Chart, balanced

_PY_TOKEN = re.compile(
    r"(?i:[rbuft]{0,2})(?:\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''(?:\\[\s\S]|[^\\])*?'''|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*')"
    r"|(?:[ \t\f]*(?:#[^\n]*)?\r?\n)+[ \t\f]*|\\\r?\n|[ \t\f\r]+|#[^\n]*"
    r"|(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.?\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)"
    r"|[^\W\d]\w*|\.\.\.|->|:=|\*\*=|//=|>>=|<<=|\*\*|//|>>|<<|==|!=|<=|>=|[-+*/%&|^@]=|[\s\S]"
)
_PY_WORDS = _words(
    I="if", E="elif", h="else", w="while", f="for", t="try", x="except", y="finally", W="with", D="def", C="class", a="async", A="as", b="in", j="is", u="not", U="await", o="and or / // % & | ^ << >> < > <= >= == !=",
    m="+ - ~", k="*", K="**", g="lambda", Y="yield", R="return", T="raise", S="assert", Z="pass break continue", d="del", G="global nonlocal", J="import", r="from", M="match case", n="True False None ...", z=":=", c=":",
) | {"=": "=", "->": ">", "@": "@", **{b: b for b in "()[]{},.;"}, **{x + "=": "=" for x in ("+", "-", "*", "/", "//", "%", "&", "|", "^", "@", "**", ">>", "<<")}}
_NM = "[iM]"
_PRIM = rf"(?:(?:[iMnPLO]|s+)(?:\.{_NM}|P|L)*)"
_UN = f"(?:[muU]*{_PRIM})"
_E0 = f"(?:{_UN}(?:(?:[omkK@bj]|ub){_UN})*)"
_LP = f"(?:[kK]?{_NM}(?:={_UN})?|o|k)"
_LAM = f"(?:g(?:{_LP}(?:,{_LP})*,?)?c)*"
_T = f"(?:{_LAM}{_E0})"
_E = f"(?:{_T}(?:I{_T}h{_T})*)"
_NAMED = f"(?:(?:{_NM}z)?{_E})"
_ST = f"(?:k{_E}|{_NAMED})"
_ES = f"(?:{_ST}(?:,{_ST})*,?)"
_YIELD = f"(?:Y(?:r{_E}|{_ES})?)"
_RHS = f"(?:{_YIELD}|{_ES})"
_TL = f"(?:k?{_PRIM}(?:,k?{_PRIM})*,?)"
_DOT = rf"(?:{_NM}(?:\.{_NM})*)"
_ITEM = f"(?:{_E}(?:A{_PRIM})?)"
_SIMPLE = (
    f"(?:{_ES}(?:={_RHS})*|{_YIELD}|{_PRIM}c{_E}(?:={_RHS})?|R{_ES}?|T(?:{_E}(?:r{_E})?)?|S{_E}(?:,{_E})?|Z|d{_ES}|G{_NM}(?:,{_NM})*|J{_DOT}(?:A{_NM})?(?:,{_DOT}(?:A{_NM})?)*"
    rf"|r[.n]*{_DOT}?J(?:k|P|{_NM}(?:A{_NM})?(?:,{_NM}(?:A{_NM})?)*)|i{_NM}L?={_E})"
)
_LINE = f"(?:{_SIMPLE}(?:;{_SIMPLE})*;?N)"
_HEADS = {
    "I": f"I{_NAMED}c", "E": f"E{_NAMED}c", "h": "hc", "w": f"w{_NAMED}c", "f": f"a?f{_TL}b{_ES}c", "t": "tc", "x": f"xk?(?:{_ES}(?:A{_NM})?)?c", "y": "yc",
    "D": f"(?:a?W{_ITEM}(?:,{_ITEM})*,?c|a?D{_NM}L?P(?:>{_E})?c|C{_NM}L?P?c|M{_ES}(?:A{_NM})?(?:I{_NAMED})?c)",
}
_SUITE = f"(?:NB|{_LINE})"
_LETTERS = {**{k: k for k in "IEhwftxy"}, "W": "D", "D": "D", "C": "D", "M": "D"}
_GEN = f"(?:a?f{_TL}b{_T}(?:I{_NAMED})*)"
_ARG = f"(?:[kK]{_E}|{_NM}={_E}|{_NAMED})"
_PAR = f"(?:[kK]?{_NM}(?:ck?{_E})?(?:={_E})?|o|k)"
_SLICE = f"(?:{_ST}|{_E}?c{_E}?(?:c{_E}?)?)"
PYTHON = {
    "line": f"(?:{_LINE}|@{_NAMED}N|(?:{'|'.join(_HEADS.values())}){_SUITE})",
    "(": f"(?:{_ARG}{_GEN}+|{_ARG}(?:,{_ARG})*,?|{_YIELD}|{_PAR}(?:,{_PAR})*,?|{_NM}(?:A{_NM})?(?:,{_NM}(?:A{_NM})?)*,?|{_ITEM}(?:,{_ITEM})*,?)?",
    "[": f"(?:{_NAMED}{_GEN}+|{_SLICE}(?:,{_SLICE})*,?)?",
    "{": f"(?:{_E}c{_E}{_GEN}+|(?:K{_E}|{_E}c{_E})(?:,(?:K{_E}|{_E}c{_E}))*,?|{_NAMED}{_GEN}+|{_ES})?",
    "block": "(?:L|@+D|D|IE*h?|[wf]h?|t(?:x+h?y?|y))*",
}
#: A group of lines of one indentation: mapping entries, list items or the lines of one scalar.
YAML = {"block": "(?:(?:kV?|K(?:[GV]|(?:dV?|D[GV]?)+)?)+|(?:dV?|D[GV]?)+|v+V?|)"}
_INNER = re.compile(r"\([^()\[\]{}⟨⟩]*\)|\[[^()\[\]{}⟨⟩]*\]|\{[^()\[\]{}⟨⟩]*\}|⟨[^()\[\]{}⟨⟩]*⟩")
_LOGICAL = re.compile(r"[^N]*NB?|[^N]+$")
#: Words that only begin statements: inside open brackets they show that a closing one is missing.
_STARTS = frozenset("def class return import raise while try with assert pass break continue global del".split())


class PythonParser(Chart):
    def __init__(self) -> None:
        super().__init__(PYTHON)

    def terminals(self, text: str, strict: bool) -> tuple[str, int]:
        """(letters, tokens of no language); ``strict`` ends open brackets where a statement begins."""
        out, depth, stack, odd = [], 0, [0], 0
        tokens = _PY_TOKEN.findall(text + "\n")
        for k, t in enumerate(tokens):
            a = t[0]
            if t[-1] not in "\"'" and ("\n" in t or a in " \t\f\r#\\"):
                if "\n" not in t or a == "\\":
                    continue
                if depth and not (strict and k + 1 < len(tokens) and tokens[k + 1] in _STARTS):
                    continue
                depth = 0
                if k + 1 < len(tokens):
                    width = len(t[t.rfind("\n") + 1 :].expandtabs(8))
                else:
                    width = 0
                if out and out[-1] not in "N⟩" or not out:
                    if out:
                        out.append("N")
                if width > stack[-1]:
                    stack.append(width)
                    out.append("⟨")
                while width < stack[-1]:
                    stack.pop()
                    out.append("⟩")
                if width != stack[-1]:
                    stack.append(width)
                    out.append("⟨")
                    odd += 1
                continue
            c = _PY_WORDS.get(t)
            if c is None:
                c = "s" if t[-1] in "\"'" and len(t) > 1 else "n" if a.isdigit() or a == "." else "i" if a.isalpha() or a == "_" else ""
                if not c:
                    odd += 1
                    continue
            depth += c in "([{"
            depth -= c in ")]}" and depth > 0
            out.append(c)
        if out and out[-1] not in "N⟩":
            out.append("N")
        return "".join(out) + "⟩" * (len(stack) - 1), odd

    def block(self, s: str) -> int:
        total, letters = 0, []
        for line in _LOGICAL.findall(s):
            first = line[1:2] if line[0] == "a" else line[0]
            letter = "@" if line[0] == "@" else _LETTERS.get(first, "L")
            if line.startswith("B"):  # an indented block under nothing
                letters.append("!")
                continue
            cost = self.cost("line", line)
            if cost and letter not in "L@" and line[-2:] == "cN" and not self.cost("line", line + "B"):
                letters.append("!")  # a head without a block
                continue
            total += cost
            letters.append(letter)
        return total + self.cost("block", "".join(letters))

    def group(self, whole: str) -> tuple[str, int]:
        letter = {"(": "P", "[": "L", "{": "O", "⟨": "B"}[whole[0]]
        return letter, self.block(whole[1:-1]) if letter == "B" else self.cost(whole[0], whole[1:-1].replace("N", ""))

    def repair(self, text: str) -> tuple[int, int]:
        """(cost, edits at the very end): brackets that go on over line ends, or end where a statement begins."""
        got = self._repair(text, False)
        return min(got, self._repair(text, True)) if got[0] else got

    def _repair(self, text: str, strict: bool) -> tuple[int, int]:
        s, odd = self.terminals(text.replace("\r\n", "\n"), strict)
        s, edits, at_end = balanced(s, "N")
        s, cost = self.reduced(s, _INNER)
        return odd + edits + cost + self.block(s), at_end


_YAML_LINE = re.compile(r"""( *)((?:- +)*)(?:((?:"(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#"'\[\]{}>|*&!%@`,-][^#]*?|-[^\s#][^#]*?))\s*:(?= |$) *)?(.*)""")
_YAML_VALUE = re.compile(r"""(?:[&!][^\s]*\s+)*(?:"(?:\\.|[^"\\])*"|'(?:''|[^'])*'|\*[\w-]+|[\[{].*[\]}]|(?![\[\]{}>|*&!%@`"',#]|[?:-](?:\s|$))(?:[^\s#:]|:(?! |$)|(?<=\S)#|\s(?!#))*)?\s*(?:(?:^|(?<=\s))#.*)?""")


class YamlParser(Chart):
    def __init__(self) -> None:
        super().__init__(YAML)

    def repair(self, text: str) -> tuple[int, int]:
        """(least number of lines to change, insert or delete, group by group; 0)."""
        total = 0
        groups: list[tuple[int, list[str]]] = []

        def close() -> None:
            nonlocal total
            letters = "".join(groups.pop()[1])
            total += self.cost("block", letters)
            if groups:
                groups[-1][1].append("V" if set(letters) <= {"v"} else "G")

        block: int | None = None
        for line in text.replace("\r\n", "\n").split("\n"):
            if not line.strip() or line.lstrip().startswith("#") and block is None:
                continue
            indent = len(line) - len(line.lstrip(" "))
            if block is not None:
                if indent > block:
                    continue
                block = None
            if line in ("---", "...") or line.startswith(("--- ", "%YAML")):
                while groups:
                    close()
                continue
            m = _YAML_LINE.fullmatch(line)
            bare = line.strip() == "-"
            dash, key, value = bool(m[2]) or bare, m[3], "" if bare or m[4] == "-" else m[4]
            starts_block = bool(re.fullmatch(r"(?:[&!]\S+ +)*[|>][-+0-9]*(?: +#.*)?", value))
            good = not line.lstrip(" ").startswith("\t") and (starts_block or bool(_YAML_VALUE.fullmatch(value)))
            while len(groups) > 1 and indent < groups[-1][0]:
                close()
            if not groups or indent > groups[-1][0]:
                groups.append((indent, []))
            filled = bool(re.sub(r"(?:^|\s)#.*|[&!]\S+", "", value).strip())
            entry = "!" if not good else ("k" if filled else "K") if key is not None else "v"
            if dash:
                groups[-1][1].append("D" if key is not None or not filled and good else "d" if good else "!")
                if key is not None:
                    groups.append((indent + len(m[2]), [entry]))
            else:
                groups[-1][1].append(entry)
            if starts_block:
                block = indent
        while groups:
            close()
        return total, 0

"""Least edit costs of terminals against right sides, and charts of completed constituents.

A right side is a regular expression over one-letter terminals. ``Automaton`` reads it, and
``Automaton.cost`` is the least number of terminals to insert, delete or replace so that a string
derives: layer k holds the states that k edits reach after each terminal, and layers are added until
one accepts, so that the cost is exact whatever its size.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\\.|\[\^?(?:\\.|[^\]\\])*\]|\(\?(?::|=|!|<=|<!|>)|\(|\)|\||[*+?][+?]?|\{\d+(?:,\d*)?\}|.", re.S)
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")
_NOTHING = ("seq",)


def _tree(pattern: str) -> tuple:
    """The pattern as nested tuples. Looks around only choose between derivations, so an edit cost ignores them."""
    tokens, at = _TOKEN.findall(pattern), 0

    def choice() -> tuple:
        nonlocal at
        ways = [sequence()]
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            ways.append(sequence())
        return ways[0] if len(ways) == 1 else ("alt", *dict.fromkeys(ways))

    def sequence() -> tuple:
        nonlocal at
        items = []
        while at < len(tokens) and tokens[at] not in ("|", ")"):
            x = item()
            t = tokens[at] if at < len(tokens) else ""
            if t and (t[0] in "*+?" or len(t) > 2 and t[0] == "{" and t[1].isdigit()):
                at += 1
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(t[0], (0, 0))
                if t[0] == "{":
                    m = re.fullmatch(r"\{(\d+)(,?)(\d*)\}", t)
                    low, high = int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1])
                items += [x] * low + ([("star", x)] if high is None else [("alt", x, _NOTHING)] * (high - low))
            else:
                items.append(x)
        return items[0] if len(items) == 1 else ("seq", *items)

    def item() -> tuple:
        nonlocal at
        t = tokens[at]
        at += 1
        if t in ("(", "(?:", "(?>") or t.startswith("(?"):
            inner = choice()
            at += 1  # the closing sign
            return inner if t in ("(", "(?:", "(?>") else _NOTHING
        if t in ("^", "$"):
            return _NOTHING
        if t[0] == "[" and len(t) > 1:
            negated = t[1] == "^"
            body = re.findall(r"\\.|.", t[1 + negated : -1], re.S)
            chars = frozenset(x[-1] for x in body if x != r"\w") | (_WORD if r"\w" in body else frozenset())
            return ("char", chars, negated)
        return ("char", frozenset(), True) if t == "." else ("char", frozenset(t[-1]), False)

    out = choice()
    if at != len(tokens):
        raise ValueError(f"can't read {pattern[:60]!r}")
    return out


class Automaton:
    """Positions that read a terminal, and the positions that may follow; sets of them are bit masks.

    Equal parts with an equal continuation are one part, so a right side that is used in many places
    is kept once a place where it ends.
    """

    def __init__(self, pattern: str):
        self._free: list[list[int]] = [[]]  # state 0 accepts
        self._read: list[tuple | None] = [None]
        self._made: dict[tuple, int] = {}
        start = self._build(_tree(pattern), 0)
        states = [q for q, r in enumerate(self._read) if r]
        number = {q: k + 1 for k, q in enumerate(states)}
        self.end = 1
        closed: dict[int, int] = {}

        def closure(q: int) -> int:
            got = closed.get(q)
            if got is None:
                seen, todo, got = {q}, [q], 0
                while todo:
                    x = todo.pop()
                    if x == 0 or self._read[x]:
                        got |= 1 << number.get(x, 0)
                    for to in self._free[x]:
                        if to not in seen:
                            seen.add(to)
                            todo.append(to)
                closed[q] = got
            return got

        self.start = closure(start)
        self.classes = [None] + [self._read[q][:2] for q in states]
        self.follow = [0] + [closure(self._read[q][2]) for q in states]
        self._reads: dict[str, int] = {}
        self._steps: dict[tuple[int, int], int] = {}
        del self._free, self._read, self._made

    def _new(self, read: tuple | None = None) -> int:
        self._free.append([])
        self._read.append(read)
        return len(self._free) - 1

    def _build(self, node: tuple, to: int) -> int:
        kind = node[0]
        if kind == "seq":
            for x in reversed(node[1:]):
                to = self._build(x, to)
            return to
        got = self._made.get((node, to))
        if got is None:
            if kind == "char":
                got = self._new((node[1], node[2], to))
            elif kind == "alt":
                ways = [self._build(x, to) for x in node[1:]]
                got = self._new()
                self._free[got] = ways
            else:
                got = self._made[node, to] = self._new()
                self._free[got] = [to, self._build(node[1], got)]
            self._made[node, to] = got
        return got

    def _next(self, mask: int) -> int:
        """What may follow any position of the mask."""
        got = 0
        follow = self.follow
        while mask:
            low = mask & -mask
            got |= follow[low.bit_length() - 1]
            mask ^= low
        return got

    def step(self, mask: int, c: str) -> int:
        reads = self._reads.get(c)
        if reads is None:
            reads = self._reads[c] = sum(1 << q for q, x in enumerate(self.classes) if x and (c in x[0]) != x[1])
        return self.onward(mask & reads)

    def onward(self, mask: int) -> int:
        got = self._steps.get(mask)
        if got is None:
            if len(self._steps) > 100_000:  # memory stays bounded
                self._steps.clear()
            got = self._steps[mask] = self._next(mask)
        return got

    def cost(self, s: str) -> int:
        """The least number of insertions, deletions and replacements after which ``s`` derives."""
        step, onward = self.step, self.onward
        layer, mask = [self.start], self.start
        for c in s:
            mask = step(mask, c)
            layer.append(mask)
        k = 0
        while not layer[-1] & self.end:
            k += 1
            mask = layer[0] | onward(layer[0])
            nxt = [mask]
            for i, c in enumerate(s):
                mask = step(mask, c) | layer[i] | onward(layer[i] | layer[i + 1])
                nxt.append(mask)
            if nxt == layer:
                raise ValueError("the right side derives nothing")
            layer = nxt
        return k


_PAIRS = dict(zip(")]}⟩", "([{⟨"))
_CLOSING = dict(zip("([{⟨", ")]}⟩"))


def balanced(s: str, line_end: str = "") -> tuple[str, int, int]:
    """(terminals whose brackets are balanced, edits made, those of them at the very end).

    A bracket that nothing closes is closed where an outer one closes, where ``line_end`` stands or at
    the end; a closing one that closes nothing is deleted.
    """
    out: list[str] = []
    open_: list[str] = []
    edits = 0
    for c in s:
        if c in _CLOSING:
            open_.append(c)
        elif c in _PAIRS:
            if _PAIRS[c] not in open_:
                edits += 1
                continue
            while open_[-1] != _PAIRS[c]:
                out.append(_CLOSING[open_.pop()])
                edits += 1
            open_.pop()
        elif c == line_end:
            while open_ and open_[-1] != "⟨":
                out.append(_CLOSING[open_.pop()])
                edits += 1
        out.append(c)
    left = [b for b in open_ if b != "⟨"] if line_end else open_
    return "".join(out) + "".join(_CLOSING[b] for b in reversed(open_)), edits + len(left), len(left)


class Chart:
    """Constituents derived so far, and the least cost of each right side's repairs."""

    #: So many constituents are kept before the chart is started anew: memory stays bounded.
    limit = 200_000
    #: Tell costs only from 0: any fault counts 1.
    quick = False

    def __init__(self, sides: dict[str, str]):
        self.sides = sides
        self.regex = {k: re.compile(v) for k, v in sides.items()}
        self.automata: dict[str, Automaton] = {}
        self.costs: dict[tuple[str, str], int] = {}
        self.groups: dict[str, tuple[str, int]] = {}

    def edits(self, side: str, s: str) -> int:
        """The least cost by the automaton alone."""
        if self.quick:
            return 1
        if side not in self.automata:
            self.automata[side] = Automaton(self.sides[side])
        return self.automata[side].cost(s)

    def cost(self, side: str, s: str) -> int:
        got = self.costs.get((side, s))
        if got is None:
            if len(self.costs) > self.limit:
                self.costs.clear()
            got = self.costs[side, s] = 0 if self.regex[side].fullmatch(s) else max(1, self.edits(side, s))
        return got

    def group(self, whole: str) -> tuple[str, int]:
        """(letter, cost) of a bracket group without groups inside."""
        raise NotImplementedError

    def reduced(self, s: str, inner: re.Pattern) -> tuple[str, int]:
        """The terminals with every group as one letter, and the cost of the groups."""
        if len(self.groups) > self.limit:
            self.groups.clear()
        total = 0

        def one(m: re.Match) -> str:
            nonlocal total
            got = self.groups.get(m[0])
            if got is None:
                got = self.groups[m[0]] = self.group(m[0])
            total += got[1]
            return got[0]

        n = 1
        while n:
            s, n = inner.subn(one, s)
        return s, total

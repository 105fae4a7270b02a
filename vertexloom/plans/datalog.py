"""A small Datalog compiled to DataFrame plans.

Text -> tokens -> checked program -> strata -> one DataFrame a predicate. Facts and rules may be given;
each goal ``?- atom, ... .`` has its own result unless ``joined`` is asked for. Conjunction is a natural
join on shared variables, ``not`` / ``!`` an anti-join after all positive atoms, recursion a semi-naive
loop over written tables. Only the rules a goal needs are evaluated. A goal that binds the first
argument of a closure (p(X,Y) :- e(X,Y). p(X,Z) :- p(X,Y), e(Y,Z).), or the second, walks from that
constant instead of computing all pairs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators.durable import Rounds
from vertexloom.operators.measure import BEHAVIOUR, degrees
from vertexloom.operators.traverse import closure, closure_from
from vertexloom.sources.graphs import Graph

MAX_QUERY_BYTES = 10_000


class DatalogError(ValueError):
    pass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple
    negated: bool = False

    @property
    def variables(self) -> list[str]:
        return [a.name for a in self.args if isinstance(a, Var)]


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]


@dataclass
class Program:
    facts: list[Atom] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    goals: list[Atom] = field(default_factory=list)


_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<punct>\?-|:-|[(),.!])|(?P<str>"[^"]*"|'[^']*')|(?P<int>-?\d+)|(?P<word>[A-Za-z][A-Za-z0-9_]*)|(?P<any>_)""")


def tokenize(text: str) -> list[tuple[str, str]]:
    if len(text.encode()) > MAX_QUERY_BYTES:
        raise DatalogError(f"query longer than {MAX_QUERY_BYTES} bytes")
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DatalogError(f"unexpected character {text[at]!r} at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.fresh = tokenize(text), 0, 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or want and self.peek() != want:
            raise DatalogError(f"expected {want or 'more'}, found {self.peek() or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def atom(self) -> Atom:
        negated = False
        if self.peek() in ("!", "not"):
            self.take()
            negated = True
        kind, name = self.take()
        if kind != "word":
            raise DatalogError(f"expected a predicate, found {name}")
        self.take("(")
        args = []
        while True:
            kind, t = self.take()
            if kind == "str":
                args.append(t[1:-1])
            elif kind == "int":
                args.append(int(t))
            elif kind == "any":
                self.fresh += 1
                args.append(Var(f"_{self.fresh}"))
            elif kind == "word":
                args.append(Var(t) if t[0].isupper() else t)
            else:
                raise DatalogError(f"expected an argument, found {t}")
            if self.take()[1] == ")":
                break
            if self.tokens[self.at - 1][1] != ",":
                raise DatalogError("expected , or )")
        return Atom(name, tuple(args), negated)

    def program(self) -> Program:
        p = Program()
        while self.at < len(self.tokens):
            if self.peek() == "?-":
                self.take()
                p.goals = self.body()
                continue
            head = self.atom()
            if head.negated:
                raise DatalogError("a fact or head cannot be negated")
            if self.peek() == ":-":
                self.take()
                rule = Rule(head, tuple(self.body()))
                bound = {v for a in rule.body if not a.negated for v in a.variables}
                if missing := [v for v in head.variables if v not in bound]:
                    raise DatalogError(f"unsafe rule for {head.name}: {missing} not bound")
                p.rules.append(rule)
            else:
                self.take(".")
                if head.variables:
                    raise DatalogError("a fact holds constants only")
                p.facts.append(head)
        return p

    def body(self) -> list[Atom]:
        out = [self.atom()]
        while self.peek() == ",":
            self.take()
            out.append(self.atom())
        self.take(".")
        return out


def parse(text: str) -> Program:
    return _Parser(text).program()


LIBRARY = """
calls_transitive(X,Y) :- calls(X,Y,_).
calls_transitive(X,Z) :- calls_transitive(X,Y), calls(Y,Z,_).
imports_transitive(X,Y) :- imports(X,Y,_).
imports_transitive(X,Z) :- imports_transitive(X,Y), imports(Y,Z,_).
depends_on(X,Y) :- calls(X,Y,_).
depends_on(X,Y) :- imports(X,Y,_).
depends_on(X,Y) :- inherits(X,Y,_).
depends_on(X,Y) :- implements(X,Y,_).
depends_on(X,Y) :- contains(X,Y,_).
depends_transitive(X,Y) :- depends_on(X,Y).
depends_transitive(X,Z) :- depends_transitive(X,Y), depends_on(Y,Z).
same_community(X,Y) :- node(X,_,_,_,C), node(Y,_,_,_,C).
is_hub(X) :- hub(X).
busy(X) :- calls(X,_,_).
busy(X) :- calls(_,X,_).
busy(X) :- imports(X,_,_).
busy(X) :- imports(_,X,_).
is_orphan(X) :- node(X,_,_,_,_), not busy(X).
identical(X,X) :- node(X,_,_,_,_).
circular_dependency(X,Y) :- calls_transitive(X,Y), calls_transitive(Y,X), not identical(X,Y).
bypasses_layer(X,Y,Z) :- depends_transitive(X,Z), node(Y,_,_,_,_), not depends_transitive(X,Y).
"""


def base_relations(graph: Graph) -> dict[str, DataFrame]:
    """The stored predicates, positional columns _0, _1, ...; communities default to 999, hubs have degree above 15."""
    cap = lambda c: F.initcap(F.lower(c))
    e = graph.edges.select("source", "target", "relation", cap("confidence").alias("confidence"))
    out = {"node": graph.nodes.select("id", "label", cap("file_type").alias("t"), "source_file", F.coalesce("community", F.lit(999)).alias("c")), "edge": e}
    out |= {r: e.filter(F.col("relation") == r).select("source", "target", "confidence") for r in BEHAVIOUR}
    d = degrees(graph)
    out |= {"degree": d, "hub": d.filter("degree > 15").select("id")}
    return {k: v.toDF(*(f"_{i}" for i in range(len(v.columns)))).distinct() for k, v in out.items()}


class Engine:
    """Evaluates programs over base relations."""

    def __init__(self, spark: SparkSession, base: dict[str, DataFrame], budget: int | None = 1000):
        self.spark, self.base, self.budget = spark, base, budget
        self.known: dict[str, DataFrame] = {}

    def run(self, text: str, joined: bool = False) -> list[DataFrame]:
        """One DataFrame a goal, columns named by its variables; a ground goal gives one row ``holds``."""
        own = parse(text)
        if not own.goals:
            raise DatalogError("no goal")
        if clash := {r.head.name for r in own.rules} & set(self.base):
            raise DatalogError(f"rules for stored predicates: {sorted(clash)}")
        self.rules = parse(LIBRARY).rules + own.rules
        self.facts: dict[str, list[tuple]] = {}
        for f in own.facts:
            self.facts.setdefault(f.name, []).append(f.args)
        self.known = {}
        self._stratify()
        if joined:
            body = Rule(Atom("goal", tuple(Var(v) for v in dict.fromkeys(v for g in own.goals for v in g.variables if v[0] != "_"))), tuple(own.goals))
            return [self._body(body).toDF(*body.head.variables)]
        return [self._goal(g) for g in own.goals]

    def _stratify(self) -> None:
        """Components of mutually recursive predicates; a negative edge inside one is an error."""
        heads = {r.head.name for r in self.rules}
        uses = {h: {(a.name, a.negated) for r in self.rules if r.head.name == h for a in r.body} for h in heads}
        reach = {h: {n for n, _ in uses[h]} for h in heads}
        changed = True
        while changed:
            changed = False
            for h in heads:
                more = set().union(*(reach[n] for n in reach[h] if n in heads)) - reach[h] if reach[h] else set()
                if more:
                    reach[h] |= more
                    changed = True
        self.component = {h: frozenset({h} | {n for n in heads if n in reach[h] and h in reach[n]}) for h in heads}
        for h in heads:
            for n, negated in uses[h]:
                if negated and n in self.component[h] and n in reach and h in reach[n]:
                    raise DatalogError(f"{h} depends on its own negation through {n}")

    def _empty(self, arity: int) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"_{i} string" for i in range(arity)))

    def relation(self, name: str, arity: int) -> DataFrame:
        if name in self.known:
            return self.known[name]
        out = self.base.get(name)
        if out is None and name in self.component:
            self._solve(self.component[name])
            return self.known[name]
        rows = self.facts.get(name)
        if rows:
            facts = self._rows(rows)
            out = facts if out is None else out.unionByName(facts).distinct()
        if out is None:
            out = self._empty(arity)
        if len(out.columns) != arity:
            raise DatalogError(f"{name} has {len(out.columns)} arguments, not {arity}")
        self.known[name] = out
        return out

    def _rows(self, rows: list[tuple]) -> DataFrame:
        kinds = []
        for column in zip(*rows):
            types = {type(x) for x in column}
            if len(types) > 1:
                raise DatalogError("a column mixes text and numbers")
            kinds.append("bigint" if types == {int} else "string")
        return self.spark.createDataFrame(rows, ", ".join(f"_{i} {k}" for i, k in enumerate(kinds)))

    def _closed(self, name: str) -> tuple[str, int] | None:
        """(edge predicate, arity) when ``name`` is exactly the closure of its first two columns."""
        rules = [r for r in self.rules if r.head.name == name]
        if len(rules) != 2 or name in self.facts:
            return None
        first, second = sorted(rules, key=lambda r: len(r.body))
        if len(first.body) != 1 or len(second.body) != 2 or len(first.head.args) != 2 or any(a.negated for r in rules for a in r.body):
            return None
        e, (p, e2) = first.body[0], second.body
        turned = p.name != name  # the recursive goal stands last: the same closure
        if turned:
            p, e2 = e2, p
        plain = lambda a: all(isinstance(x, Var) for x in a.args)
        if not (plain(e) and plain(e2) and plain(p) and p.name == name and e2.name == e.name and e.args[:2] == first.head.args):
            return None
        x, z = second.head.args
        front, back = (e2, p) if turned else (p, e2)
        if front.args[0] == x and front.args[1] == back.args[0] and back.args[1] == z and len({x, z, front.args[1]}) == 3:
            return e.name, len(e.args)
        return None

    def _pairs(self, edge: tuple[str, int]) -> DataFrame:
        return self.relation(*edge).select(F.col("_0").alias("s"), F.col("_1").alias("t")).distinct()

    def _bound_closure(self, atom: Atom) -> DataFrame | None:
        """The rows of a closure that an atom with a constant selects, by walking from the constant."""
        edge = self._closed(atom.name) if atom.name not in self.known and len(atom.args) == 2 else None
        if not edge:
            return None
        pairs = self._pairs(edge)
        for at, turn in ((0, False), (1, True)):
            if not isinstance(atom.args[at], Var):
                way = pairs.select(F.col("t").alias("s"), F.col("s").alias("t")) if turn else pairs
                seeds = self.spark.createDataFrame([(atom.args[at],)], "s string")
                got = closure_from(way, seeds, self.budget)
                return got.select(F.col("t").alias("_0"), F.col("s").alias("_1")) if turn else got.toDF("_0", "_1")
        return None

    def _solve(self, names: frozenset[str]) -> None:
        for n in names:
            if len(names) == 1 and (edge := self._closed(n)):
                self.known[n] = closure(self._pairs(edge), self.budget).toDF("_0", "_1")
                return
        rules = [r for r in self.rules if r.head.name in names]
        recursive = [r for r in rules if any(a.name in names for a in r.body)]
        arity = {r.head.name: len(r.head.args) for r in rules}
        total: dict[str, DataFrame] = {}
        tables: dict[str, Rounds] = {}
        left = False
        for n in names:
            cols = [f"_{i}" for i in range(arity[n])]
            parts = [self._body(r) for r in rules if r.head.name == n and r not in recursive]
            if n in self.facts:
                parts.append(self._rows(self.facts[n]))
            total[n] = reduce(DataFrame.unionByName, parts).distinct() if parts else self._empty(arity[n])
            if recursive:
                tables[n] = Rounds(self.spark)
                left |= tables[n].add(total[n], n=F.count(F.lit(1)))["n"] > 0
                total[n] = tables[n].all().select(*cols)
        rounds = 0
        while left:
            rounds += 1
            if self.budget is not None and rounds > self.budget:
                raise DatalogError("maximum step limit reached")
            delta, left, new = {n: t.last() for n, t in tables.items()}, False, {}
            for n in names:
                parts = [self._body(r, {k: delta[a.name]}, total) for r in recursive if r.head.name == n for k, a in enumerate(r.body) if a.name in names]
                fresh = reduce(DataFrame.unionByName, parts).distinct() if parts else self._empty(arity[n])
                new[n] = fresh.join(total[n], total[n].columns, "left_anti")
            for n in names:  # each a part beside the others: nothing found before is written again
                left |= tables[n].add(new[n], n=F.count(F.lit(1)))["n"] > 0
            total = {n: t.all().select(*total[n].columns) for n, t in tables.items()}
        self.known |= total

    def _atom(self, atom: Atom, rows: DataFrame) -> DataFrame:
        """Selection by constants and repeated variables, then one column a named variable."""
        if len(rows.columns) != len(atom.args):
            raise DatalogError(f"{atom.name} has {len(rows.columns)} arguments, not {len(atom.args)}")
        first: dict[str, str] = {}
        for i, a in enumerate(atom.args):
            if not isinstance(a, Var):
                rows = rows.filter(F.col(f"_{i}") == F.lit(a)) if (rows.schema[i].dataType.simpleString() == "string") == isinstance(a, str) else rows.filter(F.lit(False))
            elif a.name in first:
                rows = rows.filter(F.col(f"_{i}") == F.col(first[a.name]))
            else:
                first[a.name] = f"_{i}"
        return rows.select(*(F.col(c).alias(v) for v, c in first.items() if v[0] != "_")) if first else rows.select(F.lit(1).alias("__one")).limit(1)

    def _body(self, rule: Rule, deltas: dict[int, DataFrame] | None = None, total: dict[str, DataFrame] | None = None) -> DataFrame:
        def rows(k: int, a: Atom) -> DataFrame:
            if deltas and k in deltas:
                return deltas[k]
            if total and a.name in total:
                return total[a.name]
            bound = self._bound_closure(a)
            return bound if bound is not None else self.relation(a.name, len(a.args))

        positive = [(k, a) for k, a in enumerate(rule.body) if not a.negated]
        positive.sort(key=lambda ka: (not (deltas and ka[0] in deltas), -sum(not isinstance(x, Var) for x in ka[1].args)))
        out = None
        rest = list(positive)
        while rest:
            pick = next((x for x in rest if out is not None and set(x[1].variables) & set(out.columns)), rest[0])
            rest.remove(pick)
            frame = self._atom(pick[1], rows(*pick))
            shared = [c for c in frame.columns if out is not None and c in out.columns and c != "__one"]
            if out is None:
                out = frame
            elif shared:
                out = out.join(frame, shared).select(*dict.fromkeys([*out.columns, *frame.columns]))
            else:  # a product that the rule itself asks for
                out = out.crossJoin(frame.withColumnRenamed("__one", "__two").drop("__two") if "__one" in frame.columns and len(frame.columns) > 1 else frame.withColumnRenamed("__one", f"__one{pick[0]}"))
        for k, a in enumerate(rule.body):
            if a.negated:
                frame = self._atom(a, rows(k, a))
                on = [c for c in frame.columns if c in out.columns and c != "__one"]
                out = out.join(frame.select(*on).distinct(), on, "left_anti") if on else out.join(frame.limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_anti")
        head = [F.col(a.name) if isinstance(a, Var) else F.lit(a).cast("bigint") if isinstance(a, int) else F.lit(a) for a in rule.head.args]
        return out.select(*(c.alias(f"_{i}") for i, c in enumerate(head))).distinct()

    def _goal(self, goal: Atom) -> DataFrame:
        plain = Atom(goal.name, goal.args)
        rows = self._bound_closure(plain)
        got = self._magic(plain) if rows is None else rows
        out = self._atom(plain, got)
        if not plain.variables or all(v[0] == "_" for v in plain.variables):
            found = out.limit(1).agg((F.count(F.lit(1)) > 0).alias("holds"))
            return found.select((~F.col("holds")).alias("holds")) if goal.negated else found
        if goal.negated:
            raise DatalogError("a negated goal must be ground")
        return out.distinct()

    def _magic(self, goal: Atom) -> DataFrame:
        """Constants of the goal pushed into non-recursive rules, so that closures below start from them."""
        rules = [r for r in self.rules if r.head.name == goal.name]
        bound = {i: a for i, a in enumerate(goal.args) if not isinstance(a, Var)}
        if goal.name in self.known or not bound or not rules or len(self.component[goal.name]) > 1 or any(a.name == goal.name for r in rules for a in r.body):
            return self.relation(goal.name, len(goal.args))
        parts = []
        for r in rules:
            if len(r.head.args) != len(goal.args):
                raise DatalogError(f"{goal.name} has {len(r.head.args)} arguments, not {len(goal.args)}")
            given = {a.name: bound[i] for i, a in enumerate(r.head.args) if isinstance(a, Var) and i in bound}
            put = lambda a: Atom(a.name, tuple(given.get(x.name, x) if isinstance(x, Var) else x for x in a.args), a.negated)  # noqa: B023, E731
            parts.append(self._body(Rule(put(r.head), tuple(put(a) for a in r.body))))
        return reduce(DataFrame.unionByName, parts).distinct()


def query(graph: Graph, text: str, budget: int | None = 1000, joined: bool = False) -> list[DataFrame]:
    """One DataFrame a goal; more steps than ``budget`` are an error, None sets no bound."""
    spark = graph.nodes.sparkSession
    return Engine(spark, base_relations(graph), None if budget is None else min(max(budget, 1), 10_000)).run(text, joined)


def depends(graph: Graph, start: str, end: str, budget: int = 1000) -> bool:
    """Is there a dependency path?"""
    return bool(query(graph, f'?- depends_transitive("{start}", "{end}").', budget)[0].first()["holds"])


def render(results: list[DataFrame], limit: int = 200) -> str:
    """Markdown tables of the results, one a goal, ordered."""
    out = []
    for df in results:
        rows = df.orderBy(*df.columns).limit(limit).collect()
        if rows:
            out += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(str, r)) + " |" for r in rows), ""]
    return "\n".join(out)

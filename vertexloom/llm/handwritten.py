"""Files that no person of the repository wrote: generated, minified, vendored or mere data.

Repositories declare such files in attribute files; globs there are resolved per directory, later
lines and deeper directories first. Most repositories declare nothing, so equivalent patterns are
mined over the whole corpus: files that carry their own declaration (a generator's header, a
library's notice, an attribute) or unmistakable generated content give path patterns and line
signatures, which are applied to all files. A path pattern is used only if nearly all files under it
carry evidence; a copied library file is found by its lines, wherever it lies and however patched.

Defined results: NULL and empty texts are hand-written unless an attribute or their name says
otherwise; NULL paths match no pattern; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.operators.durable import durable

_CODE = re.compile(r"\.(py|js|ts|rs|go|cs|mjs|cjs|jsx|tsx|java|c|h|cc|cpp|css|php|rb|swift|kt)$")
_TOP = r"^\W*(?:(?:this|the|these|file|code|source|sources|module|class|form|implementation|document|contents?|it|is|are|was|were|been|has|have|being|auto(?:matically)?|programmatically|all|data|parser|lexer|bindings?|stubs?|header|client|api|types?|schema|models?|grammar|diese|dieser|datei|wurde|wird|der|die|ce|cette|fichier|le|la|a|été|est|este|esta|archivo|fue|ha|sido)\W+){0,7}"
#: A statement that a tool made the file, of a kind that public generators put on top of their output.
_GENERATED = re.compile(
    rf"(?i)@generated\b|<auto-?generated|{_TOP}auto-?generated\b|{_TOP}generated (?:by|from|with|using|on|via|automatically)\b|{_TOP}(?:automatically|machine)[- ](?:generated|made|produced|created|written|built)\b"
    rf"|{_TOP}(?:produced|created|made|emitted|built|written) automatically\b|\bgenerated (?:code|file|source)\b.{{0,40}}\b(?:do not|don't|never) (?:edit|modify|change|touch)|{_TOP}generated\s*(?:[:;.]|-+|$)"
    rf"|{_TOP}(?:automatisch )?(?:generiert|erzeugt)(?: von| aus| mit|\W*$)|{_TOP}(?:von|aus|mit) \S+ (?:generiert|erzeugt|erstellt)\b|{_TOP}(?:généré|produit|créé)e? (?:automatiquement|par|depuis|à partir)|{_TOP}(?:generado|producido|creado) (?:automáticamente|por|desde|a partir)"
)
#: A maker that need not be a tool, and a warning that it is one: both together tell the same.
_MADE = re.compile(rf"(?i){_TOP}(?:produced|created|made|emitted|built|written|compiled|output) (?:by|from|with|using) \S+")
_WARNED = re.compile(
    r"(?i)\b(?:do not|don't|never|must not) (?:edit|modify|change|touch|alter)\b(?: (?:this|the file|it|by hand|manually|directly)|\W*$|[.!;,])|\b(?:changes|edits|modifications)\b.{0,30}\b(?:lost|overwritten|discarded|undone)\b"
    r"|\bnicht (?:von hand |manuell )?(?:ä|ae)ndern\b|\bnicht (?:von hand |manuell )?bearbeiten\b|\bne pas (?:modifier|éditer)\b|\bno (?:modificar|editar|cambiar)\b"
)
#: Notices of third-party libraries: where the file was copied from, or its name, version and licence.
_NOTICE = re.compile(
    r"(?i)^\W*(?:this (?:file|code) (?:is|was) )?(?:vendored|bundled|copied|taken|imported|mirrored|extracted|forked|adapted) from \S+[@/ ]v?\d+(?:\.\d+)+|^\W*(?:upstream|origin(?:al)?|library|package|project|source)\s*:\s*\S+[@/ ]v?\d+(?:\.\d+)+|^\W*@licen[cs]e\b"
    r"|^\W*[a-z][\w.-]*(?: |@)v?\d+\.\d+(?:\.\d+)?(?:\W*$| - https?://| \| )|^\W*copyright (?:\(c\) )?(?:\d{4} )?the \S+ authors\b"
)
_LOCK = re.compile(
    r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|packages\.lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|poetry\.lock|pdm\.lock|uv\.lock|pipfile\.lock|composer\.lock|gemfile\.lock|go\.sum|mix\.lock|paket\.lock|deno\.lock|bun\.lockb?|flake\.lock|project\.assets\.json)$",
    re.I,
)
#: Names that generators give their output; hand-written files bear them too, so they prove nothing alone.
_TOOL_NAME = re.compile(r"(?:_pb2?|_gen|[._]generated|\.g|\.gen|\.pb|\.designer)\.[a-z]+$")
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|<!--|--|;|\"\"\"|''')")
_LEAD = re.compile(r"^\s*(?://|#|--|;|(/\*|<!--))")
#: What may stand before a file's comments without being a statement of it.
_PRELUDE = re.compile(r"""^\s*(?:package [\w.]+;?|['"]use strict['"];?|<\?\w.*|\{|%YAML.*|---|namespace [\w.]+;)\s*$""")
#: What a licence says of itself, not the name of a library.
_LICENCE = re.compile(r"(?i)^\W*(?:version|licen[cs]e|revision|release|since|apache|mpl|bsd|[al]?gpl)\b[ @]")
_COUNTED = re.compile(r"(?<![\w.])(?!(?:[uif]|u?int|float|utf_?|sha_?|md|base|b)\d+\b)[A-Za-z_]\w*?(\d+)\b")
_LITERAL = re.compile(r"""0[xX][0-9a-fA-F]+|[-+]?\d[\d_.eE+-]*|"[^"\n]*"|'[^'\n]*'|[\s,]+|[A-Za-z0-9+/=]{60,}""")
_FRAME = re.compile(r"(?m)^\s*(?:package \w+|//.*|#.*|/\*.*|import .*|from .*|use .*|using .*)$")
#: So many mined patterns (some 50 bytes each) may be sent to every task.
BROADCAST_PATTERNS = 100_000
_VARIANTS = {"js", "ts", "mjs", "cjs", "css"}


def is_minified(text: str, ext: str) -> bool:
    """Long lines of code with hardly any white space between short names."""
    if ext not in _VARIANTS or text.lstrip().startswith("<"):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    if max(map(len, lines), default=0) < 180:
        return False
    long_share = sum(len(x) for x in lines if len(x) > 180) / len(text)
    body = re.sub(r""""[^"\n]*"|'[^'\n]*'|//[^\n]*""", "", text)
    blank = sum(map(body.count, " \t\n\r")) / max(1, len(body))
    signs = sum(map(body.count, ";{}(),")) / max(1, len(body))
    return long_share > 0.6 and blank < 0.14 and signs > 0.08


def is_data(text: str) -> bool:
    """Code whose statements are nothing but one block of literals."""
    body = _FRAME.sub("", text)
    frame = _LITERAL.sub("", body)
    return len(frame) <= 90 and len(body) > 12 * len(frame) + 200 and bool(re.search(r"[=:{\[(]", frame))


def is_counted(text: str, least: int = 3) -> bool:
    """Definitions of one shape whose names count up, as generators emit them."""
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x and not _COMMENT.match(x) and not x.startswith(("import ", "from ", "use ", "using "))]
    if len(lines) < 5:
        return False
    run = longest = 0
    last = None
    hits = set()
    for k, line in enumerate(lines):
        m = _COUNTED.search(line)
        if not m:
            continue
        n = int(m[1])
        if last is not None and n == last + 1:
            run += 1
        elif n != last:
            run = 1
        last = n
        longest = max(longest, run)
        hits.add(k)
    if longest < least:
        return False
    # Lines of the counted definitions: those that count, and those between two that do.
    shapes = {re.sub(r"\d+", "0", re.sub(r"[A-Za-z_]\w*", "a", lines[k])) for k in hits}
    first, final = min(hits), max(hits)
    covered = (final - first + 1) / len(lines)
    return longest >= 0.3 * len(hits) and covered >= 0.6 and len(shapes) <= 6


def leading_comments(lines: list[str]) -> Iterator[str]:
    """The comment lines before the first statement, with the inside of block comments."""
    end = None
    for line in lines:
        rest = line
        if end is None:
            m = _LEAD.match(line)
            if not m and _PRELUDE.match(line):
                continue
            if not m and line.strip():
                return
            if m and m[1]:
                end, rest = "*/" if m[1] == "/*" else "-->", line[m.end() :]
        yield line
        if end and end in rest:
            end = None


def own_evidence(path: str, text: str) -> str | None:
    """What the file itself shows: generated, minified, data or vendored (by notice)."""
    if _LOCK.search(path):
        return "generated"
    ext = _CODE.search(path)
    if not text:
        return None
    lines = text.split("\n")
    lead = list(leading_comments(lines))
    tail = list(takewhile(lambda x: _COMMENT.match(x) or not x.strip(), reversed(lines)))
    told = [*lead, *tail]
    if any(map(_GENERATED.search, told)) or any(map(_MADE.search, told)) and any(map(_WARNED.search, told)):
        return "generated"
    if not ext:
        return None
    if is_minified(text, ext[1]):
        return "minified"
    if is_data(text):
        return "data"
    for line in [*(x for x in lines[:4] if _COMMENT.match(x)), *(x for x in lead[4:] if not _LICENCE.match(x))]:
        if _NOTICE.search(line.strip()):
            return "vendored"
    if is_counted(text, 2 if _TOOL_NAME.search(path) else 3):
        return "counted"
    return None


def path_patterns(path: str) -> list[str]:
    """Glob patterns a path falls under: its directories, its name's marks, its whole name."""
    *dirs, name = path.split("/")
    out = [f"**/{d}/**" for d in dirs]
    stem, dot, ext = name.partition(".")
    if "." in ext:
        out.append("*." + re.sub(r"[0-9a-f]{8,}", "[0-9a-f]*", ext))
    for mark in re.findall(r"(?:^|.)([_-][A-Za-z0-9]+)$", stem):
        out.append(f"*{mark}{dot}{ext}")
    return out


def attribute_rules(text: str | None, folder: str) -> list[tuple[int, str, str, bool]]:
    """(order, path regex, attribute, value) of an attribute file's generated and vendored marks."""
    rules = []
    for n, line in enumerate((text or "").splitlines()):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        pattern, *attrs = line.split()
        for a in attrs:
            m = re.fullmatch(r"(-?)(?:linguist-|gitlab-)?(generated|vendored)(?:=(\w+))?", a)
            if m:
                rules.append((n, glob_regex(pattern, folder), m[2], not m[1] and m[3] not in ("false", "0")))
    return rules


def glob_regex(pattern: str, folder: str) -> str:
    """Anchored regular expression of a glob in the attribute file of ``folder``."""
    anchored = "/" in pattern.rstrip("/")
    out, i, pattern = "", 0, pattern.lstrip("/")
    if pattern.endswith("/"):
        pattern += "**"
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    base = re.escape(folder) + "/" if folder else ""
    return f"^{base}{'' if anchored else '(?:.*/)?'}{out}$"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, source, path, own, patterns, lines: line hashes of code, rules)."""
    rule = pa.struct([("n", pa.int32()), ("regex", pa.string()), ("attribute", pa.string()), ("value", pa.bool_())])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(rule)]
    hashed = xxhash.xxh3_64_intdigest
    for b in batches:
        out: list[list] = [[] for _ in kinds]
        for doc, source, path, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            path, text = path or "", text or ""
            rules, lines = [], []
            if path.rsplit("/", 1)[-1] == ".gitattributes":
                rules = [dict(zip(("n", "regex", "attribute", "value"), r)) for r in attribute_rules(text, path.rpartition("/")[0])]
            own = own_evidence(path, text)
            if _CODE.search(path) and own not in ("minified", "data"):
                lines = [h - (1 << 63) for h in {hashed(x) for x in map(str.strip, text.split("\n")) if len(x) > 20 and not _COMMENT.match(x)}]
            for c, x in zip(out, (doc, source, path, own, path_patterns(path), lines, rules)):
                c.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "source", "path", "own", "patterns", "lines", "rules"])


def declared(files: DataFrame) -> DataFrame:
    """(doc_id, declared): what the repository's attribute files say of each file, NULL if nothing.

    The rule of the deepest directory counts, in one file the last; a rule may take a mark back.
    """
    rules = files.filter(F.size("rules") > 0).select("source", F.length("path").alias("deep"), F.explode("rules").alias("r"))
    hits = files.filter(F.size("rules") == 0).select("doc_id", "source", "path").join(rules, "source").filter(F.expr("path rlike r.regex"))
    best = hits.groupBy("doc_id", F.col("r.attribute").alias("attribute")).agg(F.max_by("r.value", F.struct("deep", "r.n")).alias("value"))
    return best.groupBy("doc_id").agg(F.max_by("attribute", F.struct(F.col("value").cast("int"), "attribute")).alias("attribute"), F.max("value").alias("value"))


def not_handwritten(documents: DataFrame, precision: float = 0.95, support: int = 20, copied: float = 0.7, min_lines: int = 3) -> DataFrame:
    """(doc_id, kind, by): kind is generated, minified, vendored or data; by tells the evidence.

    A path pattern is mined when at least ``support`` files of three repositories fall under it and at
    least ``precision`` of them carry evidence of one kind. A file is a copy when at least ``copied`` of
    its lines, and at least ``min_lines``, occur in files with a library's notice.
    """
    schema = "doc_id bigint, source string, path string, own string, patterns array<string>, lines array<bigint>, rules array<struct<n:int,regex:string,attribute:string,value:boolean>>"
    files = durable(documents.select("doc_id", "source", "path", "text").mapInArrow(_scan, schema))
    told = declared(files)
    own = F.when(F.col("own") == "counted", "generated").otherwise(F.col("own"))
    # Line signatures: distinct lines of noticed files against all files; a line is one row on this side.
    library = files.filter("own = 'vendored'").select(F.explode("lines").alias("line")).distinct()
    lines = files.filter("own is null or own = 'counted'").select("doc_id", F.size("lines").alias("n"), F.explode("lines").alias("line"))
    hits = lines.join(library, "line", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n"))
    copies = hits.filter((F.col("hits") >= copied * F.col("n")) & (F.col("hits") >= min_lines)).select("doc_id", F.lit(True).alias("copy"))
    judged = files.select("doc_id", "source", "patterns", own.alias("own")).join(copies, "doc_id", "left")
    judged = durable(judged.withColumn("own", F.when(F.col("copy"), "vendored").otherwise(F.col("own"))))
    by_pattern = judged.select("source", "own", F.explode("patterns").alias("pattern")).groupBy("pattern", "own").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("source").alias("sources")
    )
    over = Window.partitionBy("pattern")
    mined = by_pattern.withColumn("all", F.sum("n").over(over)).filter(
        F.col("own").isNotNull() & (F.col("n") >= precision * F.col("all")) & (F.col("all") >= support) & (F.col("sources") >= 3)
    )
    mined = mined.select("pattern", F.col("own").alias("pattern_kind"))
    rest = judged.filter("own is null").select("doc_id", F.explode("patterns").alias("pattern"))
    mined = durable(mined)
    # Few patterns have the support; only a counted few are sent to all tasks, else the join's skew is split at run time.
    placed = rest.join(F.broadcast(mined) if mined.count() <= BROADCAST_PATTERNS else mined, "pattern").groupBy("doc_id").agg(F.min("pattern_kind").alias("pattern_kind"))
    all_ = judged.select("doc_id", "own", "copy").join(placed, "doc_id", "left").join(told, "doc_id", "left")
    by: Column = F.when(F.col("value").isNotNull(), "attribute").when(F.col("copy"), "copied lines").when(F.col("own").isNotNull(), "own evidence").otherwise("mined pattern")
    kind = F.when(F.col("value") == F.lit(False), None).when(F.col("value"), F.col("attribute")).otherwise(F.coalesce("own", "pattern_kind"))
    return all_.select("doc_id", kind.alias("kind"), by.alias("by")).filter("kind is not null").distinct()

"""Predicates and functions on paths, labels and ids, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the path classes.
TEST_FRAGMENTS = ("/tests/", "/test/", "_test.", ".test.", "/spec/", "/specs/", "_spec.", "tests.rs", "test_bench", "_test.rs", "_tests.rs")
GENERATED_DIRS = ("generated", "gen", "template", "templates", "vendor", "third_party", "third-party", "obj", "dist", "build", "target", "node_modules")
GENERATED_ENDS = (".g.cs", ".generated.cs", ".designer.cs", ".gen.cs", ".generated.rs", ".generated.ts", ".g.ts")
SKIP_DIRS = ("venv", ".venv", "env", ".env", "node_modules", "__pycache__", ".git", ".svn", ".hg", "dist", "build", "target", "site-packages", ".tox", ".pytest_cache", ".mypy_cache", ".ruff_cache", "coverage", ".coverage", ".DS_Store", "Thumbs.db", ".idea", ".vscode", ".rust-toolchain", ".cargo")
VENDOR_DIRS = ("Lib", "lib", "third_party", "third-party", "vendor", "vendored", "bin", "obj", "packages", "deps", "external")
SENSITIVE = (
    r"^\.env$", r"^\.env\.", r"\.pem$", r"\.key$", r"\.p12$", r"\.pfx$", r"^credential", r"^secret", r"^password", r"^passwd", r"^token", r"^private[_-]?key", r"^id_rsa", r"^id_dsa", r"^id_ecdsa", r"^id_ed25519", r"^\.netrc$", r"^\.pgpass$",
    r"^\.aws", r"^\.ssh", r"^kubeconfig", r"\.kubeconfig$", r"^service[_-]?account", r"^gcloud", r"^auth\.json$", r"^secrets\.ya?ml$", r"^vault",
)
EXTENSIONS = {
    "code": "py pyw js mjs cjs ts tsx jsx go rs java c h cpp cc cxx hh hpp hxx cs rb php swift kt kts scala r sh bash zsh fish ps1 psm1 lua ex exs ml mli hs clj cljs erl hrl sql tf hcl yaml yml toml json jsonc xml html htm css scss sass less vue svelte dockerfile".split(),
    "document": "md markdown rst txt adoc asciidoc org tex latex".split(), "paper": ["pdf"], "image": "png jpg jpeg gif webp bmp tiff tif svg".split(),
}
LANGUAGES = {"rs": "rust", "py": "python", "pyw": "python", "go": "go", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "java": "java", "cs": "csharp"}
FRAMEWORK_LABELS = "collections componentmodel configuration diagnostics drawing forms generic http io json linq net runtime security serialization system tasks text threading web windows xml os sys re codecs warnings time math datetime subprocess shutil logging argparse copy weakref types multiprocessing socket select asyncio urllib html csv ast parser pydoc unittest mock ctypes struct pickle sqlite3 tempfile contextlib inspect importlib pkgutil zipfile tarfile fixer_util".split()
FAMILIES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "rs": "rust", "go": "go", "cs": "csharp", "java": "java", "c": "c", "h": "c", "cpp": "c", "cc": "c", "hpp": "c"}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unix_path(p: str | Column) -> Column:
    return F.lower(F.replace(_c(p), F.lit("\\"), F.lit("/")))


def is_test_path(p: str | Column) -> Column:
    return unix_path(p).rlike("|".join(map(re.escape, TEST_FRAGMENTS)))


def file_name(p: str | Column) -> Column:
    return F.element_at(F.split(F.replace(_c(p), F.lit("\\"), F.lit("/")), "/"), -1)


def is_generated_path(p: str | Column) -> Column:
    """A generated, template, vendored or output folder anywhere in the path, or a generated name at its end."""
    x = unix_path(p)
    name = file_name(x)
    ends = "|".join(re.escape(e) + "$" for e in GENERATED_ENDS)
    return F.arrays_overlap(F.split(x, "/"), F.array(*map(F.lit, GENERATED_DIRS))) | name.rlike(ends) | name.contains(".generated.")


def in_skipped_dir(p: str | Column, also: tuple[str, ...] = ()) -> Column:
    return F.arrays_overlap(F.split(_c(p), "/"), F.array(*map(F.lit, (*SKIP_DIRS, *also))))


def is_skipped_event(p: str | Column) -> Column:
    """A path with a hidden or skipped component."""
    return in_skipped_dir(p) | F.exists(F.split(_c(p), "/"), lambda x: x.startswith(".") & ~x.isin(".", ".."))


def is_sensitive(p: str | Column) -> Column:
    """A file name of the kind that holds credentials, in any case."""
    return file_name(p).rlike("(?i)" + "|".join(SENSITIVE))


def is_framework_label(label: str | Column) -> Column:
    """A label that is, or is made up of, names of standard libraries."""
    x = F.lower(F.trim(_c(label)))
    parts = F.filter(F.split(x, "[.:]"), lambda t: t != "")
    known = F.array(*map(F.lit, FRAMEWORK_LABELS))
    return F.array_contains(known, x) | ((F.size(parts) > 0) & (F.size(F.array_except(parts, known)) == 0))


def display_label(label: str | Column = "label", qualified: str | Column = "qualified_label") -> Column:
    return F.coalesce(_c(qualified), _c(label))


def relative_path(p: str | Column, root: str) -> Column:
    """Slashes, without the prefix of long paths and without the project's root."""
    clean = F.replace(F.regexp_replace(_c(p), r"^\\\\\?\\", ""), F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/")
    return F.when(clean.startswith(base), F.ltrim(F.substring(clean, len(base) + 1, 1 << 30), F.lit("/"))).otherwise(clean) if base else clean


def same_file(a: str | Column, b: str | Column) -> Column:
    """Equal paths, one the ending of the other, or the same file name."""
    x, y = (F.replace(_c(c), F.lit("\\"), F.lit("/")) for c in (a, b))
    return (x == y) | x.endswith(y) | y.endswith(x) | (file_name(x) == file_name(y))


def ignore_regex(line: str) -> str | None:
    """The pattern of a line of an ignore file; comments and empty lines give none, a folder covers what is in it."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    return glob_regex(line + "**" if line.endswith("/") else line)


def glob_regex(pattern: str) -> str:
    """A glob in which * also crosses folders, as an anchored regular expression."""
    return "^" + re.sub(r"(?:\\\*)+", ".*", re.escape(pattern)).replace(r"\?", ".") + "$"


def matches_glob(p: str | Column, pattern: str) -> Column:
    return _c(p).rlike(glob_regex(pattern))


def extension(p: str | Column) -> Column:
    return F.lower(F.regexp_extract(_c(p), r"\.([A-Za-z0-9]+)$", 1))


def stem(p: str | Column) -> Column:
    return F.regexp_extract(_c(p), r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def top_dir(p: str | Column) -> Column:
    return F.split(_c(p), "/")[0]


def _lookup(key: Column, table: dict[str, str], default: str | None) -> Column:
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def file_type(p: str | Column) -> Column:
    """code, document, paper or image; NULL for files to be skipped."""
    return _lookup(extension(p), {e: t for t, es in EXTENSIONS.items() for e in es}, None)


def language_family(p: str | Column) -> Column:
    return _lookup(extension(p), FAMILIES, "other")


def make_id(*parts: str | Column) -> Column:
    """Parts trimmed of _ and . and joined by _, other runs than letters and digits as one _, lower case."""
    kept = [F.when(F.length(t) > 0, t) for p in parts if (t := F.regexp_replace(normalize_label(p), r"^[_.]+|[_.]+$", "")) is not None]
    return F.lower(F.regexp_replace(F.regexp_replace(F.concat_ws("_", *kept), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def normalize_label(x: str | Column) -> Column:
    """Trimmed, freed of all matching pairs of quotes or brackets around it, white space as one blank."""
    out = F.trim(_c(x))
    pair = r"""^(?:"(.*)"|'(.*)'|`(.*)`|<(.*)>|\[(.*)\]|\((.*)\))$"""
    most = F.length(F.regexp_extract(out, r"""^["'`<\[(\s]*""", 0))  # no more pairs than opening signs
    turns = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    bare = F.aggregate(turns, out, lambda t, _: F.trim(F.when(t.rlike(pair), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)))
    return F.regexp_replace(bare, r"\s+", " ")


def clipped(text: str | Column, most: int) -> Column:
    """The first ``most`` bytes as text, a torn last character dropped."""
    raw = F.substring(F.encode(_c(text), "UTF-8"), 1, most)
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\ufffd+$", "")


def iso_seconds(c: str | Column) -> Column:
    return F.date_format(F.timestamp_seconds(_c(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def latency_ms(start: str | Column, end: str | Column) -> Column:
    return F.when(_c(end) > _c(start), (_c(end) - _c(start)) / F.lit(1e6))


def percent(part: Column, whole: Column, default: float) -> Column:
    return F.when(whole == 0, F.lit(default)).otherwise(part * 100.0 / whole)


def terms(c: str | Column) -> Column:
    """Lower-cased runs of letters and digits of two bytes or more."""
    return F.filter(F.split(F.lower(_c(c)), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 2)

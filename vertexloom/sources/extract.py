"""Symbols and links of source texts, by line patterns of each language, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.paths import extension, make_id, stem
from vertexloom.sources.graphs import EDGE, NODE, conform

#: Patterns of definitions and imports; the first group is the name.
DEFINITIONS = {
    "py": r"(?m)^[ \t]*(?:async )?(?:def|class) (\w+)", "js": r"(?m)^[ \t]*(?:export )?(?:default )?(?:async )?(?:function|class)\*? (\w+)", "ts": r"(?m)^[ \t]*(?:export )?(?:default )?(?:abstract )?(?:async )?(?:function|class|interface|enum|type) (\w+)",
    "rs": r"(?m)^[ \t]*(?:pub(?:\([^)]*\))? )?(?:async )?(?:unsafe )?(?:fn|struct|enum|trait|mod) (\w+)", "go": r"(?m)^(?:func (?:\([^)]*\) )?|type )(\w+)", "cs": r"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|async|override|virtual) )+(?:class |struct |interface |enum |[\w<>\[\],]+ )(\w+)",
}
IMPORTS = {
    "py": r"(?m)^[ \t]*(?:from (?:[\w.]+) )?import ([\w.]+)", "js": r"(?m)^[ \t]*import [^;\n]*?[\"'](?:\./)?([^\"']+)[\"']", "ts": r"(?m)^[ \t]*import [^;\n]*?[\"'](?:\./)?([^\"']+)[\"']",
    "rs": r"(?m)^[ \t]*(?:pub )?use ([\w:]+)", "go": r"(?m)^[ \t]*(?:import )?(?:\w+ )?\"([\w./-]+)\"[ \t]*$", "cs": r"(?m)^[ \t]*using (?:static )?([\w.]+)[ \t]*;",
}
CALL = r"\b([A-Za-z_]\w*)\s*\("
_RESERVED = "if for while switch catch return function fn def class match elif print and or not in sizeof typeof using lock new super foreach".split()


def _found(text: str, ext: Column, table: dict[str, str]) -> Column:
    out = F.array().cast("array<string>")
    for e, rx in table.items():
        out = F.when(ext == e, F.regexp_extract_all(text, F.lit(rx), F.lit(1))).otherwise(out)
    return F.filter(out, lambda x: x != "")


def extract(files: DataFrame, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Nodes (a file node and its definitions) and edges (contains, imports, calls) of source files.

    Calls run from the file to the called name; ``build.resolve_calls`` binds them across files.
    """
    ext = extension(path)
    base = files.filter(F.col(text).isNotNull() & F.col(path).isNotNull()).select(F.col(path).alias("p"), F.col(text).alias("t"), ext.alias("e"))
    rows = base.select("p", "e", make_id("p").alias("file_id"), _found("t", F.col("e"), DEFINITIONS).alias("defs"), _found("t", F.col("e"), IMPORTS).alias("imports"), F.array_except(F.array_distinct(F.regexp_extract_all("t", F.lit(CALL), F.lit(1))), F.array(*map(F.lit, _RESERVED))).alias("calls"))
    file_nodes = rows.select(F.col("file_id").alias("id"), stem("p").alias("label"), F.lit("code").alias("file_type"), F.col("p").alias("source_file"), F.lit("ast").alias("extractor"))
    defs = rows.select("p", "file_id", F.explode(F.array_distinct("defs")).alias("label"))
    nodes = file_nodes.unionByName(defs.select(make_id("p", "label").alias("id"), "label", F.lit("code").alias("file_type"), F.col("p").alias("source_file"), F.lit("ast").alias("extractor")))
    edge = lambda df, target, relation, conf, score: df.select(F.col("file_id").alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(conf).alias("confidence"), F.lit(score).alias("confidence_score"), F.lit(1.0).alias("weight"), F.col("p").alias("source_file"), F.lit("ast").alias("extractor"))
    edges = edge(defs, make_id("p", "label"), "contains", "EXTRACTED", 1.0)
    edges = edges.unionByName(edge(rows.select("p", "file_id", F.explode(F.array_distinct("imports")).alias("x")), make_id("x"), "imports", "EXTRACTED", 1.0))
    edges = edges.unionByName(edge(rows.select("p", "file_id", F.explode("calls").alias("x")), F.col("x"), "calls", "INFERRED", 0.5))
    return conform(nodes, NODE), conform(edges, EDGE)


def make_targets(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, target, depends_on) of Makefile rules."""
    line = F.explode(F.split(text, "\n"))
    rows = files.select(F.col(path).alias("path"), line.alias("l")).filter(F.col("l").rlike(r"^[A-Za-z][\w.-]*:(?!=)"))
    return rows.select("path", F.regexp_extract("l", r"^([\w.-]+):", 1).alias("target"), F.filter(F.split(F.regexp_extract("l", r"^[\w.-]+:\s*(.*)$", 1), r"\s+"), lambda x: x != "").alias("depends_on"))


def project_references(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, reference) of C# project files."""
    refs = F.explode(F.regexp_extract_all(text, F.lit(r'ProjectReference\s+Include="([^"]+)"'), F.lit(1)))
    own = files.filter(F.col(path).endswith(".csproj")).select(F.col(path).alias("path"), refs.alias("r"))
    return own.select("path", F.replace("r", F.lit("\\"), F.lit("/")).alias("reference"))

"""Queries pN_ of the text problems, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import handwritten as _handwritten
from vertexloom.llm import leaks as _leaks
from vertexloom.llm import packing
from vertexloom.llm import residue as _residue
from vertexloom.llm import secrets as _secrets
from vertexloom.llm import syntax as _syntax


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kinds(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    return sorted((r[0], r[1]) for r in _table(spark, sf_dir, "container_sizes").select("container_kind", "capacity_tokens").distinct().collect())


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handwritten.not_handwritten(_table(spark, sf_dir, "documents")).select("doc_id")


def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handwritten.not_handwritten(_table(spark, sf_dir, "documents"))


def p4_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that remain."""
    documents = _table(spark, sf_dir, "documents")
    return documents.join(_handwritten.not_handwritten(documents).select("doc_id"), "doc_id", "left_anti")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _syntax.check_syntax(_table(spark, sf_dir, "documents"), False).filter("cost > 0").select("doc_id").distinct()


def p5_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and kind of each invalid file's fault."""
    return _syntax.check_syntax(_table(spark, sf_dir, "documents")).filter("cost > 0").select("doc_id", "language", "cost", "kind")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _syntax.fault_rates(_table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.find_secrets(_table(spark, sf_dir, "documents")).select("doc_id", "line_no").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.find_secrets(_table(spark, sf_dir, "documents"))


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return _secrets.redacted(_table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = packing.token_counts(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", _kinds(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share of each kind."""
    placed = p8_containers(spark, sf_dir).filter("container_no is not null")
    got = placed.groupBy("container_kind").agg((F.max("container_no") + 1).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    sizes = _table(spark, sf_dir, "container_sizes").distinct()
    return got.join(F.broadcast(sizes), "container_kind").withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")).select("item_id", "doc_id")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document window similar to an item's, also below the length that counts as a leak."""
    return _leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"), 0)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residue.residue(_table(spark, sf_dir, "documents")).select("doc_id")


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residue.residue(_table(spark, sf_dir, "documents"))


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain, with their text."""
    documents = _table(spark, sf_dir, "documents")
    return documents.join(_residue.residue(documents).select("doc_id"), "doc_id", "left_anti")


QUERIES = {f.__name__: f for f in (p4_found, p4_kinds, p4_handwritten, p5_found, p5_repairs, p5_rates, p7_found, p7_spans, p7_redacted, p8_containers, p8_fill, p9_found, p9_near, p10_found, p10_kinds, p10_kept)}
_GRAMS = "SELECT {0}, array_to_string(w[k:k + 29], ' ') AS g FROM (SELECT {0}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {1}), LATERAL (SELECT unnest(generate_series(1, len(w) - 29)) AS k)"
SQL: dict[str, str] = {
    "p9_found": f"WITH a AS ({_GRAMS.format('item_id', 'eval_items')}), b AS ({_GRAMS.format('doc_id', 'documents')}) SELECT DISTINCT item_id, doc_id FROM a JOIN b USING (g)",
}

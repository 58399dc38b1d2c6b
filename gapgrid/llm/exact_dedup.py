"""Exact duplicates with a heavy-hitter split: frequent digests are settled where they are read, the rest by one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapgrid.llm.common import free_names, materialize

SUPPORT = 0.001


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, SHA-256 of the unchanged text in UTF-8); a null text counts as empty."""
    return df.select(F.col(key).cast("long").alias(key), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256).alias("text_sha256"))


def heavy_winners(d: DataFrame, key: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """Winner and size of each digest that makes up more than ``support`` of the rows; 1 / support rows at most.

    A Misra-Gries pass (``freqItems``, 1 / support counters) names every such digest, perhaps others too; a second
    pass counts the named ones exactly. A digest that was named and is rare is settled just as rightly.
    """
    named = d.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    return (d.join(F.broadcast(named), "text_sha256", "left_semi")
            .groupBy("text_sha256").agg(F.max(key).alias("keep_id"), F.count("*").alias("group_size"))
            .where(F.col("group_size") > 1))


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``key``, ``keep_id`` (largest key of equal texts), ``group_size``, ``kept``, ``text_sha256``.

    Heavy digests join a broadcast table of 1 / ``support`` rows at most and are not shuffled; the others meet in a window
    whose groups hold no more than ``support`` of the rows. Null keys rank below all others; if a group has only null
    keys, ``keep_id`` is null and its rows are kept; rows that repeat the winning key are kept together. Empty in,
    empty out; further columns are ignored.
    """
    d = materialize(digests(df, key, text), "digests")
    heavy = materialize(heavy_winners(d, key, support), "heavy")
    light = d.join(F.broadcast(heavy), "text_sha256", "left_anti")
    w = Window.partitionBy("text_sha256")
    light = light.select(key, F.max(key).over(w).alias("keep_id"), F.count("*").over(w).alias("group_size"), "text_sha256")
    hot = d.join(F.broadcast(heavy), "text_sha256").select(key, "keep_id", "group_size", "text_sha256")
    return light.unionByName(hot).select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, all columns as they are; of rows equal in ``doc_id`` and text, any one.

    A null text counts as empty, a null ``doc_id`` stays only in groups without any other. Empty in, empty out.
    """
    id_, sha, n, own = free_names(docs, "kept_id", "kept_sha", "kept_rows", "own_sha")
    out = exact_duplicates(docs, support=support).where("kept")
    kept = materialize(out.groupBy(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).agg(F.count("*").alias(n)), "kept")
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    rows = docs.withColumn(own, digest).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha)))
    if kept.where(F.col(n) > 1).isEmpty():
        return rows.select(*docs.columns)
    again = rows.where(F.col(n) > 1).dropDuplicates([id_, sha])
    return rows.where(F.col(n) == 1).unionByName(again).select(*docs.columns)

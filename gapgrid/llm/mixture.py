"""Mixing sources to target weights: budgets flow down a domain-language-source tree, documents fill them in seeded order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgrid.llm.common import free_names, materialize

LEVELS = ("domain", "lang", "source")


def document_tokens(text: str = "text") -> Column:
    """Budget unit of a document: a token for every four bytes begun; null or empty text has none."""
    return F.ceil(F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) / 4).cast("long")


def domain_of(source: str = "source", domains: int = 4) -> Column:
    """Sources are dealt to ``domains`` (16 at most) domains by the first hexadecimal digit of the MD5 of their name."""
    digit = F.substring(F.md5(F.coalesce(F.col(source).cast("string"), F.lit(""))), 1, 1)
    return F.concat(F.lit("domain"), ((F.instr(F.lit("0123456789abcdef"), digit) - 1) % domains).cast("string"))


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    """Whole-number weight of a node among its siblings; names without an entry weigh 1."""
    named = weights.get(level, {})
    return reduce(lambda c, kv: c.when(F.col(level) == kv[0], kv[1]), named.items(), F.when(F.lit(False), 0)).otherwise(1).cast("long")


def shared_out(nodes: DataFrame, parent: list[str], level: str, weight: Column) -> DataFrame:
    """Split ``budget`` of each parent among its children by weight, none above its ``capacity``.

    What a full child can't take goes to its siblings by their weights. Children sorted by capacity / weight: the first
    whose share of what is left fits its capacity fixes the level for all after it (their own levels are no higher, so it is a maximum). Shares are rounded down.
    """
    by = Window.partitionBy(*parent)
    ratio = F.col("capacity") / F.col("weight")
    order = by.orderBy(F.col("ratio"), F.col(level)).rowsBetween(Window.unboundedPreceding, -1)
    f = nodes.withColumn("weight", weight).withColumn("ratio", ratio)
    f = f.withColumn("left_budget", F.col("budget") - F.coalesce(F.sum("capacity").over(order), F.lit(0)))
    f = f.withColumn("left_weight", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(order), F.lit(0)))
    f = f.withColumn("level", F.col("left_budget") / F.col("left_weight"))
    f = f.withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(by))
    share = F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("capacity")).otherwise(F.floor(F.col("water") * F.col("weight")).cast("long"))
    return f.withColumn("budget", F.least("capacity", share).cast("long")).drop("weight", "ratio", "left_budget", "left_weight", "level", "water")


def leaf_budgets(leaves: DataFrame, percent: int, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Budget of every leaf. ``leaves``: LEVELS and ``tokens``; the root's budget is ``percent`` of all tokens.

    A node can hold at most ``max_epochs`` times its tokens. A shortage stays among siblings as long as they can take it,
    because the parent's own budget only shrinks when its whole subtree is full.
    """
    cap = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    parent: list[str] = []
    nodes = None
    for level in LEVELS:
        path = parent + [level]
        children = cap.groupBy(*path).agg(F.sum("capacity").cast("long").alias("capacity"), F.sum("tokens").cast("long").alias("tokens"))
        if nodes is None:  # one row per domain
            children = children.withColumn("budget", (F.sum("tokens").over(Window.partitionBy(F.lit(1))) * percent / 100).cast("long"))
        else:
            children = children.join(nodes.select(*parent, "budget"), parent)
        nodes = shared_out(children, parent or [F.lit(1)], level, weight_of(level, weights))
        parent = path
    return nodes.select(*LEVELS, "tokens", "budget")


def mixture(df: DataFrame, weights: dict[str, dict[str, int]], percent: int = 50, max_epochs: int = 4, seed: int = 42,
            key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per input row: ``key``, the leaf (domain, lang, source), ``tokens`` and ``copies``, how often the mixture holds it.

    With ``row``, a column of unique numbers, it comes back in place of ``key``, and rows with a null key are ordered by
    the MD5 of their text too, so that they spread over the hash.

    The mixture asks for ``percent`` of all tokens of the input, dealt by ``leaf_budgets``. A leaf whose budget is e whole
    epochs and a rest holds each document e times, and once more those that come first in the order of the seeded hash
    of (seed, epoch, ``key``), as long as their running tokens stay within the rest. The order is cut into 4,096 ranges of the
    hash; only the range in which the rest ends is summed row by row, so no leaf is ever whole in one task. Null names form a
    leaf of their own (``''``), null keys count as -1; rows equal in hash are ordered by key and tokens, and equal rows
    are interchangeable. A leaf without tokens holds each of its documents once. Empty in, empty out.
    """
    id_, salt = free_names(df.select(*{key, text, *LEVELS[1:]}), "id", "salt")
    spread = F.when(F.col(key).isNull(), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))) if row else F.lit(None).cast("string")
    back = (F.col(row) if row else F.lit(0)).cast("long").alias(id_)
    docs = df.select(F.col(key).cast("long").alias(key), back, spread.alias(salt), domain_of().alias("domain"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS[1:]),
                     document_tokens(text).alias("tokens"))
    docs = materialize(docs, "mix-docs")
    leaves = materialize(docs.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    budgets = leaf_budgets(leaves, percent, max_epochs, weights)
    plan = materialize(budgets.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1))
                       .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0))
                       .select(*LEVELS, "epochs", "rest"), "mix-plan")
    # (leaf, epochs, rest) is small next to the documents; its join is left to Spark, which splits hot leaves
    ordered = docs.join(plan, list(LEVELS)).withColumn("h", F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "epochs", F.coalesce(F.col(key), F.lit(-1)), salt)), 1, 15))
    ordered = ordered.withColumn("bucket", F.substring("h", 1, 3))
    ordered = materialize(ordered, "mix-ordered")
    per = ordered.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("tokens").alias("in_bucket"))
    to = F.sum("in_bucket").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    # of each leaf: the range in which the rest ends, and the tokens before it
    edge = (per.withColumn("before", to - F.col("in_bucket")).withColumn("over", to > F.col("rest")).where("over")
            .groupBy(*LEVELS).agg(F.min_by(F.struct(F.col("bucket").alias("edge"), F.col("before")), "bucket").alias("e"))
            .select(*LEVELS, "e.edge", "e.before"))
    edge = materialize(edge, "mix-edges")
    near = ordered.join(edge, list(LEVELS), "left")
    cum = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("h", key, "tokens", id_).rowsBetween(Window.unboundedPreceding, 0))
    inside = (near.where("bucket = edge").withColumn("more", (cum + F.col("before") <= F.col("rest")).cast("int")))
    whole = near.where("edge IS NULL OR bucket <> edge").withColumn("more", ((F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))).cast("int"))
    return inside.unionByName(whole).select(F.col(id_).alias(row) if row else key, *LEVELS, "tokens", (F.col("epochs") + F.col("more")).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, weights: dict[str, dict[str, int]], percent: int, max_epochs: int, seed: int) -> DataFrame:
    """Rows of ``docs`` as often as the mixture holds them, all columns as they are.

    Every row has a decision of its own: rows are numbered, so a repeated or null ``doc_id`` stands for nothing but its row and the
    leaf budgets hold. Of rows equal in ``doc_id`` and tokens, the ones to come first are any. Null texts have no tokens and stay as often as
    ``mixture`` says (at least once in a leaf without tokens). Empty in, empty out.
    """
    row, copies, n = free_names(docs, "row_number", "copies", "copy_number")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    m = mixture(numbered, weights, percent, max_epochs, seed, row=row).where("copies > 0").select(row, F.col("copies").cast("int").alias(copies))
    out = numbered.join(m, row)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))

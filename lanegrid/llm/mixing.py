"""Mixing sources to target weights by hierarchical budgets, with DataFrame functions only.

A token budget flows down a tree of domains, languages and sources in proportion to weights.
What a node cannot use (its leaves hold too few tokens, even repeated ``max_epochs`` times) is
handed to its siblings first; a parent passes a shortage up only when all its children are
full. Every leaf then takes whole epochs while its budget lasts, and of the next epoch the
longest prefix, in a seeded order, whose tokens fit.

The prefix is found without sorting a leaf in one task: documents are dealt by their seeded
hash into about sqrt(n) buckets, bucket sums are added up, and only the one bucket in which the
budget ends is ranked document by document.

Defined results: a null domain, language or source is a node of its own, named ``(none)``; a
null or empty text has no tokens and is taken when its place lies in the prefix; a text of any
length counts whole; a document longer than its leaf's rest of the budget ends the prefix; rows
with the same id, text, language and source are one document, and in ``mix`` any one of them stays; ties in the seeded order are broken by id
and text hash; an empty table or budget gives an empty result; budgets are whole numbers of
tokens, rounded down at each node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.llm.sizes import free, join_counted
from lanegrid.runtime import Scratch

LEVELS = ("domain", "lang", "source")
NONE = "(none)"


def n_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _weights(level: str, weights: dict[str, int]) -> Column:
    known = [F.lit(x) for pair in sorted(weights.items()) for x in pair]
    return F.coalesce(F.create_map(*known)[F.col(level)], F.lit(1)).cast("long") if known else F.lit(1).cast("long")


def _share_out(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Splits ``budget`` (of the parent) over children by ``weight``, none above its ``capacity``.

    In order of capacity per weight, a child is full if its fair share of what is left reaches
    its capacity; the rest share what the full ones leave. Products are exact decimals.
    """
    by = Window.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")).asc_nulls_last(), child)
    all_of = Window.partitionBy(*parent)
    big = lambda c: c.cast("decimal(19,0)")
    before = F.coalesce(F.sum("capacity").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumns({"_before": before, "_after": after})
    full = big(F.col("capacity")) * big(F.col("_after")) <= big(F.col("weight")) * big(F.greatest(F.col("budget") - F.col("_before"), F.lit(0)))
    nodes = nodes.withColumn("_full", full & (F.col("weight") > 0))
    nodes = nodes.withColumns(
        {
            "_left": F.col("budget") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(all_of),
            "_rest": F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(0)).over(all_of),
            "_w": big(F.col("weight")),
        }
    )
    nodes = nodes.withColumn("_product", F.col("_w") * big(F.col("_left")))
    share = F.when(F.col("_full"), F.col("capacity")).when(F.col("_rest") > 0, F.expr("_product div _rest")).otherwise(0)
    return nodes.withColumn("share", share.cast("long")).drop("_before", "_after", "_full", "_left", "_rest", "_w", "_product")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget_of: tuple[int, int], max_epochs: int) -> DataFrame:
    """Budgets of the leaves (domain, lang, source, tokens, docs): top-down over the three levels.

    ``budget_of`` is the total budget as a fraction (numerator, denominator) of all tokens.
    """
    up, down = budget_of
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = (leaves.agg(F.sum("tokens")).collect()[0][0] or 0) * up // down
    above, parent = None, []
    for i, level in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weights(level, weights.get(level, {})))
        nodes = nodes.join(above, parent) if parent else nodes.withColumn("budget", F.lit(total))
        above = _share_out(nodes, parent or [F.lit(0)], level).select(*keys, F.col("share").alias("budget"))
        parent = keys
    return leaves.join(above, list(LEVELS))


def select_epochs(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, dict[str, int]],
    scratch: Scratch,
    budget_of: tuple[int, int] = (3, 5),
    max_epochs: int = 2,
    seed: int = 11,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """(key, text_hash, domain, lang, source, n_tokens, epoch, order_key): the documents of the mixture, once per epoch."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    sized = docs.select(
        F.col(key),
        F.xxhash64(text).alias("text_hash"),
        named(domain).alias("domain"),
        named(F.col("lang")).alias("lang"),
        named(F.col("source")).alias("source"),
        n_tokens(F.col(text)).alias("n_tokens"),
    )
    sized = scratch.save(sized.distinct(), "sized")
    leaves = scratch.save(sized.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "leaves")
    plan = leaf_budgets(leaves, weights, budget_of, max_epochs).where((F.col("budget") > 0) & (F.col("tokens") > 0))
    plan = plan.select(
        *LEVELS,
        F.expr("cast(budget div tokens as int)").alias("whole"),
        F.expr("budget % tokens").alias("rest"),
        F.ceil(F.sqrt("docs")).cast("long").alias("buckets"),
    )
    plan = scratch.save(plan, "plan")
    rows = join_counted(sized, plan, list(LEVELS), spread=key, row_bytes=F.octet_length(F.concat(*LEVELS)) + 64)
    order = lambda epoch: F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    repeated = rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))

    partial = rows.where("rest > 0").withColumns({"epoch": F.col("whole"), "order_key": order(F.col("whole"))})
    partial = partial.withColumn("bucket", F.expr("conv(substring(order_key, 1, 8), 16, 10) * buckets div 4294967296"))
    partial = scratch.save(partial, "partial")
    sums = partial.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("held"))
    up_to = Window.partitionBy(*LEVELS).orderBy("bucket")
    sums = sums.withColumn("before", F.sum("held").over(up_to) - F.col("held"))
    placed = partial.join(sums, [*LEVELS, "bucket"]).where("before <= rest")
    inside = placed.where("before + held <= rest")
    ranked = Window.partitionBy(*LEVELS, "bucket").orderBy("order_key", key, "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where("before + held > rest").withColumn("_sum", F.col("before") + F.sum("n_tokens").over(ranked)).where("_sum <= rest")
    columns = [key, "text_hash", *LEVELS, "n_tokens", "epoch", "order_key"]
    out = repeated.withColumn("order_key", order(F.col("epoch"))).select(*columns)
    return out.unionByName(inside.select(*columns)).unionByName(edge.select(*columns))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], scratch: Scratch, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The mixture's documents with all columns of ``docs``, and their ``domain``, ``n_tokens`` and ``epoch`` (which replace columns of these names)."""
    chosen = select_epochs(docs, domain, weights, scratch, text=text, key=key, **options).select(
        F.col(key).alias("_id"), F.col("text_hash").alias("_hash"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "domain", "n_tokens", "epoch"
    )
    named = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    h, lang, source = (free(docs.columns, n) for n in ("_h", "_l", "_s"))
    rows = docs.withColumns({h: F.xxhash64(text), lang: named(F.col("lang")), source: named(F.col("source"))}).dropDuplicates([key, h, lang, source])
    on = rows[key].eqNullSafe(chosen["_id"]) & (rows[h] == chosen["_hash"]) & (rows[lang] == chosen["_lang"]) & (rows[source] == chosen["_source"])
    own = [c for c in docs.columns if c not in ("domain", "n_tokens", "epoch")]
    return rows.join(chosen, on).select(*[rows[c] for c in own], chosen["domain"], chosen["n_tokens"], chosen["epoch"])

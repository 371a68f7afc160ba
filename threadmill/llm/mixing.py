"""Mixing sources to target weights over a domain / language / source tree.

The token budget flows down the tree by the nodes' weights.  A node cannot
take more than its subtree holds (``max_epochs`` passes over every leaf), so
among the children of one parent the budget is shared by *water filling*:
children that are too small get all they hold, the rest is shared by weight.
What a short leaf leaves over is thus taken by its siblings first, and only
what the whole subtree cannot take goes to the siblings of its ancestor,
since a subtree's own limit is the sum of its leaves.

A leaf's share is spent in seeded epochs: whole passes over the leaf, then
the longest prefix of one more pass, in the order of a seeded hash of
(epoch, key), that fits the remaining tokens.  To find that prefix no leaf is
sorted as a whole: rows are summed by (leaf, first digits of the hash), a
window over those sums finds the bin in which the budget ends, and only that
bin's rows are summed one by one.  The cut is a hash value per leaf; choosing
the rows is a filter on the input itself, so no text is shuffled.

Defined results: null path parts count as the node ``'unknown'`` (the output
keeps the input's values); rows without words have 0 tokens; rows of one leaf
with equal keys form one unit that is taken or left together; a node whose
weight is 0 gets nothing; an empty table gives an empty plan; a budget above
what the tree holds takes everything ``max_epochs`` times.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import MAX_BROADCAST_BYTES, broadcast_if, measured_bytes
from .base import WORD_PATTERN, stored

#: Leading hex digits of the order hash that make a bin.
BIN_DIGITS = 3

DOMAIN, LANG, SOURCE = "__domain", "__lang", "__source"
LEVELS = (DOMAIN, LANG, SOURCE)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"),
                             F.coalesce(key.cast("string"), F.lit("null"))))


def node_weight(levels: list[str], weights: Mapping[tuple, float]) -> Column:
    """The weight given for the node at ``levels`` (a path of that length), 1 for others."""
    out = None
    for path, w in weights.items():
        if len(path) == len(levels):
            here = F.lit(True)
            for col, part in zip(levels, path):
                here = here & (F.lit(True) if part == "*" else F.col(col) == part)
            out = F.when(here, float(w)) if out is None else out.when(here, float(w))
    return F.lit(1.0) if out is None else out.otherwise(1.0)


def water_fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share ``budget`` of every parent among its children; adds ``share``.

    Needs ``capacity``, ``weight`` and ``budget`` (the parent's).  Children in
    the order of capacity / weight: the k-th is filled up when, at the level
    where it is just full, the budget is not used up yet.
    """
    over = Window.partitionBy(*parent)
    ordered = over.orderBy("__ratio", name)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    w = F.greatest(F.col("weight"), F.lit(0.0))
    held = (nodes.withColumn("weight", w)
            .withColumn("capacity", F.when(w > 0, F.col("capacity")).otherwise(0.0))
            .withColumn("__ratio", F.when(w > 0, F.col("capacity") / w).otherwise(0.0))
            .withColumn("__c", F.coalesce(F.sum("capacity").over(before), F.lit(0.0)))
            .withColumn("__w", F.sum("weight").over(over) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
            .withColumn("__full", F.col("__ratio") * F.col("__w") + F.col("__c") <= F.col("budget"))
            .withColumn("__used", F.sum(F.when(F.col("__full"), F.col("capacity")).otherwise(0.0)).over(over))
            .withColumn("__open", F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col("weight"))).over(over)))
    return (held.withColumn("share", F.when(F.col("__full"), F.col("capacity"))
                            .otherwise((F.col("budget") - F.col("__used")) / F.col("__open") * F.col("weight")))
            .drop("__ratio", "__c", "__w", "__full", "__used", "__open"))


def leaf_budgets(supply: DataFrame, weights: Mapping[tuple, float], budget_share: float,
                 max_epochs: int) -> DataFrame:
    """Per leaf (DOMAIN, LANG, SOURCE, ``supply``): ``share`` of the token budget."""
    leaves = supply.withColumn("capacity", F.col("supply").cast("double") * max_epochs)
    langs = leaves.groupBy(DOMAIN, LANG).agg(F.sum("capacity").alias("capacity"))
    domains = (langs.groupBy(DOMAIN).agg(F.sum("capacity").alias("capacity"))
               .withColumn("weight", node_weight([DOMAIN], weights)).withColumn("__root", F.lit(0)))
    total = F.sum("capacity").over(Window.partitionBy("__root")) / max_epochs
    top = water_fill(domains.withColumn("budget", F.floor(total * budget_share).cast("double")), ["__root"], DOMAIN)
    mid = water_fill(langs.withColumn("weight", node_weight([DOMAIN, LANG], weights))
                     .join(top.select(DOMAIN, F.col("share").alias("budget")), DOMAIN), [DOMAIN], LANG)
    low = water_fill(leaves.withColumn("weight", node_weight([DOMAIN, LANG, SOURCE], weights))
                     .join(mid.select(DOMAIN, LANG, F.col("share").alias("budget")), [DOMAIN, LANG]),
                     [DOMAIN, LANG], SOURCE)
    return low.select(*LEVELS, "supply", F.floor(F.col("share") + 1e-6).cast("bigint").alias("share"))


def plan(docs: DataFrame, domain: Column, weights: Mapping[tuple, float], budget_share: float,
         max_epochs: int, seed: int, key_col: str = "doc_id", text_col: str = "text",
         lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per leaf: whole passes ``epochs`` and, for the pass after them, ``cut``: the last order hash taken."""
    slim = stored(docs.select(*_path(domain, lang_col, source_col), F.col(key_col).alias("__key"),
                              n_words(F.col(text_col)).alias("__tokens")))
    supply = slim.groupBy(*LEVELS).agg(F.sum("__tokens").alias("supply"))
    passes = F.when(F.col("supply") > 0, F.floor(F.col("share") / F.col("supply"))).otherwise(0).cast("bigint")
    leaves = stored(leaf_budgets(supply, weights, budget_share, max_epochs)
                    .withColumn("epochs", passes)
                    .withColumn("rest", F.col("share") - F.col("epochs") * F.col("supply")))
    size = measured_bytes(leaves)  # one row per leaf, broadcast only while they are small together
    open_leaves = broadcast_if(leaves.where("rest > 0").select(*LEVELS, "epochs", "rest"), size, MAX_BROADCAST_BYTES)
    hashed = (slim.join(open_leaves, list(LEVELS))
              .withColumn("__h", order_hash(seed, F.col("epochs") + 1, F.col("__key")))
              .withColumn("__bin", F.substring("__h", 1, BIN_DIGITS)))
    upto = Window.partitionBy(*LEVELS).orderBy("__bin")
    bins = (hashed.groupBy(*LEVELS, "__bin").agg(F.sum("__tokens").alias("__n"), F.max("__h").alias("__last"))
            .withColumn("__sum", F.sum("__n").over(upto)))
    bins = stored(bins.join(open_leaves.drop("epochs"), list(LEVELS)))
    whole = (bins.where("__sum <= rest").groupBy(*LEVELS).agg(F.max("__last").alias("__cut1")))
    edge = (bins.where("__sum > rest and __sum - __n <= rest")
            .select(*LEVELS, "__bin", (F.col("rest") - F.col("__sum") + F.col("__n")).alias("__left")))
    edge = broadcast_if(edge, size, MAX_BROADCAST_BYTES)
    inside = Window.partitionBy(*LEVELS).orderBy("__h")
    part = (hashed.drop("rest").join(edge, [*LEVELS, "__bin"])
            .groupBy(*LEVELS, "__h", "__left").agg(F.sum("__tokens").alias("__n"))
            .withColumn("__sum", F.sum("__n").over(inside)).where("__sum <= __left")
            .groupBy(*LEVELS).agg(F.max("__h").alias("__cut2")))
    return (leaves.join(whole, list(LEVELS), "left").join(part, list(LEVELS), "left")
            .withColumn("cut", F.greatest(F.coalesce("__cut1", F.lit("")), F.coalesce("__cut2", F.lit(""))))
            .select(*LEVELS, "supply", "share", "epochs", "cut"))


def _path(domain: Column, lang_col: str, source_col: str) -> list[Column]:
    unknown = F.lit("unknown")
    return [F.coalesce(domain, unknown).alias(DOMAIN), F.coalesce(F.col(lang_col), unknown).alias(LANG),
            F.coalesce(F.col(source_col), unknown).alias(SOURCE)]


def mix(docs: DataFrame, domain: Column, weights: Mapping[tuple, float], budget_share: float = 1.0,
        max_epochs: int = 2, seed: int = 7, key_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", source_col: str = "source", epoch_col: str = "epoch") -> DataFrame:
    """The chosen rows of ``docs``, once per epoch they are read in (``epoch_col`` from 1).

    ``domain`` is a column expression over ``docs``; ``weights`` maps node
    paths ((domain,), (domain, lang) or (domain, lang, source); '*' for any
    part) to weights; the budget is ``budget_share`` of all tokens.
    """
    columns = [c for c in docs.columns if c != epoch_col]
    leaves = stored(plan(docs, domain, weights, budget_share, max_epochs, seed, key_col, text_col,
                         lang_col, source_col))
    # names of its own: the input may have columns named like the plan's
    slim = leaves.select(*LEVELS, F.col("epochs").alias("__epochs"), F.col("cut").alias("__cut"))
    leaves = broadcast_if(slim, measured_bytes(leaves), MAX_BROADCAST_BYTES)
    path = _path(domain, lang_col, source_col)
    rows = docs.select(*columns, *path).join(leaves, list(LEVELS))
    inside = order_hash(seed, F.col("__epochs") + 1, F.col(key_col)) <= F.col("__cut")
    extra = F.when((F.col("__cut") != "") & inside, 1)
    last = F.col("__epochs") + F.coalesce(extra, F.lit(0))
    return (rows.withColumn("__upto", last).where("__upto > 0")
            .withColumn(epoch_col, F.explode(F.sequence(F.lit(1), F.col("__upto").cast("int"))))
            .select(*columns, *LEVELS, epoch_col))

"""Connected components of a graph of links, as joins and aggregates.

Every round each node that still has links hooks to the smallest of itself and its neighbours under an order that
is hashed anew, links are mapped to the hooks, and loops and repeats disappear. A hashed order contracts
any graph -- chains, stars, dense groups -- by a constant share a round, so rounds grow with the logarithm of
the nodes. Nothing is collected; a hot node is a partial minimum when hooking and a skewed join when mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import store


def component_labels(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (columns u, v): nodes share a label if and only if they are
    connected. Nodes without links to another node have no row."""
    links = store(links.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    hooks: list[DataFrame] = []
    while not links.isEmpty():
        salt = F.lit(len(hooks))
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = F.min(F.struct(F.xxhash64("v", salt), F.col("v")))["v"]
        own = F.xxhash64("u", salt)
        hook = (both.groupBy("u").agg(best.alias("w"))
                .select(F.col("u").alias("node"), F.when(F.struct(own, F.col("u")) < F.struct(F.xxhash64("w", salt), F.col("w")),
                                                         F.col("u")).otherwise(F.col("w")).alias("hook")))
        hook = store(hook)
        hooks.append(hook)
        for side in ("u", "v"):
            links = links.join(hook.select(F.col("node").alias(side), F.col("hook").alias(f"to_{side}")), side).drop(side)
        links = store(links.filter("to_u != to_v").select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).distinct())
    if not hooks:
        return links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = hooks[-1].select("node", F.col("hook").alias("label"))
    for hook in reversed(hooks[:-1]):
        later = labels.select(F.col("node").alias("hook"), "label")
        labels = hook.join(later, "hook", "left").select("node", F.coalesce("label", "hook").alias("label"))
    return labels

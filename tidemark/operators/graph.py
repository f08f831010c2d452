"""Nested holdings, groups of overlapping lines, and names that mean the same entity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.checkpoint import saved
from tidemark.functions.core import safe_div
from tidemark.functions.text import name_norm, trigrams

#: Rows of a graph, each link both ways, that one task unites: 16 MB of numbers.
SMALL = 1_000_000


def look_through(holdings: DataFrame, depth: int = 4) -> DataFrame:
    """Holdings of holdings down to a depth: root, held, depth, weight (product of value over NAV) and block.

    ``holdings``: root, held, value. A holding's own NAV is the sum of its values. Rows that end an expansion say why:
    ``cycle`` (already on the path), ``unfiled`` (no holdings of its own), ``depth_cap``; others are ``fund``. One join per
    level; a level's rows are checkpointed so that the plan doesn't grow.
    """
    nav = holdings.groupBy("root").agg(F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("_nav"))
    edges = saved(holdings.join(nav, "root").select("root", "held", safe_div("value", "_nav").alias("_share")))
    filed = nav.select(F.col("root").alias("held"), F.lit(True).alias("_filed"))
    rows = edges.select("root", "held", F.lit(1).alias("depth"), F.col("_share").alias("weight"), F.array("root").alias("_path"))
    out = []
    for level in range(1, depth + 1):
        block = F.when(F.array_contains("_path", F.col("held")), "cycle").when(F.col("_filed").isNull(), "unfiled").when(F.col("depth") == depth, "depth_cap").otherwise("fund")
        rows = saved(rows.join(filed, "held", "left").withColumn("block", block).drop("_filed"))
        out.append(rows.select("root", "held", "depth", "weight", "block"))
        if level < depth:
            below = edges.select(F.col("root").alias("_at"), F.col("held").alias("_next"), "_share")
            rows = rows.filter("block = 'fund'").join(below, F.col("held") == F.col("_at")).select("root", F.col("_next").alias("held"), (F.col("depth") + 1).alias("depth"), (F.col("weight") * F.col("_share")).alias("weight"), F.array_append("_path", F.col("held")).alias("_path"))
    return reduce(DataFrame.unionByName, out)


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each reaches) of a graph in memory."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        for side in (left, right):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it reaches) of an undirected graph (a, b).

    By smallest labels and shortcuts, round by round; a graph of SMALL rows at most, which is counted, takes one task
    instead, since each round costs several shuffles."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), forget=True)
    if both.count() <= SMALL:
        kind = both.schema["a"].dataType.simpleString()

        def told(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = list(it)
            if parts:
                whole = pd.concat(parts)
                nodes, roots = united(whole["a"].to_numpy(), whole["b"].to_numpy())
                yield pd.DataFrame({"node": nodes, "root": roots})

        return saved(both.coalesce(1).mapInPandas(told, f"node {kind}, root {kind}"), forget=True)
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), forget=True)
    while True:
        # tables are merged: written ones look small enough for a copy to each executor, every round anew by way of the driver
        near = both.join(labels.select(F.col("node").alias("b"), "root").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        step = labels.join(near.hint("merge"), "node").select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        moved = saved(step.join(up.hint("merge"), "root", "left").select("node", "_old", F.least("root", "_up").alias("root")), forget=True)
        labels = moved.select("node", "root")
        if moved.filter("_old <> root").isEmpty():
            return labels


def overlap_groups(lines: DataFrame, line: str, key: str) -> DataFrame:
    """Lines that share a key, transitively: line, component (the smallest line). Each key links its lines to its smallest
    line, so a key that very many lines share makes no pairs."""
    first = lines.groupBy(key).agg(F.min(line).alias("a"))
    stars = lines.join(first, key).select("a", F.col(line).alias("b")).distinct()
    found = components(stars)
    return lines.select(line).distinct().join(found.hint("merge"), F.col(line) == F.col("node"), "left").select(line, F.coalesce("root", line).alias("component"))


def resolve_names(asked: DataFrame, known: DataFrame, least: float = 0.25, top: int = 5, gap: float = 0.05) -> DataFrame:
    """Known names for each asked name by trigram similarity: asked, name, score, rank, is_ambiguous.

    ``asked`` and ``known``: name. A similar pair shares one of the rarest trigrams of both (prefix filter), so only those
    are joined; the score is then exact. Ranks go by score, then name. Ambiguous: the second score is within ``gap``.
    """
    grams = lambda df, into: df.select(F.col("name").alias(into), trigrams(name_norm("name")).alias(f"{into}_grams")).filter(F.size(f"{into}_grams") > 0).distinct()
    a, b = grams(asked, "asked"), grams(known, "name")
    frequency = b.select(F.explode("name_grams").alias("g")).groupBy("g").agg(F.count("*").alias("df"))

    def prefix(df: DataFrame, into: str) -> DataFrame:
        each = df.select(into, F.size(f"{into}_grams").alias("n"), F.explode(f"{into}_grams").alias("g")).join(frequency, "g", "left")
        order = Window.partitionBy(into).orderBy(F.coalesce("df", F.lit(0)), "g")
        return each.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(into, "g")

    pairs = prefix(a, "asked").join(prefix(b, "name"), "g").select("asked", "name").distinct()
    both = F.size(F.array_intersect("asked_grams", "name_grams"))
    scored = pairs.join(a, "asked").join(b, "name").select("asked", "name", (both / (F.size("asked_grams") + F.size("name_grams") - both)).alias("score")).filter(F.col("score") >= least)
    order = Window.partitionBy("asked").orderBy(F.col("score").desc(), "name")
    ranked = scored.withColumns({"rank": F.row_number().over(order), "_second": F.lead("score").over(order)}).filter(F.col("rank") <= top)
    best = F.max(F.when(F.col("rank") == 1, F.coalesce(F.col("score") - F.col("_second") < gap, F.lit(False)))).over(Window.partitionBy("asked"))
    return ranked.withColumn("is_ambiguous", best).drop("_second")


def lookup(names: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Names that hold every word of a query (accents folded): exact first, then beginning with it, then others."""
    norm = name_norm("name")
    words = [w for w in query.lower().split() if w]
    held: Column = F.lit(True)
    for w in words:
        held = held & norm.contains(w)
    whole = " ".join(words)
    rank = F.when(norm == whole, 1).when(norm.startswith(whole), 2).otherwise(3)
    return names.filter(held).withColumn("class", rank).orderBy("class", "name").limit(limit)

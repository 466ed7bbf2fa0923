"""Connected components as Spark joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.session import cut_lineage

# Every round writes its tables: few links need few files.
LINKS_PER_PART = 100_000
# A key is hot if more than one of so many rows has it, so there are fewer hot keys than this.
HOT_SHARE = 200


def gathered(df: DataFrame, rows: int = LINKS_PER_PART) -> tuple[DataFrame, int]:
    """``df`` materialised, in as many parts as its rows fill at ``rows`` each, and the number of its rows.

    A table of a few thousand rows then takes a task or two a step, however many
    parts shuffles have; what is in one part needs no shuffle at all.
    """
    df = cut_lineage(df)
    n = df.count()
    return df.coalesce(-(-n // rows) or 1), n


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one in HOT_SHARE of the rows has: a table of fewer than HOT_SHARE rows, whatever the input."""
    counted = rows.groupBy(key).count()
    total = rows.agg(F.count("*").alias("total"))
    return cut_lineage(counted.join(F.broadcast(total), F.col("count") * HOT_SHARE > F.col("total")).select(key).coalesce(1))


def looked_up(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key.

    Rows with hot keys stay where they are and get their row by broadcast; only
    the others, of which no key has many, are shuffled by the key. Without
    ``hot``, the table is known to be small and broadcast whole.
    """
    if hot is None:
        return rows.join(F.broadcast(table), key)
    hot = F.broadcast(hot)
    few = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(hot, key, "left_anti").join(table, key))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node with a link.

    Each round finds the smallest label among a node's neighbours and gives it to
    the node and to the node its own label names, through which it reaches all
    that have that label; so the number of rounds grows with the logarithm of
    the number of nodes. Labels that many nodes have, and nodes with very many
    links, are looked up by broadcast; aggregates combine before the shuffle. Empty links give an empty table; repeated links and self-links are
    harmless; rows with a null end are ignored.
    """
    pairs, n = gathered(links.select(F.col(a).alias("node"), F.col(b).alias("other")).na.drop().where("node <> other"))
    if not n:
        return pairs.selectExpr("node", "other AS component")
    edges = cut_lineage(pairs.selectExpr("inline(array(struct(node, other), struct(other AS node, node AS other)))").distinct())
    parts = -(-edges.count() // LINKS_PER_PART) or 1
    edges = edges.coalesce(parts)

    def kept(df: DataFrame) -> DataFrame:
        return cut_lineage(df.coalesce(parts))

    # The nodes of one part are at most LINKS_PER_PART, 16 bytes each: small enough to broadcast.
    small = parts == 1
    hubs = None if small else hot_keys(edges, "other")
    labels = kept(edges.groupBy("node").agg(F.min("other").alias("low")).selectExpr("node", "least(node, low) AS label"))
    while True:
        of_label = labels.selectExpr("node AS label", "label AS next")
        hot = None if small else hot_keys(labels, "label")
        jumped = looked_up(labels, of_label, "label", hot).selectExpr("node", "next AS label")
        jumped = jumped if small else kept(jumped)
        around = looked_up(edges, jumped.withColumnRenamed("node", "other"), "other", hubs).groupBy("node").agg(F.min("label").alias("low"))
        seen = kept(jumped.join(around, "node").select("node", "label", "low"))
        moved = seen.where("low < label")
        if moved.isEmpty():
            # No neighbour has a smaller label: all labels of a component agree.
            return seen.select("node", F.col("label").alias("component"))
        hooks = moved.groupBy("label").agg(F.min("low").alias("lowest")).withColumnRenamed("label", "node")
        labels = kept(seen.join(hooks, "node", "left").select("node", F.least("label", "low", "lowest").alias("label")))


def spanning(met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connect the rows and columns of a block as its marks do, with one link each instead of all marks.

    Returns for each row a column it belongs with, or the number of columns if
    the row has no mark, and for each column the lowest column of its group.
    """
    columns = met.shape[1]
    label = np.arange(columns)
    while True:
        of_row = np.where(met, label, columns).min(axis=1, initial=columns)
        lowered = np.minimum(label, np.where(met, of_row[:, None], columns).min(axis=0, initial=columns))
        if (lowered == label).all():
            return of_row, label
        label = lowered

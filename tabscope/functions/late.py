"""Groups of texts by hash, with the texts of a few chosen groups fetched at the end.

Grouping by the text itself would shuffle every different text whole. Here a
text is two hashes of 64 bits (two texts share both with a chance of about
2**-128) and its first characters, which order all but the texts that begin
alike. Choices are made on these; only where a chosen text is longer than its
beginning are the rows read again, and then only chosen texts leave their task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.columns import ref
from tabscope.session import cut_lineage

# Characters of a text that travel with its hashes.
BEGINNING = 32
# Chosen groups that are sent to every task; beyond that the rows are shuffled to them.
BROADCAST_GROUPS = 500_000
KEYS = ["column", "h", "g"]


def text_rows(df: DataFrame, columns: dict[str, Column], *others: str) -> DataFrame:
    """``column``, ``value``, its hashes ``h`` and ``g``, ``beginning`` and ``long``, beside the ``others``; missing values are left out.

    Not `unpivot`: plans with it are not recognised as equal, and a shuffle could not be reused.
    """
    pairs = [F.struct(F.lit(name).alias("column"), value.alias("value")) for name, value in columns.items()]
    v = F.col("value")
    return df.select(*[ref(o) for o in others], F.inline(F.array(*pairs))).filter(v.isNotNull()).select(
        *[ref(o) for o in others], "column", "value", F.xxhash64(v).alias("h"), F.xxhash64(F.lit("second"), v).alias("g"),
        F.substring(v, 1, BEGINNING).alias("beginning"), (F.length(v) > BEGINNING).alias("long"),
    )


def grouped(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """One row per column and different text, with the given aggregates; no text is shuffled beyond its beginning.

    What depends on the text is among the keys, as sums by hash hold no text.
    """
    return rows.groupBy(*KEYS, "beginning", "long").agg(*aggregates)


def with_values(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """The chosen groups with their texts as ``value``, in place of hashes and beginnings.

    The choice is made first. If no chosen text is longer than its beginning,
    the rows are not read again.
    """
    chosen = cut_lineage(chosen)
    bare = [c for c in chosen.columns if c not in (*KEYS, "beginning", "long")]
    short = chosen.filter(~F.col("long")).select("column", F.col("beginning").alias("value"), *[ref(c) for c in bare])
    wanted = chosen.filter("long")
    n = wanted.count()
    if not n:
        return short
    keys = wanted.select(*KEYS)
    # Equal texts of a task become one before they leave it.
    met = rows.filter("long").join(F.broadcast(keys) if n <= BROADCAST_GROUPS else keys, KEYS, "left_semi")
    texts = cut_lineage(met.groupBy(*KEYS).agg(F.min("value").alias("value")))
    return short.unionByName(wanted.join(texts, KEYS).select("column", "value", *[ref(c) for c in bare]))

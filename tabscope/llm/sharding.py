"""Shards by extendible hashing. DataFrame functions only.

A directory is indexed by the first bits of a hash. A bucket over the byte
limit is split on its next bit, and only such buckets are; the shard of a row
is the shortest prefix of its hash whose bucket fits. Sums are taken once at a
depth that most shards do not reach, and rolled up from there; only rows of
buckets that do not fit even then are summed again at further bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.session import cut_lineage

HASH_BITS = 60
FURTHER_BITS = 6


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 over a row's id and text; rows without an id are spread by their texts."""
    key = F.md5(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.encode(text, "UTF-8"))), "UTF-8"))
    return F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def prefix(depth: int) -> Column:
    return F.shiftright("hash", HASH_BITS - depth)


def _leaves(sums: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """For each prefix of ``depth`` bits, the shortest depth over ``above`` whose bucket fits, or null.

    Returns ``prefix``, ``shard_depth``, ``shard_bytes``.
    """
    ways = sums.select("prefix", "bytes", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("d"))
    ways = ways.withColumn("bucket", F.expr(f"shiftright(prefix, {depth} - d)"))
    buckets = ways.groupBy("d", "bucket").agg(F.sum("bytes").alias("bucket_bytes"))
    fits = F.col("bucket_bytes") <= limit
    # With all bits used a bucket stays whole, whatever its size.
    buckets = buckets.where(fits | F.lit(depth == HASH_BITS) & (F.col("d") == depth))
    found = ways.select("prefix", "d", "bucket").join(buckets, ["d", "bucket"]).groupBy("prefix")
    found = found.agg(F.min(F.struct("d", "bucket_bytes")).alias("s"))
    return sums.select("prefix").join(found, "prefix", "left").selectExpr("prefix", "s.d AS shard_depth", "s.bucket_bytes AS shard_bytes")


def assign(docs: DataFrame, byte_limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``bytes``, ``shard``, ``shard_depth``, ``shard_bytes``, ``oversized``.

    ``shard`` is the bucket's hash prefix in binary, empty if all rows fit into
    one. Bytes are those of the text in UTF-8, none for a null. ``oversized``
    marks buckets over the limit whose rows all have one hash: a single longer
    text, or equal rows. An empty table gives no rows; other columns are ignored.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), hash_of(F.col(doc_id), whole).alias("hash"), F.octet_length(F.encode(whole, "UTF-8")).cast("bigint").alias("bytes"))
    rows = cut_lineage(rows)
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    above, depth = 0, min(HASH_BITS, 3 + max(0, math.ceil(math.log2(max(1, total / byte_limit)))))
    done, rest = None, rows
    while True:
        sums = cut_lineage(rest.groupBy(prefix(depth).alias("prefix")).agg(F.sum("bytes").alias("bytes")))
        leaves = cut_lineage(_leaves(sums, above, depth, byte_limit))
        met = rest.join(leaves.withColumnRenamed("prefix", "_prefix"), prefix(depth) == F.col("_prefix")).drop("_prefix")
        settled = met.where("shard_depth IS NOT NULL")
        done = settled if done is None else done.unionByName(settled)
        if leaves.where("shard_depth IS NULL").isEmpty():
            break
        rest = cut_lineage(met.where("shard_depth IS NULL").select("doc_id", "hash", "bytes"))
        above, depth = depth + 1, min(HASH_BITS, depth + FURTHER_BITS)
    name = F.expr(f"substring(lpad(bin(hash), {HASH_BITS}, '0'), 1, shard_depth)").alias("shard")
    return done.select("doc_id", "bytes", name, "shard_depth", "shard_bytes", (F.col("shard_bytes") > byte_limit).alias("oversized"))

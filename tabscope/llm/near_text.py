"""Near duplicates of texts by b-bit MinHash.

Minima of 128 hash functions over a text's word shingles make 32 band keys;
texts that share a key are candidates. Of each minimum only four bits are kept,
packed sixteen to a 64-bit word. Differing nibbles of two packed signatures are
counted, and the share that agrees by chance (one in sixteen) is taken off; this
estimate discards candidates far below the threshold. Those that stay are
confirmed on the full shingle sets.

At a similarity of 0.75, a pair shares no band with a chance of 5e-6, and is
discarded by the estimate, five standard deviations below, with one of 1e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.graph import LINKS_PER_PART, components, gathered, spanning
from tabscope.llm.words import as_bytes, chunks, mix, record_batches, shingle_sets
from tabscope.session import cut_lineage

BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
PER_WORD = 64 // BITS
PACKED = MINIMA // PER_WORD
ROWS_AT_ONCE = 1024
SHINGLES_AT_ONCE = 2048
COLUMNS_AT_ONCE = 2048
# A block of members of a zone: so many texts, or so many shingles, on average.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1 << 20
# Classes of a bucket are compared by a join while it has few of them, else in blocks of signatures inside tasks.
FEW, BLOCK_SIGNATURES, STRIP = 64, 4096, 256
# A block with more candidate pairs than this for each of its members is compared on full sets as a whole.
PAIRS_PER_MEMBER = 4
# 16 bytes each in the broadcast table, or 24.
BROADCAST_IDS = 1_000_000
# Rows of longer tables that are broadcast: blocks, digests.
BROADCAST_ROWS = 100_000
# Rows of one part of a table that holds signatures, and pairs that one task confirms, if shuffles have more parts than that takes.
SIGNATURES_PER_PART, PAIRS_PER_TASK = 8192, 256

_draw = np.random.default_rng(20)
_FACTORS = _draw.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def minima_of(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a non-empty set."""
    lowest = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), SHINGLES_AT_ONCE):
        block = shingles[start : start + SHINGLES_AT_ONCE, None] * _FACTORS + _SHIFTS
        np.minimum(lowest, block.min(axis=0), out=lowest)
    return lowest


def pack(minima: np.ndarray) -> np.ndarray:
    """Low bits of rows of minima, PER_WORD to a 64-bit word."""
    low = (mix(minima) & np.uint64((1 << BITS) - 1)).reshape(*minima.shape[:-1], PACKED, PER_WORD)
    places = np.arange(PER_WORD, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low << places, axis=-1)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One key for each band of full minima; keys of different bands differ."""
    bands = minima.reshape(*minima.shape[:-1], BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:-1])
    for row in range(ROWS):
        keys = mix(keys + bands[..., row])
    return keys


def similarity_estimate(a: Column, b: Column) -> Column:
    """Jaccard similarity from two packed signatures, corrected for chance agreement."""
    differing = F.lit(0)
    for place in range(PACKED):
        bits = a[place].bitwiseXOR(b[place])
        any_bit = bits
        for shift in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(bits, shift))
        differing = differing + F.bit_count(any_bit.bitwiseAND(F.lit(int("0001" * PER_WORD, 2))))
    chance = 2.0**-BITS
    return (1 - differing / F.lit(float(MINIMA)) - chance) / (1 - chance)


def similar(first: list[np.ndarray], second: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of one list are similar enough to which of the other, by products of their incidence matrices."""
    codes = np.intersect1d(np.concatenate([*first, np.zeros(0, np.uint64)]), np.concatenate([*second, np.zeros(0, np.uint64)]))
    same = np.zeros((len(first), len(second)))
    for start in range(0, len(codes), COLUMNS_AT_ONCE):
        some = codes[start : start + COLUMNS_AT_ONCE]
        sides = []
        for sets in (first, second):
            side = np.zeros((len(sets), len(some)), np.float32)
            for row, own in enumerate(sets):
                side[row, np.searchsorted(some, own[np.isin(own, some, assume_unique=True)])] = 1
            sides.append(side)
        same += sides[0] @ sides[1].T
    union = np.array([len(s) for s in first])[:, None] + np.array([len(s) for s in second])[None, :] - same
    return (union > 0) & (100 * same >= percent * union)


def beside(table: DataFrame, n: int, most: int) -> DataFrame:
    """``table`` to be joined with: broadcast if its ``n`` rows are no more than ``most``, so that the other side stays where it is."""
    return F.broadcast(table) if n <= most else table


def dealt(members: DataFrame, group: str, rows: int, shingles: int | None = None) -> DataFrame:
    """Members of each group dealt to pairs of blocks, so that tasks compare a block with a block.

    One side of a pair (``side`` 0, block ``low``) holds members outside the
    group's largest label, the other (``side`` 1, block ``high``) any members:
    members of the largest label never meet each other. Blocks have some ``rows``
    members, or some ``shingles`` of their column ``n``, on average; rows are
    copied once for each block they meet. Groups of one label give none.
    """
    by_label = members.groupBy(group, "label").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    facts = by_label.groupBy(group).agg(
        F.max_by("label", F.struct("size", "label")).alias("main"),
        F.max("size").alias("largest"),
        F.sum("size").alias("size"),
        F.sum("n").alias("n"),
    )
    full = F.col("size") / rows if shingles is None else F.greatest(F.col("size") / rows, F.col("n") / shingles)
    facts = facts.where("largest < size").withColumn("all_blocks", F.ceil(full).cast("int"))
    facts = facts.withColumn("rest_blocks", F.ceil(F.col("all_blocks") * (F.col("size") - F.col("largest")) / F.col("size")).cast("int"))
    facts, n = gathered(facts.select(group, "main", "all_blocks", "rest_blocks"))
    placed = members.join(beside(facts, n, BROADCAST_ROWS), group)
    place = F.xxhash64("rep")
    sides = []
    for side, own, own_blocks, others, other_blocks in ((0, "low", "rest_blocks", "high", "all_blocks"), (1, "high", "all_blocks", "low", "rest_blocks")):
        some = placed.where("label <> main") if side == 0 else placed
        some = some.withColumns({"side": F.lit(side), own: F.pmod(place, F.col(own_blocks)).cast("int")})
        sides.append(some.withColumn(others, F.explode(F.expr(f"sequence(0, {other_blocks} - 1)"))).drop("all_blocks", "rest_blocks"))
    return sides[0].unionByName(sides[1])


def _sides(rows: pd.DataFrame) -> list[np.ndarray]:
    side = rows["side"].to_numpy()
    return [np.flatnonzero(side == which) for which in (0, 1)]


def _to_meet(rows: pd.DataFrame, sides: list[np.ndarray]) -> np.ndarray:
    """Which rows of one side have another label than which of the other; of two that meet twice, once."""
    rep, label, main = (rows[c].to_numpy() for c in ("rep", "label", "main"))
    a, b = sides[0][:, None], sides[1][None, :]
    return (label[a] != label[b]) & ((label == main)[b] | (rep[a] < rep[b]))


def _spanning_links(rep: np.ndarray, sides: list[np.ndarray], met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what the marks connect."""
    of_row, lowest = spanning(met)
    met_rows, moved = of_row < len(sides[1]), lowest < np.arange(len(sides[1]))
    a = np.concatenate([rep[sides[0]][met_rows], rep[sides[1]][moved]])
    b = rep[sides[1]][np.concatenate([of_row[met_rows], lowest[moved]])]
    return a, b


def links_within(zones: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members of one zone that have different labels, as many as connect what all of them connect.

    ``zones`` has ``zone``, ``rep``, ``label`` and the set size ``n``. Full sets
    are compared in blocks of members, so neither the pairs of a large zone nor
    its members ever come together in one task.
    """
    blocks, n = gathered(dealt(zones, "zone", BLOCK_TEXTS, BLOCK_SHINGLES))
    if not n:
        return blocks.selectExpr("rep AS a", "rep AS b")
    texts = texts_of(blocks.selectExpr("rep AS id"), docs, doc_id, text)
    blocks = texts.withColumnRenamed("id", "rep").join(beside(blocks, n, BROADCAST_ROWS), "rep")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sets = [s for _, texts in chunks([t.encode() for t in rows["text"]]) for s in shingle_sets(texts, width)]
        sides = _sides(rows)
        met = similar([sets[i] for i in sides[0]], [sets[i] for i in sides[1]], percent) & _to_meet(rows, sides)
        a, b = _spanning_links(rows["rep"].to_numpy(), sides, met)
        return pd.DataFrame({"a": a, "b": b})

    return blocks.groupBy("zone", "low", "high").applyInPandas(compare, "a bigint, b bigint")


def likely_in_blocks(inside: DataFrame, percent: int, slack: float) -> DataFrame:
    """Pairs (a, b) of different labels and zones in a bucket that pass the estimate, by packed signatures in blocks.

    ``dense`` pairs stand for blocks with more such pairs than PAIRS_PER_MEMBER
    for each member: they connect what all of those connect, and whoever they
    connect is yet to be compared. So no task gives more than a few pairs a member.
    """
    lows = np.uint64(int("0001" * PER_WORD, 2))
    chance = 2.0**-BITS
    passes = (1 - np.arange(MINIMA + 1) / float(MINIMA) - chance) / (1 - chance) >= percent / 100 - slack

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = _sides(rows)
        packed = np.array(rows["s"].tolist(), dtype=np.int64).view(np.uint64).reshape(-1, PACKED)
        n, zone, rep = (rows[c].to_numpy() for c in ("n", "zone", "rep"))
        strips = []
        for start in range(0, len(sides[0]), STRIP):
            some = sides[0][start : start + STRIP]
            differing = np.zeros((len(some), len(sides[1])), np.uint8)
            for place in range(PACKED):
                bits = packed[some, place][:, None] ^ packed[sides[1], place][None, :]
                bits |= bits >> np.uint64(1)
                bits |= bits >> np.uint64(2)
                differing += np.bitwise_count(bits & lows)
            size_a, size_b = n[some][:, None], n[sides[1]][None, :]
            alike = passes[differing] & (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b))
            strips.append(alike & (zone[some][:, None] != zone[sides[1]][None, :]) & _to_meet(rows, [some, sides[1]]))
        met = np.concatenate([np.zeros((0, len(sides[1])), bool), *strips])
        dense = met.sum() > PAIRS_PER_MEMBER * len(rows)
        if dense:
            a, b = _spanning_links(rep, sides, met)
        else:
            first, second = np.nonzero(met)
            a, b = rep[sides[0][first]], rep[sides[1][second]]
        return pd.DataFrame({"a": a, "b": b, "dense": bool(dense)})

    return dealt(inside, "key", BLOCK_SIGNATURES).groupBy("key", "low", "high").applyInPandas(meet, "a bigint, b bigint, dense boolean")


SIGNED = "doc_id bigint, n_shingles bigint, digest binary, signature array<bigint>, bands array<bigint>"


def signatures(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Set size, set digest, packed signature and band keys of each row."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_shingles", pa.int64()),
            ("digest", pa.binary()),
            ("signature", pa.list_(pa.int64())),
            ("bands", pa.list_(pa.int64())),
        ]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches, ROWS_AT_ONCE):
            sizes, digests, lows = [], [], []
            for _, texts in chunks(as_bytes(batch.column(1))):
                for found in shingle_sets(texts, width):
                    sizes.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    lows.append(minima_of(found))
            minima = np.array(lows).reshape(-1, MINIMA)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())]
            for rows in (pack(minima), band_keys(minima)):
                flat = pa.array(np.ascontiguousarray(rows).view(np.int64).ravel())
                arrays.append(pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], flat))
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(sign, SIGNED)


def texts_of(ids: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id`` and ``text`` of the documents named in ``ids``.

    While the ids are few enough to be broadcast, only their texts leave the
    scan; beyond that number both sides are shuffled.
    """
    wanted, n = gathered(ids.distinct())
    every = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return cut_lineage(every.join(beside(wanted, n, BROADCAST_IDS), "id", "left_semi"))


def confirmed(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets are similar enough."""
    pairs, n = gathered(pairs)
    if not n:
        return pairs
    texts = texts_of(pairs.selectExpr("explode(array(a, b)) AS id"), docs, doc_id, text)
    both = texts.selectExpr("id AS a", "text AS text_a").join(beside(pairs, n, BROADCAST_IDS), "a")
    both = both.join(texts.selectExpr("id AS b", "text AS text_b"), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in record_batches(batches, 256):
            keep = []
            second = as_bytes(batch.column(3))
            others = [s for _, texts in chunks(second) for s in shingle_sets(texts, width)]
            for first, other in zip(as_bytes(batch.column(2)), others, strict=True):
                if first != last[0]:
                    last = (first, next(shingle_sets([first], width)))
                same = len(np.intersect1d(last[1], other, assume_unique=True))
                union = len(last[1]) + len(other) - same
                keep.append(union > 0 and 100 * same >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    # Pairs come sorted by b, which is a hub that many share: its set is made once.
    return both.select("a", "b", "text_b", "text_a").coalesce(-(-n // PAIRS_PER_TASK)).mapInArrow(confirm, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, slack: float = 0.2) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * intersection >= percent * union of their
    distinct word shingles; ``component_id`` is the smallest id reachable by
    links, ``kept`` says whether it is the document's own.

    Equal sets are folded into one class first. A bucket (all classes with one
    band key) never becomes pairs of all its members:

    1. Each member is compared with the bucket's hub, the one that meets most
       others in all its buckets, and its likeliest such pair is confirmed.
    2. What hubs hold together by the estimate is a zone. Members of a zone that
       are not yet connected are compared on their full sets, in blocks.
    3. Members of a bucket in different zones and components are compared by the
       estimate, those of the bucket's largest component only with the rest: by a
       join in buckets of a few members, else by signatures in blocks, inside
       tasks. Pairs that pass are confirmed; where they are many for the members
       of a block, what they connect is a zone and compared like one.

    Every pair that shares a band and passes the estimate is thus either
    confirmed, refused on the full sets, or already connected. Texts of one
    template below the threshold take time with the square of their number; what
    is shuffled for them grows with their number, times the number of blocks of
    512 texts or 4096 signatures, and pairs are emitted in proportion to members.

    Null or empty texts, and texts without words, have an empty set and link
    with nothing. Rows that repeat an id are one document. Rows with a null id
    are kept, with a null component. Other columns are ignored.
    """
    signed = cut_lineage(signatures(docs, doc_id, text, width))
    folded = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
    folded = folded.agg(F.min(F.struct("doc_id", "n_shingles", "signature", "bands")).alias("c"))
    classes = folded.selectExpr("digest", "c.doc_id AS rep", "c.n_shingles AS n", "c.signature AS s", "c.bands AS bands")
    classes, n_classes = gathered(classes, SIGNATURES_PER_PART)

    def by_class(df: DataFrame) -> DataFrame:
        """A short row for some classes, in parts in proportion to their number."""
        parts = -(-n_classes // LINKS_PER_PART) or 1
        return cut_lineage(df.coalesce(parts)).coalesce(parts)

    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("size"))
    members, _ = gathered(banded.join(shared.where("low < high").select("key", "size"), "key"))
    weights = by_class(members.groupBy("rep").agg(F.sum("size").alias("weight")))
    hubs = members.join(beside(weights, n_classes, BROADCAST_IDS), "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub"))
    spokes = members.join(hubs, "key").where("rep <> hub").selectExpr("rep AS a", "hub AS b").repartition("a").distinct()

    estimate = similarity_estimate(F.col("s_a"), F.col("s_b"))
    likely = (estimate >= percent / 100 - slack) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    side_a = classes.selectExpr("rep AS a", "n AS n_a", "s AS s_a")
    side_b = classes.selectExpr("rep AS b", "n AS n_b", "s AS s_b")
    stars = spokes.join(side_a, "a").join(side_b, "b").where(likely)
    stars, _ = gathered(stars.select("a", "b", estimate.alias("estimate")))
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b"))
    links = cut_lineage(confirmed(best, docs, doc_id, text, width, percent))

    first = components(links).withColumnRenamed("node", "rep")
    zoned = components(stars).withColumnRenamed("node", "rep").withColumnRenamed("component", "zone")
    known = by_class(zoned.join(first, "rep", "left").select("rep", "zone", F.coalesce("component", "rep").alias("label")))
    sizes = by_class(classes.select("rep", "n"))
    links = links.unionByName(cut_lineage(links_within(by_class(known.join(sizes, "rep")), docs, doc_id, text, width, percent)))

    own = F.coalesce("zone", "rep").alias("zone"), F.coalesce("label", "rep").alias("label")
    labelled = cut_lineage(members.join(beside(known, n_classes, BROADCAST_IDS), "rep", "left").select("key", "rep", *own))
    counted = labelled.groupBy("key", "label").agg(F.count("*").alias("size")).groupBy("key")
    counted = counted.agg(F.count("*").alias("labels"), F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("size"))
    inside = labelled.join(counted.where("labels > 1").select("key", "main", "size"), "key")
    inside, _ = gathered(inside.join(classes.select("rep", "n", "s"), "rep"), SIGNATURES_PER_PART)
    small = inside.where(F.col("size") <= FEW)
    rest = small.where("label <> main").selectExpr("key", "rep AS a", "n AS n_a", "s AS s_a", "label AS label_a", "zone AS zone_a")
    others = small.selectExpr("key", "rep AS b", "n AS n_b", "s AS s_b", "label AS label_b", "zone AS zone_b", "main")
    across = rest.join(others, "key").where("label_a <> label_b AND zone_a <> zone_b AND (label_b = main OR a < b)").where(likely)
    found = across.select("a", "b")
    large, n_large = gathered(inside.where(F.col("size") > FEW).drop("main", "size"), SIGNATURES_PER_PART)
    if n_large:
        likely_pairs, _ = gathered(likely_in_blocks(large, percent, slack))
        found = found.unionByName(likely_pairs.where("NOT dense").select("a", "b"))
        dense = likely_pairs.where("dense")
        if not dense.isEmpty():
            crowds = components(dense).withColumnRenamed("node", "rep").withColumnRenamed("component", "zone")
            crowds = crowds.join(sizes, "rep").join(known.select("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
            links = links.unionByName(cut_lineage(links_within(by_class(crowds), docs, doc_id, text, width, percent)))
    more = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.unionByName(cut_lineage(confirmed(more, docs, doc_id, text, width, percent)))

    # Rows that repeat an id with other words stand for one document: the id links their classes.
    named = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "digest", F.xxhash64("digest").alias("h"))
    repeated = named.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("doc_id")
    repeated, n_repeated = gathered(repeated)
    if n_repeated:
        every = named.join(beside(repeated, n_repeated, BROADCAST_IDS), "doc_id").join(classes.select("digest", "rep"), "digest")
        links = links.unionByName(every.selectExpr("doc_id AS a", "rep AS b"))
    found = components(links).withColumnRenamed("node", "rep")
    by_digest = classes.join(beside(found, n_classes, BROADCAST_IDS), "rep", "left")
    by_digest = cut_lineage(by_digest.select("digest", F.coalesce("component", "rep").alias("component")))
    return (
        signed.select("doc_id", "n_shingles", "digest")
        .join(beside(by_digest, n_classes, BROADCAST_ROWS), "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )

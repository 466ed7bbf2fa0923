"""Near duplicates of embeddings by product quantisation.

Coarse centroids split the unit vectors into inverted lists; each member keeps
its list, the codes of its residual in several subspaces, and how far the codes
are from it. A query probes the lists that linked vectors can be in, looks up
the distances to the codes in a table of its own, and compares exactly by cosine
what the table, widened by each member's own error, leaves.

All bounds are safe. The table's is widened by the error of the codes. Lists are
ruled out by their radius, and by the plane between their centroid and the
query's own, beyond which all their members are. Before the table, products of
the leading principal coordinates, with the lengths of what they leave out, rule
out most pairs at once. What is left of lists may be most of them in many
dimensions, so vectors are not sent to lists: zones of neighbouring lists are
rows of one table, and each pair of zones that may hold links meets in memory,
read from the one copy on disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tabscope.llm.graph import components, spanning
from tabscope.session import cut_lineage

SUBSPACES, CODES = 8, 64
MOST_LISTS = 1024
FIT_ROWS = 20_000
BLOCK = 8192  # rows of a zone's part at most
BLOCK_CELLS = 1 << 19  # components of a zone's part at most
LEAST_BLOCK, SPREAD = 512, 16  # of fewer rows than BLOCK, so that there are so many parts
BLOCKS_PER_PART = 16
ROWS_AT_ONCE = 128
PAIRS_AT_ONCE = 1 << 16
FEW = 1e-3  # share of pairs that the leading coordinates may leave
ROUNDING = 1e-9


@dataclass(frozen=True)
class Quantiser:
    centroids: np.ndarray  # lists x dimensions
    parts: list[np.ndarray]  # dimensions of each subspace
    books: list[np.ndarray]  # codes x dimensions of the subspace
    axes: np.ndarray  # dimensions x leading principal axes
    gaps: np.ndarray  # lists x lists, distances of their centroids

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each vector, and its distance from the centroid."""
        place = nearest(x, self.centroids)
        return place, np.linalg.norm(x - self.centroids[place], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each residual from what its codes stand for."""
        codes = np.stack([nearest(residuals[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1)
        return codes.astype(np.uint8), np.linalg.norm(residuals - self.decode(codes), axis=1)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Products of each query with all codes: queries x subspaces x codes."""
        out = np.zeros((len(x), len(self.books), CODES))
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out[:, i, : len(b)] = x[:, p] @ b.T
        return out

    def narrow(self, x: np.ndarray) -> np.ndarray:
        """Leading coordinates and the length of the rest; no cosine is above the product of two such rows."""
        leading = x @ self.axes
        rest = np.sqrt(np.maximum(np.square(x).sum(axis=1) - np.square(leading).sum(axis=1), 0))
        return np.concatenate([leading, rest[:, None]], axis=1).astype(np.float32)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squared = np.square(x).sum(axis=1)[:, None] + np.square(y).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(squared, 0))


def nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row of ``y`` nearest to each row of ``x``, some rows at a time."""
    half = np.square(y).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((half - x[i : i + 1024] @ y.T).argmin(axis=1) for i in range(0, len(x), 1024))])


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        place = nearest(x, centres)
        sizes = np.bincount(place, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, place, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def principal(x: np.ndarray, least_cosine: float) -> np.ndarray:
    """So many principal axes that their bound leaves few pairs of a sample, or all."""
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    some = x[:: max(1, len(x) // 1024)]
    leading, n = some @ axes, 32
    while n < x.shape[1]:
        inner, rest = leading[:, :n], np.sqrt(np.maximum(1 - np.square(leading[:, :n]).sum(axis=1), 0))
        if (inner @ inner.T + np.outer(rest, rest) >= least_cosine).sum() - len(some) <= FEW * len(some) ** 2:
            break
        n *= 2
    return axes[:, :n]


def fit(x: np.ndarray, lists: int, least_cosine: float) -> Quantiser:
    centroids = k_means(x, lists)
    parts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
    residuals = x - centroids[nearest(x, centroids)]
    books = [k_means(residuals[:, p], CODES) for p in parts]
    return Quantiser(centroids, parts, books, principal(x, least_cosine), distances(centroids, centroids))


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which of them have a direction."""
    top = np.abs(x).max(axis=1, initial=0)
    good = np.isfinite(top) & (top > 0)
    x = x / np.where(good, top, 1)[:, None]
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(good, norm, 1)[:, None] + 0.0, good


def keyed_vectors(rows: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, str]:
    """``vec_id``, ``dim``, ``key``, a digest of the vector of length 1, and ``raw``, the components; and the kind of these.

    Key and components are null for vectors that link with nothing.
    """
    kind = "f4" if isinstance(getattr(rows.schema[embedding].dataType, "elementType", None), FloatType) else "f8"
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("key", pa.binary()), ("raw", pa.binary())])

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            # Null components become NaN.
            values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            keys, raws = [None] * len(lengths), [None] * len(lengths)
            for length in np.unique(lengths[lengths > 0]):
                which = np.flatnonzero(lengths == length)
                x = values[starts[which][:, None] + np.arange(length)]
                unit, good = unit_rows(x)
                raw = x.astype(kind)
                for i in np.flatnonzero(good):
                    keys[which[i]] = hashlib.blake2b(unit[i].tobytes(), digest_size=16).digest()
                    raws[which[i]] = raw[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], schema=schema)

    narrow = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding"))
    return narrow.mapInArrow(scale, "vec_id bigint, dim int, key binary, raw binary"), kind


def matrix(raw: bytes, dims: np.ndarray, width: int, kind: str) -> np.ndarray:
    """Rows of length 1 from components one after the other, shorter ones filled up with zeros."""
    values = np.frombuffer(raw, kind)
    if len(values) == len(dims) * width:
        return unit_rows(values.reshape(-1, width).astype(np.float64))[0]
    out = np.zeros((len(dims), width))
    out[np.arange(width) < dims[:, None]] = values
    return unit_rows(out)[0]


def zones_of(centroids: np.ndarray, members: np.ndarray, most: int) -> np.ndarray:
    """Zone of each list: neighbours together, halved along their longest axis until a zone has ``most`` members or one list."""
    zone = np.zeros(len(members), np.int64)
    waiting, made = [np.arange(len(members))], 0
    while waiting:
        lists = waiting.pop()
        if len(lists) == 1 or members[lists].sum() <= most:
            zone[lists], made = made, made + 1
            continue
        apart = centroids[lists] - centroids[lists].mean(axis=0)
        lists = lists[np.argsort(apart @ np.linalg.svd(apart, full_matrices=False)[2][0], kind="stable")]
        half = np.searchsorted(np.cumsum(members[lists]), members[lists].sum() / 2)
        half = min(max(1, int(half)), len(lists) - 1)
        waiting += [lists[:half], lists[half:]]
    return zone


def reached(x: np.ndarray, first: np.ndarray, quantiser: Quantiser, lists: np.ndarray, radii: np.ndarray, reach: float) -> np.ndarray:
    """Whether a vector within ``reach`` of each query may be in each of ``lists``; ``first`` has the queries' own."""
    d = distances(x, quantiser.centroids[lists])
    own = np.square(x - quantiser.centroids[first]).sum(axis=1)
    # A member is at least so far away: outside the ball of its list, and beyond the plane between the two centroids.
    gap = np.maximum(2 * quantiser.gaps[np.ix_(first, lists)], 1e-12)
    plane = (np.square(d) - own[:, None]) / gap
    return (d - radii <= reach) & (plane <= reach) | (lists[None, :] == first[:, None])


class Block:
    """Members of a part of a zone, as they are compared."""

    PACKED = {"cls": "<i8", "weight": "<i8", "dim": "<i4", "list": "<i4", "error": "<f8"}

    def __init__(self, row: dict, quantiser: Quantiser, kind: str) -> None:
        self.part = row["part"]
        self.cls, self.weight, self.dim, self.list, self.error = (np.frombuffer(row[c], t) for c, t in self.PACKED.items())
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(len(self.cls), -1)
        self.lists = np.unique(self.list)
        self.unit = matrix(row["raw"], self.dim, quantiser.centroids.shape[1], kind)
        self.narrow = quantiser.narrow(self.unit)
        self.links = np.zeros(len(self.cls), np.int64)
        self.quantiser = quantiser

    @cached_property
    def tables(self) -> np.ndarray:
        """Of the queries, with all codes."""
        return self.quantiser.tables(self.unit)

    @cached_property
    def coded(self) -> np.ndarray:
        """Squared length of what each member's list and codes stand for."""
        return np.square(self.quantiser.centroids[self.list] + self.quantiser.decode(self.codes)).sum(axis=1)

    def counts(self) -> np.ndarray:
        """Rows (class, class, links) of the members with links, which are counted anew from here."""
        some, links = self.links > 0, self.links
        self.links = np.zeros(len(self.cls), np.int64)
        return np.stack([self.cls[some], self.cls[some], links[some]])


def linked(q: Block, m: Block, quantiser: Quantiser, radii: np.ndarray, least_cosine: float) -> np.ndarray:
    """Links between two parts, added to the numbers of both, or of the queries alone if it is one part; rows (a, b, 0) connect what the links connect."""
    least = np.sqrt(2 - 2 * least_cosine) + ROUNDING
    same = q.part == m.part
    rows = np.flatnonzero(reached(q.unit, q.list, quantiser, m.lists, radii[m.lists], least).any(axis=1))
    columns = rows if same else np.flatnonzero(reached(m.unit, m.list, quantiser, q.lists, radii[q.lists], least).any(axis=1))
    ends = [np.zeros((2, 0), np.int64)]
    # Of products of so many single-precision figures whose sum is 1.
    floor = np.float32(least_cosine - 1e-6 - 2.5e-7 * q.narrow.shape[1])
    wide = np.ascontiguousarray(m.narrow[columns].T)
    near = np.zeros((ROWS_AT_ONCE, -(-len(columns) // 8) * 8), bool)
    for start in range(0, len(rows), ROWS_AT_ONCE):
        asking = rows[start : start + ROWS_AT_ONCE]
        np.greater_equal(q.narrow[asking] @ wide, floor, out=near[: len(asking), : len(columns)])
        # Eight marks at a time, as few words have any.
        words = near[: len(asking)].reshape(-1).view(np.uint64)
        words = np.flatnonzero(words)
        if not len(words):
            continue
        at, bit = np.nonzero(near.reshape(-1, 8)[words])
        r, c = np.divmod(words[at] * 8 + bit, near.shape[1])
        met = np.zeros(len(r), bool)
        for part in range(0, len(r), PAIRS_AT_ONCE):
            some = slice(part, part + PAIRS_AT_ONCE)
            a, b = asking[r[some]], columns[c[some]]
            looked_up = q.tables[a[:, None], np.arange(q.tables.shape[1]), m.codes[b]].sum(axis=1)
            in_list = np.einsum("ij,ij->i", q.unit[a], quantiser.centroids[m.list[b]])
            squared = 1 + m.coded[b] - 2 * (in_list + looked_up)
            left = np.flatnonzero((squared <= np.square(least + m.error[b]) + ROUNDING) & (q.cls[a] != m.cls[b]) & (q.dim[a] == m.dim[b]))
            met[part + left] = np.einsum("ij,ij->i", q.unit[a[left]], m.unit[b[left]]) >= least_cosine
        r, c = r[met], c[met]
        if not len(r):
            continue
        q.links += np.bincount(asking[r], m.weight[columns[c]], len(q.cls)).astype(np.int64)
        if not same:
            m.links += np.bincount(columns[c], q.weight[asking[r]], len(m.cls)).astype(np.int64)
        # Only rows and columns with a link are spanned.
        used, row = np.unique(r, return_inverse=True)
        held, column = np.unique(c, return_inverse=True)
        block = np.zeros((len(used), len(held)), bool)
        block[row, column] = True
        of_row, label = spanning(block)
        ids = m.cls[columns[held]]
        joined = label < np.arange(len(held))
        ends += [np.stack([q.cls[asking[used]], ids[of_row]]), np.stack([ids[joined], ids[label[joined]]])]
    a, b = np.unique(np.concatenate(ends, axis=1), axis=1)
    return np.stack([a, b, np.zeros(len(a), np.int64)])


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of ``spark.sql`` for a while, dots written as two underscores."""
    held = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder; its shuffles, which are as large and have no other reader, are removed at once."""
    with settings(df.sparkSession, classic__shuffleDependency__fileCleanup__enabled="true"):
        return cut_lineage(df.select("*"))


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least_cosine: float = 0.95, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors are linked when their cosine, in double precision, is at least
    ``least_cosine``; ``component_id`` is the smallest id reachable by links.
    Vectors of one direction are folded into one class first, with its number
    of rows as weight. Centroids and codes are fitted on at most ``fit_rows``
    classes, chosen by hash; every class is indexed and is a query. Zones with
    many members are cut into parts. What is written grows with the rows: parts
    are compared in pairs by a product of their table with itself, of which no
    row is stored.

    Null, empty and zero vectors and those with a null or non-finite component
    link with nothing, and neither do vectors of different lengths. Rows with a
    null id link with nothing and are kept, with a null component. Rows that
    repeat count as further vectors. Other columns are ignored.
    """
    spark = rows.sparkSession
    keyed, kind = keyed_vectors(rows, vec_id, embedding)
    # Vectors with one key have one direction: any of them will do, but always the same.
    folded = keyed.where("key IS NOT NULL AND vec_id IS NOT NULL").groupBy("key", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min("raw").alias("raw"))
    classes = stored(folded.withColumn("cls", F.monotonically_increasing_id()))
    n_classes, width = classes.agg(F.count("*"), F.max("dim")).first()
    own = keyed.select("vec_id", "key")
    if not n_classes:
        return own.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    # Of many classes, few are sorted.
    by_hash = classes.withColumn("hash", F.xxhash64("key")).where(F.pmod("hash", F.lit(n_classes)) < 2 * fit_rows)
    sample = by_hash.orderBy("hash", "cls").limit(fit_rows).select("raw", "dim").toPandas()
    fitted = fit(matrix(b"".join(sample["raw"]), sample["dim"].to_numpy(), width, kind), min(MOST_LISTS, max(1, int(np.sqrt(n_classes)))), least_cosine)
    shared = spark.sparkContext.broadcast(fitted)
    n_lists = len(fitted.centroids)

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            place = nearest(matrix(b"".join(frame["raw"]), frame["dim"].to_numpy(), width, kind), shared.value.centroids)
            yield frame.drop(columns=["key", "rep"]).assign(list=place.astype(np.int32))

    in_list = classes.mapInPandas(listed, "dim int, weight bigint, raw binary, cls bigint, list int")
    sizes = in_list.groupBy("list").count().toPandas()
    used, members = sizes["list"].to_numpy(np.int64), sizes["count"].to_numpy(np.int64)
    most = max(1, min(BLOCK, BLOCK_CELLS // width, max(LEAST_BLOCK, n_classes // SPREAD)))
    zone_of_used = zones_of(fitted.centroids[used], members, most)
    # A zone of more than so many members, which is one list, is dealt over parts.
    in_zone = np.bincount(zone_of_used, members).astype(np.int64)
    parts = -(-in_zone // most)
    first_part = np.cumsum(parts) - parts
    n_parts, n_zones = int(parts.sum()), len(parts)
    zone_of_part = np.repeat(np.arange(n_zones), parts)
    zone = np.zeros(n_lists, np.int64)
    zone[used] = zone_of_used

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            of = zone[frame["list"].to_numpy()]
            yield frame.drop(columns="deal").assign(part=(first_part[of] + frame["deal"].to_numpy() % parts[of]).astype(np.int32))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = matrix(b"".join(frame["raw"]), frame["dim"].to_numpy(), width, kind)
        place = frame["list"].to_numpy()
        radius = np.zeros(n_lists)
        residuals = x - shared.value.centroids[place]
        np.maximum.at(radius, place, np.linalg.norm(residuals, axis=1))
        codes, error = shared.value.encode(residuals)
        packed = {c: frame[c].to_numpy().astype(t).tobytes() for c, t in Block.PACKED.items() if c != "error"}
        held = np.unique(place)
        return pd.DataFrame([{"part": key[0], **packed, "error": error.tobytes(), "codes": codes.tobytes(), "raw": b"".join(frame["raw"]), "lists": held.astype("<i4").tobytes(), "radii": radius[held].tobytes()}])

    fields = [*Block.PACKED, "codes", "raw"]
    dealt = in_list.withColumn("deal", F.pmod(F.xxhash64("cls"), F.lit(1 << 40))).mapInPandas(deal, "dim int, weight bigint, raw binary, cls bigint, list int, part int")
    tables = min(n_parts, max(4, -(-n_parts // BLOCKS_PER_PART)))
    packed = dealt.repartition(tables, "part").groupBy("part").applyInPandas(pack, ", ".join(["part int", *(f"{c} binary" for c in (*fields, "lists", "radii"))]))
    blocks = stored(packed)
    radii = np.zeros(n_lists)
    for row in blocks.select("lists", "radii").collect():
        np.maximum.at(radii, np.frombuffer(row["lists"], "<i4"), np.frombuffer(row["radii"]))
    reach = np.sqrt(2 - 2 * least_cosine) + ROUNDING

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            dim, place = np.frombuffer(row["dim"], "<i4"), np.frombuffer(row["list"], "<i4")
            x = matrix(row["raw"], dim, width, kind)
            hit = np.zeros(len(used), bool)
            for i in range(0, len(x), ROWS_AT_ONCE):
                hit |= reached(x[i : i + ROWS_AT_ONCE], place[i : i + ROWS_AT_ONCE], shared.value, used, radii[used], reach).any(axis=0)
            zones = np.bincount(zone_of_used, hit, n_zones) > 0
            yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]], pa.int32()), "asks": pa.array(["".join("1" if z else "0" for z in zones)])})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, members = None, {}
        for row in (r for b in batches for r in b.to_pylist()):
            if query is None or query.part != row["q_part"]:
                if query is not None:
                    yield found_rows(query.counts())
                query = Block({c: row[f"q_{c}"] for c in ("part", *fields)}, shared.value, kind)
            same = row["q_part"] == row["m_part"]
            if not same and row["m_part"] not in members:
                # Every query of the task meets the same members.
                if len(members) == BLOCKS_PER_PART:
                    members.pop(next(iter(members)))
                members[row["m_part"]] = Block({c: row[f"m_{c}"] for c in ("part", *fields)}, shared.value, kind)
            member = query if same else members[row["m_part"]]
            yield found_rows(linked(query, member, shared.value, radii, least_cosine))
            if not same:
                yield found_rows(member.counts())
        if query is not None:
            yield found_rows(query.counts())

    # Rows are some MB each.
    with settings(spark, execution__arrow__maxRecordsPerBatch="4"):
        # As many letters as zones, of which there are no more than lists, for each part.
        asks = cut_lineage(blocks.select("part", "dim", "list", "raw").mapInArrow(probe, "part int, asks string"))
        zones = F.broadcast(spark.createDataFrame(pd.DataFrame({"part": np.arange(n_parts, dtype=np.int32), "zone": zone_of_part.astype(np.int32)}), "part int, zone int"))
        queries = blocks.coalesce(tables).join(F.broadcast(asks), "part").select(F.col("part").alias("q_part"), "asks", *(F.col(c).alias(f"q_{c}") for c in fields))
        others = blocks.coalesce(tables).join(zones, "part").select(F.col("part").alias("m_part"), "zone", *(F.col(c).alias(f"m_{c}") for c in fields))
        # Of two parts one asks the other; each part asks itself.
        turn = "q_part = m_part OR ((q_part + m_part) % 2 = 0) = (q_part < m_part) AND q_part <> m_part AND substring(asks, zone + 1, 1) = '1'"
        met = queries.join(others.hint("shuffle_replicate_nl"), F.expr(turn)).drop("asks", "zone")
        # Of one small part for each pair of parts of the tables.
        found = cut_lineage(met.mapInArrow(compare, "a bigint, b bigint, links bigint")).coalesce(tables)

    counted = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cls")
    joined = components(found).withColumnRenamed("node", "cls")
    placed = classes.select("cls", "key", "rep", "weight").join(counted, "cls", "left").join(joined, "cls", "left").withColumn("group", F.coalesce("component", "cls"))
    lowest = cut_lineage(placed.groupBy("group").agg(F.min("rep").alias("component_id")))
    result = placed.join(lowest, "group").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    known = own.join(cut_lineage(result), "key", "left").selectExpr("vec_id", "if(vec_id IS NULL, NULL, n_links) AS n_links", "if(vec_id IS NULL, NULL, component_id) AS component_id")
    return known.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def found_rows(columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "links"])

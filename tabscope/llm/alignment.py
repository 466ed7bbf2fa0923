"""Alignment of two tokenizers over the same bytes by interval coalescing.

The tokens of both are byte intervals. Sorted by start, a group breaks where
a start reaches the running maximum of the ends before it; overlaps are
expanded within groups. Many texts are laid behind each other on one line, so
a handful of array operations serves all of them.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.bytelevel import byte_codec
from tabscope.llm.words import CHUNK_BYTES, record_batches
from tabscope.session import checkpoint_folder, cut_lineage

MARK = "▁"  # stands for a space inside pieces
ROWS_AT_ONCE = 512
PAIRS_HELD = 1 << 20
HEAD_PAIRS = 1 << 20


class Tokens(NamedTuple):
    """Tokens of some texts behind each other: ids, first byte and byte behind the last, text they belong to."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def coalesce(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of both sides, numbered from 0 along the line, and how many groups there are."""
    start, end = np.concatenate([a.start, b.start]), np.concatenate([a.end, b.end])
    side = np.repeat([0, 1], [len(a.ids), len(b.ids)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.concatenate([[True], start[order][1:] >= reach[:-1]]) if len(order) else np.zeros(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[: len(a.ids)], group[len(a.ids) :], int(np.count_nonzero(breaks))


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places of all tokens of both sides whose intervals share a byte; they always are of one group."""
    first, behind = np.searchsorted(b.end, a.start, side="right"), np.searchsorted(b.start, a.end, side="left")
    many = behind - first
    at_a = np.repeat(np.arange(len(a.ids)), many)
    at_b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first, many)
    return at_a, at_b


# Which overlapping tokens are linked, from their starts and ends.
RELATIONS = {
    "overlap": lambda a, b: np.ones(len(a.ids), bool),
    "ends": lambda a, b: a.end == b.end,
    "same": lambda a, b: (a.start == b.start) & (a.end == b.end),
}


class Pair:
    """Both tokenizers: ids whose bytes are those of a space and the text, or none at all."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        self.bytes = byte_codec(byte_vocabulary, False)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        size = self.pieces.get_piece_size()
        named = [self.pieces.id_to_piece(i) for i in range(size)]
        self.raw_a = self.bytes.raw
        self.raw_b = [bytes([int(p[3:-1], 16)]) if self.pieces.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(named)]
        self.sizes = [np.array([len(r) for r in raw], np.int64) for raw in (self.raw_a, self.raw_b)]
        # A token with what follows it in the written groups: another of its group, the other side, or the next group.
        ids = [[str(i).encode() for i in range(len(raw))] for raw in (self.raw_a, self.raw_b)]
        written = [i + mark for side, marks in ((0, (b",", b"|")), (1, (b",", b";"))) for mark in marks for i in ids[side]]
        self.written = np.array(written, dtype=object)

    def ids(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by both; none where the bytes of either are not those of the text."""
        a, b = [], []
        encoded = self.pieces.encode([t or "" for t in texts], num_threads=1)
        for text, of_b in zip(texts, encoded, strict=True):
            raw = b" " + (text or "").encode()
            of_a = self.bytes.encode(" " + (text or "")) if text else np.zeros(0, "<u4")
            good = bool(text) and b"".join([self.raw_a[i] for i in of_a.tolist()]) == raw and b"".join([self.raw_b[i] for i in of_b]) == raw
            a.append(of_a if good else of_a[:0])
            b.append(np.array(of_b if good else [], "<u4"))
        return a, b

    def tokens(self, ids: list[np.ndarray], side: int) -> Tokens:
        joined = np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int64)
        sizes = self.sizes[side][joined]
        end = np.cumsum(sizes)
        return Tokens(joined, end - sizes, end, np.repeat(np.arange(len(ids)), [len(i) for i in ids]))


@lru_cache(1)
def pair_of(byte_vocabulary: str, piece_model: str) -> Pair:
    """One pair per Python worker."""
    return Pair(byte_vocabulary, piece_model)


def written_groups(pair: Pair, a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray, texts: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text: its groups' ids of both sides in order."""
    size_a, size_b = len(pair.raw_a), len(pair.raw_b)
    last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)]
    last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(group_b)]
    names = np.concatenate([a.ids + last_a * size_a, 2 * size_a + b.ids + last_b * size_b])
    order = np.lexsort((np.repeat([0, 1], [len(a.ids), len(b.ids)]), np.concatenate([group_a, group_b])))
    parts = pair.written[names[order]].tolist()
    ends = np.cumsum(np.bincount(a.text, minlength=texts) + np.bincount(b.text, minlength=texts)).tolist()
    return [b"".join(parts[low:high])[:-1] for low, high in zip([0, *ends[:-1]], ends, strict=True)]


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"


def aligned(pair: Pair, texts: list[str | None], related: str) -> list[list]:
    """The columns of ALIGNED behind the id, for some texts."""
    n = len(texts)
    ids_a, ids_b = pair.ids(texts)
    a, b = pair.tokens(ids_a, 0), pair.tokens(ids_b, 1)
    group_a, group_b, groups = coalesce(a, b)
    at_a, at_b = overlaps(a, b)
    linked = RELATIONS[related](Tokens(*(x[at_a] for x in a)), Tokens(*(x[at_b] for x in b)))
    at_a, at_b = at_a[linked], at_b[linked]
    text_of_group = np.zeros(groups, np.int64)
    text_of_group[group_a] = a.text
    # Equal pairs of a text are one entry with a number.
    codes = a.ids[at_a] * len(pair.raw_b) + b.ids[at_b]
    order = np.lexsort((codes, a.text[at_a]))
    codes, texts_of = codes[order], a.text[at_a][order]
    new = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (texts_of[1:] != texts_of[:-1]))[: len(codes)])
    times = np.diff(np.append(new, len(codes))).astype("<u4")
    cuts = np.cumsum(np.bincount(texts_of[new], minlength=n)).tolist()
    codes = codes[new].astype("<i8")
    spans = list(zip([0, *cuts[:-1]], cuts, strict=True))
    digests = [hashlib.sha256(w).hexdigest() if len(i) else "" for w, i in zip(written_groups(pair, a, b, group_a, group_b, n), ids_a, strict=True)]
    counts = [np.bincount(x, minlength=n) for x in (a.text, b.text, text_of_group, texts_of)]
    return [*counts, digests, [codes[low:high].tobytes() for low, high in spans], [times[low:high].tobytes() for low, high in spans]]


def _chunks(texts: list[str | None]) -> Iterator[slice]:
    """Consecutive texts of about CHUNK_BYTES together."""
    start, size = 0, 0
    for place, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_BYTES // 2:
            yield slice(start, place + 1)
            start, size = place + 1, 0
    yield slice(start, len(texts))


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str, related: str = "ends", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``, written once to the shared folder.

    ``n_a``, ``n_b`` tokens, ``n_groups`` where both end, ``n_links`` of token
    occurrences (``related``: ``overlap``, ``ends`` or ``same``),
    ``groups_sha256``, and the different linked pairs: ``pairs`` (a * size of
    B's vocabulary + b, signed 64 bits) and ``times`` (unsigned 32 bits). A
    text that is null, empty or not given back by either has zeros and ''.
    Repeated rows repeat, null ids stay, other columns are ignored.
    """
    schema = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in ALIGNED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in record_batches(batches, ROWS_AT_ONCE):
            pair, texts = pair_of(byte_vocabulary, piece_model), batch.column(1).to_pylist()
            for some in _chunks(texts):
                if texts[some]:
                    columns = [batch.column(0)[some.start : some.stop], *aligned(pair, texts[some], related)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    folder = f"{checkpoint_folder(docs.sparkSession)}/aligned-{uuid4().hex}"
    narrow.mapInArrow(run, ALIGNED).withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _entries(batch: pa.RecordBatch, pairs: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, how often, and the row of each, of all rows of a batch."""
    raw, many = batch.column(pairs).to_pylist(), batch.column(times).to_pylist()
    codes = np.frombuffer(b"".join(raw), "<i8")
    return codes, np.frombuffer(b"".join(many), "<u4").astype(np.int64), np.repeat(np.arange(len(raw)), [len(r) // 8 for r in raw])


def pair_counts(rows: DataFrame, piece_size: int) -> DataFrame:
    """``pair``, ``n`` links of all rows, ``best``: no pair of its B id has more. Each task sums what it reads first."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in record_batches(batches, ROWS_AT_ONCE):
            codes, times, _ = _entries(batch, 0, 1)
            held, place = np.unique(np.concatenate([held, codes]), return_inverse=True)
            sums = np.bincount(place, weights=np.concatenate([sums, times]), minlength=len(held)).astype(np.int64)
            if len(held) >= PAIRS_HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], schema=schema)
                held, sums = held[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], schema=schema)

    counts = cut_lineage(rows.select("pairs", "times").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    most = counts.groupBy(F.expr(f"pair % {piece_size}L").alias("b")).agg(F.max("n").alias("most"))
    # At most one row for each id of B's vocabulary.
    return counts.join(F.broadcast(most), F.expr(f"pair % {piece_size}L") == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, piece_model: str, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` to the rows of ``align``, from the counts of pairs in all rows.

    The most frequent pairs, at most ``head_pairs``, are looked up inside the
    tasks; so no pair that many rows hold is ever a hot key. What is left of
    each row meets the other pairs by a join.
    """
    spark = rows.sparkSession
    piece_size = sentencepiece.SentencePieceProcessor(model_file=piece_model).get_piece_size()
    counts = cut_lineage(pair_counts(rows, piece_size))
    # How many pairs have at least 2, 4, 8, ... links: at most 64 rows.
    levels = counts.groupBy(F.floor(F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect()
    least, held = 1 << 62, 0
    for level in levels:
        if held + level["count"] > head_pairs:
            break
        least, held = 1 << int(level["level"]), held + level["count"]
    head = counts.where(F.floor(F.log2("n")) >= F.lit(least.bit_length() - 1)).orderBy("pair").toPandas()
    looked_up = spark.sparkContext.broadcast((head["pair"].to_numpy(np.int64), head["n"].to_numpy(np.int64), head["best"].to_numpy(bool)))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row"]
    columns = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, row bigint, n_best bigint, count_sum bigint, rest array<bigint>, rest_times array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often, best = looked_up.value
        for batch in record_batches(batches, ROWS_AT_ONCE):
            codes, times, row = _entries(batch, len(kept), len(kept) + 1)
            at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
            met = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            at, own = at[met], times[met]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row[met], own * best[at])
            np.add.at(sums[1], row[met], own * often[at])
            cuts = pa.array(np.cumsum(np.append(0, np.bincount(row[~met], minlength=batch.num_rows))), pa.int32())
            rest = [pa.ListArray.from_arrays(cuts, pa.array(x[~met].astype(np.int64))) for x in (codes, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sums[0]), pa.array(sums[1]), *rest], names=[c.split()[0] for c in columns.split(", ")])

    scored = rows.select(*kept, "pairs", "times").mapInArrow(run, columns)
    if held == sum(level["count"] for level in levels):
        return scored.drop("row", "rest", "rest_times")
    scored = cut_lineage(scored)
    tail = counts.where(F.floor(F.log2("n")) < F.lit(least.bit_length() - 1))
    left = scored.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("e")).select("row", F.col("e.rest").alias("pair"), F.col("e.rest_times").alias("times"))
    more = left.join(tail, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
    both = scored.drop("rest", "rest_times").join(more, "row", "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))}).drop("row", "b", "s")

"""Packing of token sequences by minimum bin slack.

Documents are cut at multiples of the capacity; what is left over of each is
dealt into windows of a few thousand pieces, which are packed independently of
each other. In a window the longest piece left opens a sequence, and a bitset
subset sum over the lengths left finds the multiset that comes closest to
filling it. The same multiset is used as often as the counts allow.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabscope.columns import unused_name
from tabscope.llm.words import kept, let_go, record_batches
from tabscope.session import cut_lineage

CAPACITY = 2048
WINDOW_PIECES = 4096
CACHED_WORDS = 400_000
CACHED_PARTS = 100_000
LONGEST_CACHED = 40
ROWS_AT_ONCE = 512


# The marks of ASCII but the apostrophe, which can begin a token with letters.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def _byte_names() -> list[str]:
    """Characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the others from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class WordCache(dict):
    """Token ids by word, found when first asked for: no token reaches over a space or a line break.

    A plain word, letters with marks behind them, is made of two parts, which
    the vocabulary's pattern always parts and its normaliser only lower-cases;
    there are fewer different parts than words. Parts go to the model itself,
    all other words through the whole tokenizer. The letters in lower case are a
    word too, so they are kept among the words and not a second time.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.names = _byte_names()
        self.marks: dict[str, bytes] = {"": b""}

    def _part(self, part: str) -> bytes:
        named = part if part.isascii() else "".join([self.names[b] for b in part.encode()])
        found = [token.id for token in self.model.tokenize(named)]
        return struct.pack(f"<{len(found)}I", *found)

    def _marks(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._part(marks)
            if len(marks) <= LONGEST_CACHED:
                if len(self.marks) >= CACHED_PARTS:
                    self.marks = {"": b""}
                self.marks[marks] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(MARKS)
        # Up to ÿ, letters are composed and are lower-cased one by one.
        if letters.isalpha() and max(letters) <= "ÿ":
            lower = letters.lower()
            ids = self._part(word) if lower == word else self[lower] + self._marks(word[len(letters) :])
        else:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def tokenised(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", closing_id: int = 1) -> DataFrame:
    """``doc_id`` and ``ids`` of each row's whole text (null: empty), with ``closing_id`` at the end."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    closing = np.array([closing_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches, ROWS_AT_ONCE, keep=vocabulary):
            # One cache per Python worker, until it turns to other work.
            cache = kept(vocabulary, WordCache)
            ids = [cache.encode(t or "") + closing for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], schema=schema)

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, ids binary")


def pieces_of(tokens: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``doc_tokens``, ``ids``: each row cut at multiples of the capacity."""
    whole = tokens.select("doc_id", F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("doc_tokens"), "ids")
    cut = whole.select("doc_id", "doc_tokens", "ids", F.explode(F.expr(f"sequence(0L, doc_tokens - 1, {capacity}L)")).alias("start"))
    return cut.selectExpr(
        "doc_id",
        "start",
        f"least(doc_tokens - start, {capacity}L) AS length",
        "doc_tokens",
        f"substring(ids, CAST(4 * start + 1 AS INT), {4 * capacity}) AS ids",
    )


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the given lengths, each at most as often as counted, whose sum comes closest to the room."""
    reached, steps = 1, []
    within = (1 << (room + 1)) - 1
    for length in sorted((c for c in counts if c <= room), reverse=True):
        steps.append((length, reached))
        left, copies = min(counts[length], room // length), 1
        while left:
            taken = min(copies, left)
            reached |= (reached << (length * taken)) & within
            left, copies = left - taken, copies * 2
        if reached >> room:
            break
    total, chosen = reached.bit_length() - 1, {}
    for length, before in reversed(steps):
        times = 0
        while not before >> total & 1:
            total, times = total - length, times + 1
        if times:
            chosen[length] = times
    return chosen


def bins_of(counts: dict[int, int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """Lengths of one sequence and how often to make it, until no length is left."""
    counts = dict(counts)
    while counts:
        longest = max(counts)
        rest = {c: n - (c == longest) for c, n in counts.items() if n > (c == longest)}
        chosen = fill(rest, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[c] // n for c, n in chosen.items())
        yield [c for c in sorted(chosen, reverse=True) for _ in range(chosen[c])], times
        for c, n in chosen.items():
            counts[c] -= n * times
            if not counts[c]:
                del counts[c]


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of one window."""
    waiting: dict[int, list[int]] = {}
    for row, length in enumerate(lengths.tolist()):
        waiting.setdefault(length, []).append(row)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for contents, times in bins_of({c: len(r) for c, r in waiting.items()}, capacity):
        for _ in range(times):
            at = 0
            for length in contents:
                row = waiting[length].pop()
                sequence[row], offset[row] = made, at
                at += length
            made += 1
    return sequence, offset


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, window_pieces: int = WINDOW_PIECES) -> DataFrame:
    """All rows and columns of ``pieces`` with ``sequence_id`` and ``offset`` in that sequence.

    Windows get equal shares of the rows by a number given to each row when the
    pieces are materialised, so neither repeated rows nor null ids can swell
    one. A window leaves its last few sequences less than full; all others
    leave no slack that any choice of its pieces could have filled. Lengths run
    from 1 to the capacity. Columns called ``sequence_id`` or ``offset`` are
    replaced, others may have any name. No rows give none.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    piece, window = unused_name("piece", columns), unused_name("window", columns)
    numbered = cut_lineage(pieces.select(*columns, F.monotonically_increasing_id().alias(piece)))
    n_windows = max(1, -(-numbered.count() // window_pieces))
    windowed = numbered.withColumn(window, F.pmod(F.xxhash64(piece), F.lit(n_windows)))
    schema = windowed.withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint")).schema

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        let_go()
        rows = rows.sort_values(piece, ignore_index=True)
        sequence, offset = place(rows[length].to_numpy(np.int64), capacity)
        return rows.assign(sequence_id=int(key[0]) * (1 << 32) + sequence, offset=offset)

    return windowed.groupBy(window).applyInPandas(packed, schema).drop(piece, window)

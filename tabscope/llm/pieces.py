"""SentencePiece BPE encoding and decoding with a table of prefixes' last tokens.

A merge-type vocabulary gives every prefix of a text one encoding, so it is
enough to store each prefix's last token. An automaton reports the tokens that
end at a place; the right one is the token that is compatible with the last
token of the prefix before it, which means that merging never crosses the
border between them. Ids are then read backwards. The work is linear in the
length of the text, also without any spaces.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.words import record_batches

MARK = "▁"  # stands for a space inside pieces
CACHED_WORDS = 700_000
LONGEST_CACHED = 40
ROWS_AT_ONCE = 512
_NEVER = 1 << 60


class PieceCodec:
    """Encoder and decoder for one BPE model file."""

    def __init__(self, model: str):
        vocabulary = sentencepiece.SentencePieceProcessor(model_file=model)
        size = vocabulary.get_piece_size()
        self.begin, self.end, self.unknown = vocabulary.bos_id(), vocabulary.eos_id(), vocabulary.unk_id()
        special = [vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_byte(i) or vocabulary.is_unused(i) for i in range(size)]
        self.text = [vocabulary.id_to_piece(i) for i in range(size)]
        self.ids = {piece: i for i, piece in enumerate(self.text) if not special[i]}
        self.byte_ids = {int(self.text[i][1:-1], 16): i for i in range(size) if vocabulary.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces to fall back on")
        # Merges happen by score; single characters are there from the start.
        order = sorted(self.ids.values(), key=lambda i: (-vocabulary.get_score(i), i))
        self.rank = [-1] * size
        for place, i in enumerate(order):
            if len(self.text[i]) > 1:
                self.rank[i] = place
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i in order:
            if len(self.text[i]) == 1 or self._find_halves(i):
                self.automaton.add_word(self.text[i], (i, len(self.text[i])))
        self.automaton.make_automaton()
        known = "".join(map(re.escape, (p for p in self.ids if len(p) == 1)))
        self.segments = re.compile(f"[{known}]+|[^{known}]+")
        self.splits = not any(MARK in piece.lstrip(MARK) for piece in self.ids)
        self.units = re.compile(f"{MARK}+[^{MARK}]*")
        self.words: dict[str, bytes] = {}
        self.compatible = lru_cache(1 << 17)(self._compatible)
        self.raw = [b"" if vocabulary.is_control(i) else p.encode() for i, p in enumerate(self.text)]
        self.raw[self.unknown] = b" \xe2\x81\x87 "
        for value, i in self.byte_ids.items():
            self.raw[i] = bytes([value])
        self.raw_bytes = set(self.byte_ids.values())
        self.silent = {i for i in range(size) if vocabulary.is_control(i)}

    def _find_halves(self, piece: int) -> bool:
        """Merge the piece's characters; False if they never become the piece."""
        if any(c not in self.ids for c in self.text[piece]):
            return False
        parts = [self.ids[c] for c in self.text[piece]]
        while True:
            merged = [self.ids.get(self.text[a] + self.text[b]) for a, b in zip(parts, parts[1:], strict=False)]
            ranked = [(self.rank[m], place) for place, m in enumerate(merged) if m is not None]
            if not ranked:
                return False
            place = min(ranked)[1]
            if merged[place] == piece:
                a, b = parts
                if max(self.rank[a], self.rank[b]) > self.rank[piece]:
                    raise ValueError(f"piece {piece} is merged before its parts")
                self.halves[piece] = (a, b)
                return True
            parts[place : place + 2] = [merged[place]]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens apart.

        Goes back in time from the finished tokens: whichever of the two
        neighbours was made last is taken apart. They would have merged with
        each other if that came before what was then made of either; of two
        equal merges the one further left comes first.
        """
        left_until = right_until = _NEVER
        while True:
            joint = self.ids.get(self.text[left] + self.text[right])
            if joint is not None and self.rank[joint] < left_until and self.rank[joint] <= right_until:
                return False
            if self.rank[left] > self.rank[right]:
                left_until, left = self.rank[left], self.halves[left][1]
            elif self.rank[right] >= 0:
                right_until, right = self.rank[right], self.halves[right][0]
            else:
                return True

    def _segment_ids(self, segment: str) -> list[int]:
        """Ids of a run of characters that all are pieces, by the prefix table."""
        last: list[int] = [-1] * (len(segment) + 1)
        lengths = [0] * (len(segment) + 1)
        for end, (token, length) in self.automaton.iter(segment):
            place = end + 1
            if last[place] < 0:
                before = place - length
                if not before or (last[before] >= 0 and self.compatible(last[before], token)):
                    last[place], lengths[place] = token, length
        found, place = [], len(segment)
        while place:
            found.append(last[place])
            place -= lengths[place]
        return found[::-1]

    def _unit_ids(self, unit: str) -> bytes:
        found: list[int] = []
        for match in self.segments.finditer(unit):
            run = match.group()
            if run[0] in self.ids:
                found += self._segment_ids(run)
            else:
                found += [self.byte_ids[b] for b in run.encode()]
        return struct.pack(f"<{len(found)}I", *found)

    def _word(self, word: str) -> bytes:
        """Ids of a unit, named without its first mark."""
        ids = self.words.get(word)
        if ids is None:
            ids = self._unit_ids(MARK + word)
            if len(word) <= LONGEST_CACHED:
                if len(self.words) >= CACHED_WORDS:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids with begin and end as little-endian unsigned 32-bit integers."""
        if not text:
            return struct.pack("<2I", self.begin, self.end)
        words = text.split(" ")
        if not self.splits:
            body = [self._unit_ids(MARK + text.replace(" ", MARK))]
        elif "" in words or MARK in text:
            body = [self._word(u[1:]) for u in self.units.findall(MARK + text.replace(" ", MARK))]
        else:
            body = map(self._word, words)
        return b"".join([struct.pack("<I", self.begin), *body, struct.pack("<I", self.end)])

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are not UTF-8 become the replacement character one by one."""
        raw = self.raw
        joined = b"".join([raw[i] for i in ids])
        try:
            text = joined.decode()
        except UnicodeDecodeError:
            text = self._decode_slowly(ids)
        first = next((i for i in ids if i not in self.silent), None)
        text = text.replace(MARK, " ")
        return text[1:] if first is not None and self.text[first][0] == MARK else text

    def _decode_slowly(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, self.begin]:
            if i in self.raw_bytes:
                run += self.raw[i]
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:size]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                del run[:size]
            out.append(self.raw[i].decode())
        return "".join(out)


@lru_cache(1)
def codec(model: str) -> PieceCodec:
    """One codec per Python worker and model."""
    return PieceCodec(model)


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of each row's whole text.

    A null or empty text has the begin and end ids only. Rows are taken one by
    one: repeated rows repeat, null ids stay, other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches, ROWS_AT_ONCE):
            ids = [codec(model).encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``, to the rows of ``encode``; null ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches, ROWS_AT_ONCE):
            texts = [codec(model).decode(np.frombuffer(i or b"", dtype="<u4").tolist()) for i in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")

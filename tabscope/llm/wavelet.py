"""Token ids in shard files, each a wavelet matrix with its documents' lengths.

Ids are kept as bit planes, the highest bit first; below each plane the ids
are ordered by the bits above, zeros before ones. Planes are cut into blocks
of 65,536 bits, compressed one by one, with the ones before each block in a
directory. So a token, the count of an id in a range and the place of its
k-th occurrence are found by reading one or two blocks of each plane.

File: ``WVM1``, length of the header (unsigned 32 bits), header in JSON
(``n``, ``width``, ``zeros`` of each plane, ``documents``, ``partition``,
``shard``, ``first``, ``sections`` as lengths in bytes), then the sections:
documents (id, id is null, tokens), and for each plane its directory (ones
before, end of block in the plane's bytes) and its blocks.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscope.llm.bytelevel import byte_codec
from tabscope.llm.words import record_batches
from tabscope.session import cut_lineage

MAGIC = b"WVM1"
BLOCK_BITS = 1 << 16
BLOCK_BYTES = BLOCK_BITS // 8
SHARD_TOKENS = 1 << 20
ROWS_AT_ONCE = 256
DOCUMENT = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("tokens", "<u8")])
BLOCK = np.dtype([("ones", "<u8"), ("end", "<u8")])


def _section(raw: bytes) -> bytes:
    """Compressed where that saves space; the first byte says which."""
    packed = zstandard.ZstdCompressor(level=1).compress(raw)
    return b"\x01" + packed if len(packed) < len(raw) else b"\x00" + raw


def _plain(section: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(section[1:]) if section[0] else section[1:]


def build(ids: np.ndarray, documents: np.ndarray, place: dict | None = None) -> bytes:
    """The file's bytes for ids (unsigned 32 bits) of some documents (DOCUMENT rows, in order)."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    zeros, sections = [], [_section(documents.tobytes())]
    for bit in range(width - 1, -1, -1):
        ones = (ids >> np.uint32(bit)) & np.uint32(1) != 0
        packed = np.packbits(ones, bitorder="little").tobytes()
        starts = range(0, len(packed), BLOCK_BYTES)
        blocks = [_section(packed[s : s + BLOCK_BYTES]) for s in starts]
        directory = np.zeros(len(blocks) + 1, BLOCK)
        if blocks:
            directory["ones"][1:] = np.cumsum(np.add.reduceat(ones, [8 * s for s in starts], dtype=np.uint64))
            directory["end"][1:] = np.cumsum([len(b) for b in blocks])
        sections += [_section(directory.tobytes()), b"".join(blocks)]
        zeros.append(len(ids) - int(directory["ones"][-1]))
        ids = np.concatenate([ids[~ones], ids[ones]])
    header = {"n": len(ids), "width": width, "zeros": zeros, "documents": len(documents), "sections": [len(s) for s in sections]} | (place or {})
    named = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(named)), named, *sections])


class WaveletFile:
    """One shard file: tokens by place, counts and places of an id, documents."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        (size,) = struct.unpack_from("<I", content, 4)
        self.header = json.loads(content[8 : 8 + size])
        self.n, self.width, self.zeros = (self.header[k] for k in ("n", "width", "zeros"))
        view, at, sections = memoryview(content), 8 + size, []
        for length in self.header["sections"]:
            sections.append(view[at : at + length])
            at += length
        if at > len(content):
            raise ValueError("the shard ends before its sections do")
        self.documents = np.frombuffer(_plain(sections[0]), DOCUMENT)
        self.directories = [np.frombuffer(_plain(s), BLOCK) for s in sections[1::2]]
        self.planes = sections[2::2]
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, level: int, block: int) -> np.ndarray:
        """The bits of one block; the last few blocks read are held."""
        bits = self.held.get((level, block))
        if bits is None:
            ends = self.directories[level]["end"]
            raw = _plain(self.planes[level][int(ends[block]) : int(ends[block + 1])])
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: self.n - block * BLOCK_BITS]
            if len(self.held) >= 4 * self.width:
                self.held.clear()
            self.held[level, block] = bits
        return bits

    def _rank(self, level: int, place: int) -> int:
        """Ones before a place of a plane."""
        block, inside = divmod(place, BLOCK_BITS)
        ones = int(self.directories[level]["ones"][block])
        return ones + (int(np.count_nonzero(self._block(level, block)[:inside])) if inside else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th one or zero (from 0) of a plane."""
        ones = self.directories[level]["ones"].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self._block(level, block) == bit)[k - int(before[block])])

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for level in range(self.width):
            block, inside = divmod(place, BLOCK_BITS)
            bit, ones = int(self._block(level, block)[inside]), self._rank(level, place)
            value, place = value << 1 | bit, self.zeros[level] + ones if bit else place - ones
        return value

    def _narrow(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the occurrences of an id among places low to high stand below the last plane."""
        if token < 0 or token >> self.width:
            return 0, 0
        for level in range(self.width):
            if low >= high:
                return 0, 0
            a, b = self._rank(level, low), self._rank(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.width - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id at places from low to before high."""
        high = self.n if high is None else min(high, self.n)
        first, last = self._narrow(token, max(0, low), high)
        return last - first

    def find(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of an id."""
        first, last = self._narrow(token, 0, self.n)
        if not 0 <= k < last - first:
            raise IndexError(k)
        place = first + k
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            place = self._select(level, bit, place - self.zeros[level] if bit else place)
        return place

    def tokens(self) -> np.ndarray:
        """All ids in order: from the last plane up, each plane's order is undone, a scan through memory."""
        value = np.zeros(self.n, "<u4")
        for level in range(self.width - 1, -1, -1):
            ends = self.directories[level]["end"].tolist()
            raw = b"".join([_plain(self.planes[level][low:high]) for low, high in zip(ends[:-1], ends[1:], strict=True)])
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: self.n].astype(bool)
            above = np.empty_like(value)
            above[~bits] = value[: self.zeros[level]]
            above[bits] = value[self.zeros[level] :] | np.uint32(1 << (self.width - 1 - level))
            value = above
        return value


def write_shards(docs: DataFrame, vocabulary: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts, ``end_id`` behind each, into shard files of a new folder, in ascending order of ``doc_id``.

    Rows without an id come first, rows of one id are ordered by a hash of
    their text; a null text is empty; other columns are ignored. A shard ends
    with the document that brings it to ``shard_tokens``, so only one longer
    document makes it larger. No rows make no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, closing = byte_codec(vocabulary, True), np.array([end_id], "<u4")
        partition = TaskContext.get().partitionId()
        ids, documents, size, first, shards = [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            place = {"partition": partition, "shard": shards, "first": first}
            content = build(np.concatenate(ids), np.array(documents, DOCUMENT), place)
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for batch in record_batches(batches, ROWS_AT_ONCE):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids += [codec.encode(t or ""), closing]
                tokens = len(ids[-2]) + 1
                documents.append((i or 0, i is None, tokens))
                size += tokens
                if size >= shard_tokens:
                    yield shard()
                    ids, documents, size, first, shards = [], [], 0, first + size, shards + 1
        if documents:
            yield shard()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("same"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "same", "row").sortWithinPartitions("doc_id", "same", "row").select("doc_id", "text")
    # The text sink writes the bytes it is given; the line end it adds stands behind the last section.
    ordered.mapInArrow(run, "content binary").selectExpr("CAST(content AS STRING) AS value").write.option("maxRecordsPerFile", 1).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` of each document of all shards, with ``partition`` and ``place`` for ``with_starts``."""
    columns = "doc_id bigint, n_tokens bigint, ids binary, partition int, place bigint"
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("partition", pa.int32()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = WaveletFile(content.as_py())
                if not len(file.documents):
                    continue
                ids, lengths = file.tokens(), file.documents["tokens"].astype(np.int64)
                ends = np.cumsum(lengths)
                for at in range(0, len(lengths), ROWS_AT_ONCE):
                    some = slice(at, at + ROWS_AT_ONCE)
                    raw = [ids[e - n : e].tobytes() for n, e in zip(lengths[some].tolist(), ends[some].tolist(), strict=True)]
                    arrays = [
                        pa.array(file.documents["doc_id"][some], pa.int64(), mask=file.documents["no_id"][some] != 0),
                        pa.array(lengths[some], pa.int64()),
                        pa.array(raw, pa.binary()),
                        pa.array(np.full(len(raw), file.header["partition"]), pa.int32()),
                        pa.array(file.header["first"] + ends[some] - lengths[some], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return _files(spark, folder).mapInArrow(run, columns)


def with_starts(documents: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before, to narrow rows of ``read_documents``; they are read once.

    Only one sum for each partition of the writer is brought together.
    """
    stored = cut_lineage(documents)
    sums = stored.groupBy("partition").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("partition", F.coalesce(before, F.lit(0)).alias("offset"))
    return stored.join(F.broadcast(offsets), "partition").withColumn("start", F.col("offset") + F.col("place")).drop("partition", "place", "offset")


def count_tokens(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """``token`` and ``n`` over all shards, from ranks alone: no shard is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = WaveletFile(content.as_py())
                yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int64()), "n": pa.array([file.count(t) for t in tokens], pa.int64())})

    return _files(spark, folder).mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """``token``, ``doc_id``, ``place``: every occurrence of some ids, by its place in its document, from selects alone."""
    columns = "token bigint, doc_id bigint, place bigint"
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = WaveletFile(content.as_py())
                starts = np.concatenate([[0], np.cumsum(file.documents["tokens"].astype(np.int64))])
                for token in tokens:
                    found = np.array([file.find(token, k) for k in range(file.count(token))], np.int64)
                    rows = np.searchsorted(starts, found, side="right") - 1
                    ids = pa.array(file.documents["doc_id"][rows], pa.int64(), mask=file.documents["no_id"][rows] != 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), token), pa.int64()), ids, pa.array(found - starts[rows], pa.int64())], schema=schema)

    return _files(spark, folder).mapInArrow(run, columns)

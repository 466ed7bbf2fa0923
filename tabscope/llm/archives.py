"""WARC archives written and read by Spark, and an index merged from their sorted runs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.session import cut_lineage

END_OF_RECORD = "\r\n\r\n"
RECORD_ID = "urn:page:"
ARCHIVE_ROWS = 20_000
RUN_ROWS = 50_000
MERGED_AT_ONCE = 200_000


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of binary payloads, as archives name them."""

    @F.pandas_udf("string")
    def base32(hexes: pd.Series) -> pd.Series:
        return hexes.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode())

    return base32(F.sha1(payload))


def with_revisits(pages: DataFrame, page_id: str, url: str, html: str, captured_at: Column, least_bytes: int = 0) -> DataFrame:
    """Pages as captures: ``page_id``, ``url``, ``captured_at``, ``payload``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Of captures with equal payloads of at least ``least_bytes``, the one with
    the largest id is the response and the others revisit it; smaller ones are
    all responses. A null page is an empty payload; a null id never is what
    others refer to. Rows that repeat id and payload are all responses.
    """
    captures = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).alias("url"),
        captured_at.alias("captured_at"),
        F.coalesce(F.col(html), F.lit("")).alias("payload"),
    )
    raw = F.encode("payload", "UTF-8")
    captures = captures.withColumns({"payload_bytes": F.octet_length(raw).cast("bigint"), "sha1": F.sha1(raw)})
    same = captures.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    originals = same.groupBy("sha1").agg(F.max("page_id").alias("original"), F.min("page_id").alias("earliest"))
    # A table of its own, so that the join may split a payload that very many pages share.
    originals = cut_lineage(originals.where("earliest < original").select("sha1", "original"))
    revisits = (F.col("page_id") < F.col("original")) & (F.col("payload_bytes") >= least_bytes)
    return (
        captures.join(originals, "sha1", "left")
        .withColumn("refers_to", F.when(revisits, F.col("original")))
        .withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"))
        .withColumn("payload_digest", payload_digest(F.encode("payload", "UTF-8")))
        .drop("sha1", "original")
    )


def warc_records(captures: DataFrame) -> DataFrame:
    """Each capture as the text of one WARC record, without the blank lines that end it.

    Ends of line are taken out of a URL. A revisit has an empty block, and its
    full payload's length in a header of its own.
    """
    when = F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    # A header is written only where its value is not null: concat gives null, concat_ws leaves it out.
    return captures.select(
        F.concat(
            F.concat_ws(
                "\r\n",
                F.lit("WARC/1.0"),
                F.concat(F.lit("WARC-Type: "), "record_type"),
                F.concat(F.lit(f"WARC-Record-ID: <{RECORD_ID}"), "page_id", F.lit(">")),
                F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]+", " ")),
                F.concat(F.lit("WARC-Date: "), when),
                F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
                F.concat(F.lit("WARC-Payload-Length: "), "payload_bytes"),
                F.concat(F.lit(f"WARC-Refers-To: <{RECORD_ID}"), "refers_to", F.lit(">")),
                F.lit("Content-Type: text/html; charset=utf-8"),
                F.concat(F.lit("Content-Length: "), F.octet_length(F.encode(block, "UTF-8"))),
            ),
            F.lit("\r\n\r\n"),
            block,
        ).alias("value")
    )


def write_archives(captures: DataFrame, folder: str) -> None:
    """Write gzip WARC files into a new folder of any file system Spark knows."""
    writer = warc_records(captures).write.option("lineSep", END_OF_RECORD).option("compression", "gzip")
    writer.option("maxRecordsPerFile", ARCHIVE_ROWS).text(folder)


def records_in(content: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """Headers, place and block of each record of one archive, by the stated lengths."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))
    at = 0
    while line := stream.readline():
        if line.strip() != b"WARC/1.0":
            raise ValueError(f"no record at {at}")
        size, headers = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        tail = stream.read(len(END_OF_RECORD))
        if tail != END_OF_RECORD.encode():
            raise ValueError(f"the record at {at} does not end where it says")
        yield headers, at, block
        at += size + 2 + len(block) + len(tail)


def url_key(url: str) -> str:
    """A URL with its host's labels turned round, without scheme, credentials, port, leading www and fragment, in lower case."""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(labels))}){parts.path or '/'}{query}".lower()


RUN = pa.schema(
    [
        ("url_key", pa.string()),
        ("captured_at", pa.string()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("block_bytes", pa.int64()),
        ("archive", pa.string()),
        ("place", pa.int64()),
        ("run", pa.string()),
    ]
)
RUN_COLUMNS = "url_key string, captured_at string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, block_bytes bigint, archive string, place bigint, run string"
SORT_KEY = ("url_key", "captured_at", "page_id", "archive", "place")


def _page(value: str | None) -> int | None:
    return int(value.strip("<>").removeprefix(RECORD_ID)) if value else None


def _entry(headers: dict[str, str], archive: str, place: int, block: bytes) -> dict:
    return {
        "url_key": url_key(headers.get("warc-target-uri", "")),
        "captured_at": headers.get("warc-date", ""),
        "page_id": _page(headers.get("warc-record-id")),
        "payload_bytes": int(headers["warc-payload-length"]),
        "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": headers["warc-type"],
        "refers_to": _page(headers.get("warc-refers-to")),
        "block_bytes": len(block),
        "archive": archive,
        "place": place,
    }


def _verify(entry: dict, block: bytes) -> None:
    """A response's block has the length and the digest that its headers name; a revisit has none."""
    if entry["record_type"] == "response":
        digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
        if (len(block), digest) != (entry["payload_bytes"], entry["payload_digest"]):
            raise ValueError(f"the record at {entry['place']} of {entry['archive']} does not hold the payload it names")


def _order(entry: dict) -> tuple:
    return tuple((entry[c] is not None, entry[c]) for c in SORT_KEY)


def sorted_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One index entry per record, in sorted runs of at most RUN_ROWS entries of one archive.

    A response whose block does not have the length and the digest it names is an error.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                archive, entries, runs = path.rsplit("/", 1)[-1], [], 0
                for headers, place, block in records_in(content):
                    entries.append(_entry(headers, archive, place, block))
                    _verify(entries[-1], block)
                    if len(entries) == RUN_ROWS:
                        yield _run(entries, f"{archive}:{runs}")
                        entries, runs = [], runs + 1
                if entries:
                    yield _run(entries, f"{archive}:{runs}")

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(index, RUN_COLUMNS)


def _run(entries: list[dict], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([e | {"run": name} for e in sorted(entries, key=_order)], schema=RUN)


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, the winner goes up.

    Taking the winner replays only the matches on its own way to the top.
    """

    def __init__(self, runs: list[list[dict]]):
        self.runs = runs
        self.size = max(1, len(runs))
        self.places = [0] * self.size
        self.keys = [self._key(i) for i in range(self.size)]
        self.losers = [-1] * self.size
        for leaf in range(self.size):
            self._enter(leaf)

    def _key(self, run: int) -> tuple | None:
        at = self.places[run]
        return _order(self.runs[run][at]) if run < len(self.runs) and at < len(self.runs[run]) else None

    def _before(self, a: int, b: int) -> bool:
        """An exhausted run loses against all others; equal keys keep the order of the runs."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _enter(self, leaf: int) -> None:
        """Play upwards until a node that waits for its second player."""
        winner, node = leaf, (leaf + self.size) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[dict]:
        while self.keys[winner := self.losers[0]] is not None:
            yield self.runs[winner][self.places[winner]]
            self.places[winner] += 1
            self.keys[winner] = self._key(winner)
            node = (winner + self.size) // 2
            while node:
                if self._before(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


def merged_index(runs: DataFrame) -> DataFrame:
    """All runs in one order of URL key, time, id, archive and place: partition by partition, and within each.

    Runs are cut at common key borders; equal keys of one page are told apart
    by their place, so a URL with very many captures spreads over partitions.
    Each partition, of some MERGED_AT_ONCE entries, merges its parts of all runs
    with a loser tree. No runs give an empty index.
    """
    runs = cut_lineage(runs)
    partitions = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // MERGED_AT_ONCE))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[dict]] = {}
        for batch in batches:
            for entry in batch.to_pylist():
                parts.setdefault(entry["run"], []).append(entry)
        # A run's entries arrive in its own order unless its archive was read by several tasks; sorted() leaves sorted lists as they are.
        runs = [sorted(parts[name], key=_order) for name in sorted(parts)]
        out = []
        for entry in LoserTree(runs):
            out.append(entry)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=RUN)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=RUN)

    return runs.repartitionByRange(partitions, *SORT_KEY).mapInArrow(merge, RUN_COLUMNS)

"""Ranked lexical search by the Best Position Algorithm.

Documents are indexed once by the terms that some item asks for. A task takes
documents until their postings fill a shard, and makes an impact list of each
term, highest first, and a forward index with the place of each posting in
its list. An item's lists are read in parallel; each document met is looked up
in the item's other lists directly, which also tells its places there. A
list's best position is where its unbroken run of places seen ends; a document
not met yet has at most the impact that stands next in each list. Reading
stops when the sum of these is strictly below the score of the k-th document,
so ties are never cut off. What a task has found so far bounds its next shard,
and the best of all tasks are ranked together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.words import as_bytes, chunks, record_batches, word_codes
from tabscope.session import checkpoint_folder

ROWS_AT_ONCE = 1024
SHARD_POSTINGS = 1 << 21
FIRST_STEP = 32
ITEMS_AT_ONCE = 2000

# Bytes that part terms: all of ASCII but digits and letters.
GAPS = np.zeros(256, dtype=bool)
GAPS[:0x80] = True
GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def term_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Codes of the different terms of each text, A-Z lower-cased."""
    codes, first = word_codes([(t or "").encode() for t in texts], True, GAPS)
    return [np.unique(codes[low:high]) for low, high in zip(first[:-1], first[1:], strict=True)]


def index(docs: DataFrame, terms: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n`` terms of the whole text, and ``terms`` (places in the sorted ``terms``) with ``tfs``, written to the shared folder.

    Every row has an entry, so that all count in the statistics; a null text
    has no terms. Different terms have one code with a chance of about 2**-60.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary())])
    spark = docs.sparkSession
    asked = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = asked.value
        for batch in record_batches(batches, ROWS_AT_ONCE):
            for start, texts in chunks(as_bytes(batch.column(1))):
                codes, first = word_codes(texts, True, GAPS)
                row = np.repeat(np.arange(len(texts)), np.diff(first))
                at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
                met = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                # Equal terms of a text become one posting with a number.
                postings, tfs = np.unique(row[met] * max(1, len(known)) + at[met], return_counts=True)
                row, at = np.divmod(postings, max(1, len(known)))
                cuts = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
                at, tfs = at.astype("<u4"), tfs.astype("<u4")
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                arrays = [batch.column(0)[start : start + len(texts)], pa.array(np.diff(first), pa.int64())]
                arrays += [pa.array([x[low:high].tobytes() for low, high in spans], pa.binary()) for x in (at, tfs)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    folder = f"{checkpoint_folder(spark)}/postings-{uuid4().hex}"
    narrow.mapInArrow(run, "doc_id bigint, n bigint, terms binary, tfs binary").write.parquet(folder)
    return spark.read.parquet(folder)


def document_frequencies(postings: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term; each task counts what it reads before the sums are brought together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, np.int64)
        for batch in record_batches(batches, ROWS_AT_ONCE):
            raw = b"".join([t.as_py() for t in batch.column(0)])
            held += np.bincount(np.frombuffer(raw, "<u4"), minlength=n_terms)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "df": pa.array(held[some], pa.int64())})

    counts = postings.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    found = np.zeros(n_terms, np.int64)
    found[counts["term"].to_numpy(np.int64)] = counts["df"].to_numpy(np.int64)
    return found


def weights(n_documents: int, frequencies: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the inverse share of documents, rounded down."""
    return np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1))) for df in frequencies.tolist()], np.int64)


def length_norms(lengths: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """Half of the norm is fixed, half grows with the document's length against the mean."""
    return 50 + (50 * lengths * n_documents) // max(1, n_terms)


def impacts(weight: np.ndarray, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm))


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """All numbers of some ranges behind each other."""
    return np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)


class Shard:
    """Impact lists and forward index of some documents; a posting without impact is in neither."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        """Postings ordered by document, documents numbered from 0."""
        there = impact > 0
        doc, term, impact = doc[there], term[there], impact[there]
        order = np.lexsort((doc, -impact, term))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.list_start = np.searchsorted(term[order], np.arange(n_terms + 1))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - self.list_start[term[order]]
        self.term, self.impact, self.place = term, impact, place
        self.doc_start = np.searchsorted(doc, np.arange(n_docs + 1))
        self.slot = np.full(n_terms, -1, np.int64)
        self.met = np.zeros(n_docs, bool)

    def search(self, terms: np.ndarray, k: int, bound: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the best k of one item, and how many documents were looked up.

        ``bound`` is a score that k documents elsewhere reach: documents below
        it need not be found. ``ids`` orders documents of equal score.
        """
        start, size = self.list_start[terms], self.list_start[terms + 1] - self.list_start[terms]
        terms, start, size = terms[size > 0], start[size > 0], size[size > 0]
        self.slot[terms] = np.arange(len(terms))
        offset = np.concatenate([[0], np.cumsum(size + 1)])
        # Each list ends with a place that nothing can see, without impact.
        seen = np.zeros(offset[-1], bool)
        best = np.zeros(len(terms), np.int64)
        top_doc, top_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step, looked_up, met = 0, FIRST_STEP, 0, []
        while True:
            many = np.clip(size - depth, 0, step)
            new = np.unique(self.list_doc[_ranges(start + depth, many)])
            new = new[~self.met[new]]
            self.met[new] = True
            met.append(new)
            if len(new):
                # Direct access: all postings of the new documents, of which those of the item count.
                entries = self.doc_start[new + 1] - self.doc_start[new]
                rows = _ranges(self.doc_start[new], entries)
                slot = self.slot[self.term[rows]]
                asked = slot >= 0
                seen[offset[slot[asked]] + self.place[rows[asked]]] = True
                sums = np.concatenate([[0], np.cumsum(self.impact[rows] * asked)])
                ends = np.cumsum(entries)
                score = sums[ends] - sums[ends - entries]
                looked_up += len(new)
                could = score >= bound
                top_doc, top_score = np.concatenate([top_doc, new[could]]), np.concatenate([top_score, score[could]])
                if len(top_doc) > k:
                    # Scores above the k-th and, of those equal to it, the smallest ids.
                    kth = np.partition(top_score, len(top_score) - k)[len(top_score) - k]
                    keep = np.flatnonzero(top_score >= kth)
                    keep = keep[np.lexsort((ids[top_doc[keep]], -top_score[keep]))[:k]]
                    top_doc, top_score = top_doc[keep], top_score[keep]
                if len(top_doc) == k:
                    bound = max(bound, int(top_score.min()))
            depth, step = depth + step, 2 * step
            limit = 0
            for place in range(len(terms)):
                rest = seen[offset[place] + best[place] : offset[place + 1]]
                best[place] += int(rest.argmin())
                if best[place] < size[place]:
                    limit += int(self.list_impact[start[place] + best[place]])
            if limit < bound or not limit:
                break
        self.slot[terms] = -1
        self.met[np.concatenate(met)] = False
        return top_doc, top_score, looked_up


FOUND = "item bigint, doc_id bigint, score bigint, looked_up bigint"


def best_of_tasks(postings: DataFrame, items: list[np.ndarray], weight: np.ndarray, n_documents: int, n_terms: int, k: int, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """``item`` (its place in ``items``), ``doc_id``, ``score``: each task's best k of each item.

    ``looked_up`` counts the task's direct accesses for the item, on its first row.
    """
    asked = postings.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = asked.value
        tops = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        looked = np.zeros(len(items), np.int64)
        held: list[tuple] = []

        def merge() -> None:
            key = np.concatenate([h[0] for h in held])
            lengths, sizes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            term, tf = np.concatenate([h[3] for h in held]).astype(np.int64), np.concatenate([h[4] for h in held]).astype(np.int64)
            doc = np.repeat(np.arange(len(key)), sizes)
            norm = length_norms(lengths, n_documents, n_terms)
            shard = Shard(doc, term, impacts(weight[term], tf, norm[doc]), len(key), len(weight))
            for place, terms in enumerate(items):
                ids, scores = tops[place]
                bound = int(scores.min()) if len(ids) == k else 1
                found, score, n = shard.search(terms, k, bound, key)
                looked[place] += n
                if len(found):
                    ids, scores = np.concatenate([ids, key[found]]), np.concatenate([scores, score])
                    first = np.lexsort((ids, -scores))[:k]
                    tops[place] = ids[first], scores[first]

        for batch in record_batches(batches, ROWS_AT_ONCE):
            # An unnamed document stands behind all others of its score.
            ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            raw = [b"".join([v.as_py() for v in batch.column(c)]) for c in (2, 3)]
            sizes = np.array([len(v.as_py()) // 4 for v in batch.column(2)], np.int64)
            held.append((ids, batch.column(1).to_numpy(), sizes, np.frombuffer(raw[0], "<u4"), np.frombuffer(raw[1], "<u4")))
            if sum(len(h[3]) for h in held) >= shard_postings:
                merge()
                held.clear()
        if held:
            merge()
        for place, (ids, scores) in enumerate(tops):
            if len(ids):
                n = np.zeros(len(ids), np.int64)
                n[0] = looked[place]
                unnamed = ids == np.iinfo(np.int64).max
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), place), pa.int64()), pa.array(ids, pa.int64(), mask=unnamed), pa.array(scores), pa.array(n)], names=[c.split()[0] for c in FOUND.split(", ")])

    return postings.select("doc_id", "n", "terms", "tfs").mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text", items_at_once: int = ITEMS_AT_ONCE, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k best of all documents for each item.

    Only scores above 0 count; equal scores are ordered by ``doc_id``, rows
    without one last. Rows of ``items`` that share an id are one item with the
    terms of all; null is an id. An item without terms has no rows, nor has any
    where there are no documents. Repeated documents rank one by one, other
    columns are ignored. Items are taken in blocks of ``items_at_once``, whose
    terms are all that reaches the driver, and each block indexes once.
    """
    spark = docs.sparkSession
    named = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    distinct = [r["item_id"] for r in named.select("item_id").distinct().orderBy("item_id").collect()]
    found = []
    for low in range(0, len(distinct), items_at_once):
        block = distinct[low : low + items_at_once]
        wanted = F.col("item_id").isin([i for i in block if i is not None])
        rows = named.where(wanted | F.col("item_id").isNull() if None in block else wanted).collect()
        sets = dict.fromkeys(block, np.zeros(0, np.uint64))
        for row, codes in zip(rows, term_sets([r["text"] for r in rows]), strict=True):
            sets[row["item_id"]] = np.union1d(sets[row["item_id"]], codes)
        terms = np.unique(np.concatenate(list(sets.values())))
        postings = index(docs, terms)
        total = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        weight = weights(total["documents"], document_frequencies(postings, len(terms)))
        places = [np.searchsorted(terms, s) for s in sets.values()]
        best = best_of_tasks(postings, places, weight, total["documents"], total["terms"], k, shard_postings)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block)), "item bigint, item_id bigint")
        found.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    nothing = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found) if found else nothing

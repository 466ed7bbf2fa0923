"""Quality classifier by importance resampling.

Two generative models over hashed words and word pairs, of the target (texts
labelled good) and of the raw corpus, give each text a log ratio. Gumbel noise
is added to it, and the largest k are kept: a sample without replacement,
weighted by the ratio. k is the number of texts that clear a threshold found on
labelled texts the target model has not seen.

A mean says little of a few toxic words in a long text. A third model, of the
words and pairs that labelled toxic texts use more than good ones, scores each
text by its worst window; one over a threshold of its own, found on unseen
labels as well, is not drawn from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.words import as_bytes, chunks, record_batches, windows, word_codes
from tabscope.session import cut_lineage

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
ROWS_AT_ONCE = 2048
TRAIN_FIFTHS = 4
TOXIC_WINDOW = 8
SIGNIFICANT = 4.0  # standard deviations by which toxic texts must use a gram more than good ones
RANGES = 4096


def buckets_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket of each word and of each pair of neighbouring words of each text, case kept."""
    codes, first = word_codes(texts, lower=False)
    shift = np.uint64(64 - BUCKET_BITS)
    singles = (codes >> shift).astype(np.int64)
    pairs = (windows(codes, 2) >> shift).astype(np.int64)
    for start, end in zip(first[:-1], first[1:], strict=True):
        yield singles[start:end], pairs[start : max(start, end - 1)]


def labelled_sample(labels: DataFrame, most_labels: int) -> DataFrame:
    """At most ``most_labels`` labelled ids, chosen and dealt into fifths by their hash: ``doc_id``, ``good``, ``low``, ``toxic``, ``fifth``.

    Good means quality 1 and not toxic, low another quality. Null ids or
    qualities are left out; of rows that repeat an id, all must be good, and one
    is enough for the others.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    toxic = F.coalesce("toxic", F.lit(0)) != 0
    known = known.agg(F.min((F.col("quality") == 1) & ~toxic).alias("good"), F.max(F.col("quality") != 1).alias("low"), F.max(toxic).alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(most_labels)
    return cut_lineage(chosen.withColumn("fifth", F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int")))


def gram_counts(docs: DataFrame, sample: DataFrame, doc_id: str, text: str) -> np.ndarray:
    """Counts by bucket over all texts (row 0) and over good texts of the first fifths (row 1).

    Every task sends its sums once; the result has 2 * BUCKETS numbers,
    whatever the size of the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in record_batches(batches, ROWS_AT_ONCE):
            target = np.array(batch.column(0).to_pylist(), dtype=bool)
            for start, texts in chunks(as_bytes(batch.column(1))):
                found = [np.concatenate(g) for g in buckets_of(texts)]
                totals[0] += np.bincount(np.concatenate(found), minlength=BUCKETS)
                chosen = [g for g, t in zip(found, target[start : start + len(found)], strict=True) if t]
                if chosen:
                    totals[1] += np.bincount(np.concatenate(chosen), minlength=BUCKETS)
        seen = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(totals[0][seen]), pa.array(totals[1][seen])], names=["bucket", "raw", "target"])

    train = sample.where(F.col("good") & (F.col("fifth") < TRAIN_FIFTHS)).select(F.col("doc_id").alias("_id"), F.lit(True).alias("_target"))
    # At most as many ids as labels are sampled.
    marked = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("text")).join(F.broadcast(train), "_id", "left")
    counted = marked.select(F.coalesce("_target", F.lit(False)).alias("target"), "text").mapInArrow(count, "bucket bigint, raw bigint, target bigint")
    totals = np.zeros((2, BUCKETS), dtype=np.int64)
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    totals[:, sums["bucket"].to_numpy(np.int64)] = sums[["raw", "target"]].to_numpy(np.int64).T
    return totals


def log_ratios(totals: np.ndarray, smoothing: float) -> np.ndarray:
    """log(target share / raw share) by bucket; ``smoothing`` grams of the target's size are added to both."""
    raw, target = totals.sum(axis=1)
    if not target:
        return np.zeros(BUCKETS)
    expected = totals[0] * (target / raw)
    return np.log((totals[1] + smoothing) / (expected + smoothing))


def grams_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Full codes of each word and of each pair of neighbouring words of each text, A-Z lower-cased."""
    codes, first = word_codes(texts, lower=True)
    pairs = windows(codes, 2)
    for start, end in zip(first[:-1], first[1:], strict=True):
        yield codes[start:end].view(np.int64), pairs[start : max(start, end - 1)].view(np.int64)


def toxic_weights(docs: DataFrame, sample: DataFrame, doc_id: str, text: str, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of the grams that tell toxic texts of the first fifths from good ones, and log(toxic share / good share) of each.

    Shares are of the texts that hold a gram; grams that toxic texts do not use
    significantly more weigh nothing, or their sum would hide the few that matter.
    Codes have 64 bits, since one shared by a usual gram would make clean texts
    toxic. Every gram of the labelled texts is judged where it is counted; only
    those that tell come to the driver, and each needs as many toxic texts as the
    square of SIGNIFICANT at least.
    """
    train = F.broadcast(sample.where(f"fifth < {TRAIN_FIFTHS} AND (toxic OR good)").select(F.col("doc_id").alias("_id"), "toxic"))
    known = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("text")).join(train, "_id").select("toxic", "text")
    n_texts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n_texts) < 2:
        return np.zeros(0, np.int64), np.zeros(0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches, ROWS_AT_ONCE):
            flags = np.array(batch.column(0).to_pylist(), dtype=bool)
            for start, texts in chunks(as_bytes(batch.column(1))):
                own = [np.unique(np.concatenate(g)) for g in grams_of(texts)]
                grams, place = np.unique(np.concatenate(own), return_inverse=True)
                toxic = np.repeat(flags[start : start + len(own)], [len(g) for g in own])
                held = [np.bincount(place[toxic == side], minlength=len(grams)) for side in (True, False)]
                yield pa.RecordBatch.from_arrays([pa.array(grams), *(pa.array(h.astype(np.int64)) for h in held)], names=["gram", "toxic", "good"])

    counted = known.mapInArrow(count, "gram bigint, toxic bigint, good bigint").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("good").alias("good"))
    counted = counted.withColumn("expected", F.col("good") * F.lit(n_texts[True] / n_texts[False]))
    telling = counted.where(F.col("toxic") - F.col("expected") >= SIGNIFICANT * F.sqrt(F.col("toxic") + F.col("expected")))
    found = telling.select("gram", "toxic", "expected").toPandas().sort_values("gram")
    return found["gram"].to_numpy(np.int64), np.log((found["toxic"] + smoothing) / (found["expected"] + smoothing)).to_numpy(float)


def place_in(grams: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Place of each code among sorted grams, their number for all others."""
    place = np.searchsorted(grams, codes)
    found = place < len(grams)
    found[found] = grams[place[found]] == codes[found]
    return np.where(found, place, len(grams))


def worst_window(words: np.ndarray, pairs: np.ndarray) -> float:
    """The largest sum of weights of TOXIC_WINDOW words in a row, and of the pairs that begin at them."""
    total = np.concatenate([[0.0], np.cumsum(words + np.append(pairs, 0.0)[: len(words)])])
    width = min(TOXIC_WINDOW, len(words))
    return float((total[width:] - total[: len(total) - width]).max()) if width else 0.0


def scores(docs: DataFrame, ratios: np.ndarray, toxic: tuple[np.ndarray, np.ndarray], doc_id: str, text: str, shrinkage: float) -> DataFrame:
    """``doc_id``, ``n_grams``, ``log_weight`` (summed log ratio), ``worst`` (toxic window) and ``score`` (mean log ratio, drawn to 0 for short texts)."""
    shared = docs.sparkSession.sparkContext.broadcast((ratios, toxic[0], np.append(toxic[1], 0.0)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64()), ("worst", pa.float64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket, grams, weights = shared.value
        for batch in record_batches(batches, ROWS_AT_ONCE):
            sizes, sums, worst = [], [], []
            for _, texts in chunks(as_bytes(batch.column(1))):
                for singles, pairs in buckets_of(texts):
                    sizes.append(len(singles) + len(pairs))
                    sums.append(float(by_bucket[singles].sum() + by_bucket[pairs].sum()))
                worst += [worst_window(*(weights[place_in(grams, g)] for g in found)) for found in grams_of(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(worst, pa.float64())], schema=schema)

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    weighed = narrow.mapInArrow(weigh, "doc_id bigint, n_grams bigint, log_weight double, worst double")
    return weighed.withColumn("score", F.col("log_weight") / (F.col("n_grams") + shrinkage))


def threshold_of(good: np.ndarray, bad: np.ndarray, least_kept: float) -> float:
    """The score that parts good from bad best, but never one that refuses more than 1 - least_kept of the good.

    Without any good or any bad scores, minus infinity: nothing is refused.
    """
    if not len(good) or not len(bad):
        return -np.inf
    steps = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(np.sort(good), steps) / len(good)
    wrong = 1 - np.searchsorted(np.sort(bad), steps) / len(bad)
    allowed = kept >= least_kept
    return float(steps[allowed][np.argmax((kept - wrong)[allowed])])


def kth_largest(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest of a column of finite doubles, k between 1 and the number of rows.

    Counts of equal ranges are narrowed to the range that holds it, until that
    holds one value only; at most RANGES counts come to the driver at a time.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low < high:
        place = F.least(F.floor((F.col(key) - low) / (high - low) * RANGES), F.lit(RANGES - 1))
        ranges = rows.where(F.col(key).between(low, high)).groupBy(place.alias("place"))
        ranges = ranges.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for found in sorted(ranges, key=lambda r: -r["place"]):
            if k <= found["n"]:
                low, high = found["low"], found["high"]
                break
            k -= found["n"]
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    most_labels: int = 50_000,
    smoothing: float = 5.0,
    shrinkage: float = 20.0,
    temperature: float = 0.001,
    least_kept: float = 0.998,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_grams``, ``log_weight``, ``score``, ``noisy_score``, ``kept``.

    The models are counted over all texts; only the labels are a bounded
    sample. The noise depends on ``doc_id`` alone, so a run can be repeated and
    rows that repeat share their fate; a null id has the noise of its own hash.
    At the given ``temperature`` it decides only between texts whose scores are
    within some hundredths of the threshold. Texts with a toxic window are not
    drawn from. The two thresholds together refuse no more than 1 - ``least_kept``
    of unseen good texts. Rows tied with the k-th are all kept. Null or empty
    texts score 0. Without usable labels everything is kept. Other columns are
    ignored.
    """
    sample = labelled_sample(labels, most_labels)
    ratios = log_ratios(gram_counts(docs, sample, doc_id, text), smoothing)
    toxic = toxic_weights(docs, sample, doc_id, text, smoothing)
    weighed = cut_lineage(scores(docs, ratios, toxic, doc_id, text, shrinkage))
    # Bounded by the sample, up to rows that repeat an id: one score each.
    unseen = weighed.join(F.broadcast(sample.where(f"(low AND NOT toxic) OR fifth >= {TRAIN_FIFTHS}")), "doc_id").groupBy("doc_id", "good", "low", "toxic")
    unseen = unseen.agg(F.min("score").alias("score"), F.max("worst").alias("worst")).toPandas()
    good, low, harmful = (unseen[c].to_numpy(bool) for c in ("good", "low", "toxic"))
    score, calm = unseen["score"].to_numpy(), -unseen["worst"].to_numpy()
    each = (1 + least_kept) / 2
    threshold = threshold_of(score[good], score[low], each)
    most_toxic = -threshold_of(calm[good], calm[harmful & ~low], each)
    uniform = (F.pmod(F.xxhash64(F.lit("gumbel"), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noisy = cut_lineage(weighed.withColumn("noisy_score", F.col("score") / temperature - F.log(-F.log(uniform))))
    drawn = noisy.where(F.col("worst") <= float(most_toxic))
    k = drawn.where(F.col("score") >= threshold).count()
    lowest = kth_largest(drawn, "noisy_score", k) if k else np.inf
    return noisy.withColumn("kept", (F.col("noisy_score") >= float(lowest)) & (F.col("worst") <= float(most_toxic))).drop("worst")

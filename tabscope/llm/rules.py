"""Quality rules: plain counts, and how far a text's histograms are from its language's.

Two histograms of each text, of character classes and of common words, are
compared with those of all texts of the same language by the Jensen-Shannon
distance (base 2, between 0 and 1). Texts too short to have a shape are not
judged by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.words import SPACE, as_bytes, chunks, mix, record_batches, windows, word_codes
from tabscope.session import cut_lineage

WINDOW = 5
ROWS_AT_ONCE = 1024

# Usual words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was as with be by on not he this are".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y los del se las por un para con no una su al es lo".split(),
}
WORDS = sorted(set().union(*COMMON_WORDS.values()))
# The symbols asked for.
SYMBOLS = "#*$%&|<>"

# Character classes by byte; the bytes that continue a code point count nowhere.
LOWER, UPPER, DIGIT, BLANK, SYMBOL, OTHER_MARK, BEYOND_ASCII, CONTINUED = range(8)
CLASSES = CONTINUED


def _class_table() -> np.ndarray:
    table = np.full(256, OTHER_MARK, dtype=np.uint8)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = LOWER, UPPER, DIGIT
    table[SPACE] = BLANK
    table[[ord(c) for c in SYMBOLS]] = SYMBOL
    table[0x80:0xC0], table[0xC0:] = CONTINUED, BEYOND_ASCII
    return table


_CLASS = _class_table()
_CODES, _ = word_codes([w.encode() for w in WORDS], lower=True)
_ORDER = np.argsort(_CODES)
_SORTED = _CODES[_ORDER]


def _common(codes: np.ndarray) -> np.ndarray:
    """Place of each word among WORDS, len(WORDS) for all others."""
    place = np.searchsorted(_SORTED, codes)
    place[place == len(_SORTED)] = 0
    return np.where(_SORTED[place] == codes, _ORDER[place], len(WORDS))


def repeated_words(codes: np.ndarray) -> int:
    """Words in windows of WINDOW words that the text holds twice or more."""
    runs = windows(codes, WINDOW)
    if len(runs) < 2:
        return 0
    _, which, counts = np.unique(runs, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(codes), dtype=bool)
    for place in range(WINDOW):
        covered[place : place + len(again)] |= again
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


COUNTED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("lang", pa.string()),
        *((name, pa.int64()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")),
        ("chars", pa.list_(pa.int64())),
        ("common", pa.list_(pa.int64())),
        ("high", pa.int64()),
        ("low", pa.int64()),
    ]
)
COUNTED_COLUMNS = (
    "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_chars bigint, "
    "chars array<bigint>, common array<bigint>, high bigint, low bigint"
)


def counts(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """Counts, the two histograms and a 128-bit mark of each row's whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches, ROWS_AT_ONCE):
            rows: list[list] = [[] for _ in range(10)]
            for _, texts in chunks(as_bytes(batch.column(2))):
                exact, first = word_codes(texts, lower=False)
                common = _common(word_codes(texts, lower=True)[0])
                for text_bytes, start, end in zip(texts, first[:-1], first[1:], strict=True):
                    chars = np.bincount(_CLASS[np.frombuffer(text_bytes, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
                    own = exact[start:end]
                    mark = mix(np.array([len(own), len(text_bytes)], np.uint64) + (own * (np.arange(len(own), dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(dtype=np.uint64))
                    values = (
                        end - start,
                        chars.sum() - chars[BLANK],
                        chars[SYMBOL],
                        duplicate_lines(text_bytes),
                        repeated_words(own),
                        chars.sum(),
                        chars,
                        np.bincount(common[start:end], minlength=len(WORDS) + 1),
                        mark.view(np.int64)[0],
                        mark.view(np.int64)[1],
                    )
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
            arrays = [pa.array(c, type=f.type) for c, f in zip(rows, list(COUNTED)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *arrays], schema=COUNTED)

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text"))
    return narrow.mapInArrow(count, COUNTED_COLUMNS)


def divergence(counted: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of an array of counts with their sum from an array of shares; null without counts or shares."""

    def part(share: Column, other: Column) -> Column:
        return F.when(share > 0, 0.5 * share * F.log2(2 * share / (share + other))).otherwise(0.0)

    terms = F.zip_with(counted, shares, lambda c, r: part(c / total, r) + part(r, c / total))
    return F.when((total > 0) & shares.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))))


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    most_chars: float = 0.24,
    most_words: float = 0.20,
    char_noise: float = 1.6,
    word_noise: float = 2.0,
    least_chars: int = 200,
    least_words: int = 50,
    prior_chars: int = 20_000,
    prior_words: int = 4_000,
) -> DataFrame:
    """One row per input row: the counts, both distances, ``base_failed`` and ``kept``.

    ``base_failed`` says: fewer than ten words, or more than a fifth of the words
    in repeated windows. A text is kept if it does not fail and neither distance
    is over its limit, which is ``most_chars`` or ``most_words`` and, for what
    chance does to short texts, the noise divided by the root of the number of
    characters or words. A distance is not judged (and null) for texts with fewer
    than ``least_chars`` characters or ``least_words`` words. A language's
    reference is what its texts hold and, as if of some more texts, ``prior_chars``
    characters and ``prior_words`` words shared out as in all texts together; so
    the rarer a language, the more the whole corpus judges it, by degrees. Equal
    texts count once in the histograms, so copies do not shape them. Null or
    empty texts have no words and fail; a null language is one of its own;
    repeated rows repeat their result; no rows give none; other columns are
    ignored.
    """
    counted = cut_lineage(counts(docs, doc_id, text, lang))
    once = counted.groupBy("lang", "high", "low").agg(F.first("chars").alias("chars"), F.first("common").alias("common"))

    def summed(name: str, size: int) -> Column:
        return F.array(*(F.sum(F.col(name)[i]) for i in range(size))).alias(name)

    # Tables of their own, one row per language, so that nothing is summed again for each text.
    references = cut_lineage(once.groupBy("lang").agg(summed("chars", CLASSES), summed("common", len(WORDS) + 1)))
    pooled = references.agg(summed("chars", CLASSES), summed("common", len(WORDS) + 1)).first()

    def shares(name: str, prior: int) -> Column:
        """Of the sum in each place, with the prior's part of it; null if no text has any."""
        counts = pooled[name]
        if not sum(n or 0 for n in counts):
            return F.lit(None).cast("array<double>").alias(f"{name}_shares")
        expected = F.array(*(F.lit(prior * n / sum(counts)) for n in counts))
        total = F.aggregate(name, F.lit(0).cast("bigint"), lambda a, x: a + x) + prior
        return F.zip_with(name, expected, lambda n, e: (n + e) / total).alias(f"{name}_shares")

    known = cut_lineage(references.select("lang", shares("chars", prior_chars), shares("common", prior_words)))
    both = counted.join(known, "lang", "left")
    long_enough = (F.col("n_chars") >= least_chars) & (F.col("n_words") >= least_words)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = both.withColumns(
        {
            "char_distance": F.when(long_enough, divergence(F.col("chars"), F.col("n_chars"), F.col("chars_shares"))),
            "word_distance": F.when(long_enough, divergence(F.col("common"), F.col("n_words"), F.col("common_shares"))),
            "base_failed": failed,
        }
    )
    limits = (("char_distance", most_chars + char_noise / F.sqrt("n_chars")), ("word_distance", most_words + word_noise / F.sqrt("n_words")))
    near = F.lit(True)
    for distance, limit in limits:
        near = near & F.coalesce(F.col(distance) <= limit, F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & near).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"
    )

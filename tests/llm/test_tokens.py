"""Encoding, packing, archives: exact round trips against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabscope.llm import archives, packing, pieces, words
from tests.llm.conftest import ODD_TEXTS

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcdetion theABC\n  .,ÉéñüßöÀ中😀\t1234567890<>_#▁'|́"


def odd_strings(n=1500, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    own = ["▁", " a", "a  b", "\x00a", "ab" * 2000, "<unk> </s> <0x0A>", "İI Ως σΣ", "don't it's 'sun", "<|endoftext|>x", "ª µ ẞ Ǆ ﬁ", "éa", "a\x1cb\x85c"]
    return texts + own + [t or "" for t in ODD_TEXTS]


def test_pieces_are_those_of_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = pieces.codec(MODEL)
    for text in odd_strings():
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == [1, *library.encode(text, num_threads=1), 2], text
        assert codec.decode(ids) == library.decode(ids), text


def test_decoding_of_any_ids_is_that_of_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = pieces.codec(MODEL)
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([rng.randint(0, 258), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_caches_that_overflow_change_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 3)
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    monkeypatch.setattr(packing, "CACHED_PARTS", 2)
    codec, cache = pieces.PieceCodec(MODEL), packing.WordCache(VOCABULARY)
    text = "one two, three! four five. one two"
    for _ in range(3):
        assert codec.encode(text) == pieces.codec(MODEL).encode(text)
        assert np.frombuffer(cache.encode(text), "<u4").tolist() == Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids


def test_a_word_is_kept_once():
    cache = packing.WordCache(VOCABULARY)
    cache.encode("one two three one, Two three")
    assert set(cache) == {"one", "two", "three", "one,", "Two"}
    assert set(cache.marks) == {"", ","}


def test_a_worker_keeps_no_words_for_other_work():
    cache = words.kept(VOCABULARY, packing.WordCache)
    assert list(words.record_batches([], 512, keep=VOCABULARY)) == [] and words.kept(VOCABULARY, packing.WordCache) is cache
    assert list(words.record_batches([], 512)) == [] and not words._kept


def test_encode_and_decode_on_odd_rows(odd_documents, no_documents):
    rows = pieces.decode(pieces.encode(odd_documents, MODEL), MODEL).collect()
    assert len(rows) == odd_documents.count()
    want = {t or "" for t in ODD_TEXTS}
    assert {r["decoded"] for r in rows} == {t.replace("▁", " ") for t in want}
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    assert pieces.encode(no_documents, MODEL).count() == 0


def test_words_are_those_of_the_library():
    library, cache = Tokenizer.from_file(VOCABULARY), packing.WordCache(VOCABULARY)
    for text in odd_strings():
        assert np.frombuffer(cache.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(20))
def test_fill_finds_the_closest_sum(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
    room = rng.randint(1, 90)
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    chosen = packing.fill(counts, room)
    assert sum(c * n for c, n in chosen.items()) == max(s for s in sums if s <= room)
    assert all(0 < n <= counts[c] for c, n in chosen.items())


def check_packing(rows, documents, capacity):
    """Each id in exactly one piece; sequences gapless from 0 and never over capacity."""
    sequences, pieces_of = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces_of.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert sum(r["length"] for r in rows) == documents
    return sequences


def test_packing_is_whole_and_dense(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["word", "x", "token."]) for _ in range(rng.choice([3, 50, 700, 2100])))) for i in range(600)], "doc_id bigint, text string")
    cut = packing.pieces_of(packing.tokenised(docs, VOCABULARY), 512)
    rows = packing.pack(cut, capacity=512, window_pieces=200).collect()
    library = Tokenizer.from_file(VOCABULARY)
    ids = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 1] for r in docs.collect()}
    sequences = check_packing(rows, sum(map(len, ids.values())), 512)
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert bytes(r["ids"]) == own and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert sum(map(len, ids.values())) > 0.97 * 512 * len(sequences)


def test_packing_on_odd_rows(odd_documents, no_documents):
    cut = packing.pieces_of(packing.tokenised(odd_documents, VOCABULARY)).withColumn("offset", F.lit("clash"))
    rows = packing.pack(cut).collect()
    whole = packing.tokenised(odd_documents, VOCABULARY).collect()
    check_packing(rows, sum(len(r["ids"]) // 4 for r in whole), packing.CAPACITY)
    assert len(whole) == odd_documents.count() and all(len(r["ids"]) >= 4 for r in whole)
    assert packing.pack(packing.pieces_of(packing.tokenised(no_documents, VOCABULARY))).count() == 0


def captures(df, least_bytes=0):
    at = F.timestamp_seconds(F.coalesce("page_id", F.lit(0)))
    return archives.with_revisits(df, "page_id", "url", "html", at, least_bytes)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://www.Example.org/b?x=1#top", "same"),
        (2, "https://user@example.org:8080/b", "same"),
        (3, None, None),
        (4, "http://a.org/\r\nWARC/1.0", ""),
        (5, "http://a.org/", "é\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n"),
        (5, "http://a.org/", "other payload"),
        (6, "not a url [", "same"),
        (None, "http://b.org", "same"),
        (7, "http://b.org", "x" * 200_000),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, payload string")


def test_archives_round_trip(spark, pages, tmp_path):
    import base64
    import hashlib

    folder = str(tmp_path / "warc")
    archives.write_archives(captures(pages), folder)
    rows = archives.merged_index(archives.sorted_runs(spark, folder)).collect()
    assert len(rows) == pages.count()
    want = {(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()}
    digest = {base64.b32encode(hashlib.sha1(p).digest()).decode(): p for _, p in want}
    for r in rows:
        payload = digest[r["payload_digest"]]
        assert (r["page_id"], payload) in want and r["payload_bytes"] == len(payload)
        assert r["block_bytes"] == (0 if r["record_type"] == "revisit" else len(payload))
    refers = {r["page_id"]: r["refers_to"] for r in rows}
    assert refers[1] == refers[2] == 6 and refers[3] == 4 and refers[6] is refers[None] is refers[4] is None
    order = [tuple((r[c] is not None, r[c]) for c in archives.SORT_KEY) for r in rows]
    assert order == sorted(order)
    assert {r["record_type"] for r in captures(pages, 5).where("payload_bytes < 5").collect()} == {"response"}


def test_no_pages_make_an_empty_index(spark, pages, tmp_path):
    folder = str(tmp_path / "none")
    archives.write_archives(captures(pages.limit(0)), folder)
    assert archives.merged_index(archives.sorted_runs(spark, folder)).count() == 0


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(runs):
    rng = random.Random(runs)
    entry = lambda: {"url_key": rng.choice("abc"), "captured_at": rng.choice("12"), "page_id": rng.choice([None, 1, 2]), "archive": "x", "place": rng.randint(0, 9)}
    lists = [sorted((entry() for _ in range(rng.randint(0, 9))), key=archives._order) for _ in range(runs)]
    merged = list(archives.LoserTree(lists))
    assert [archives._order(e) for e in merged] == sorted(archives._order(e) for r in lists for e in r)


def test_url_keys():
    assert archives.url_key("http://www.Example.org:80/A?b#c") == "org,example)/a?b"
    assert archives.url_key("") == ")/"


def test_crc_is_that_of_the_ids(spark):
    row = spark.createDataFrame([(bytearray(b"\x01\x00\x00\x00"),)], "ids binary").select(F.crc32("ids")).first()
    assert row[0] == zlib.crc32(b"\x01\x00\x00\x00")


def test_an_altered_payload_is_an_error(spark, pages, tmp_path):
    folder = str(tmp_path / "altered")
    made = captures(pages)
    # Another payload of equal length, below the digest of the first.
    altered = made.withColumn("payload", F.translate("payload", "abcdefghi", "bcdefghia"))
    assert altered.where("record_type = 'response'").exceptAll(made.where("record_type = 'response'")).count() > 0
    archives.write_archives(altered, folder)
    with pytest.raises(Exception, match="does not hold the payload it names"):
        archives.sorted_runs(spark, folder).collect()

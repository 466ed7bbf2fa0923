"""Shards of token ids: the succinct file against plain arrays, and whole texts against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabscope.llm import wavelet
from tests.llm.test_tokens import odd_strings

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def file_of(ids, lengths=None):
    documents = np.array([(n, 0, size) for n, size in enumerate(lengths or [len(ids)])], wavelet.DOCUMENT)
    return wavelet.WaveletFile(wavelet.build(np.array(ids, "<u4"), documents) + b"\n")


@pytest.mark.parametrize("n,largest", [(0, 1), (1, 0), (1, 1), (7, 3), (1000, 70_000), (65_536, 5), (65_537, 50_256), (200_000, 50_256)])
def test_file_answers_as_an_array_does(n, largest):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) * rng.integers(0, 2 + largest // 50, n), largest).astype("<u4")
    file = file_of(ids)
    assert file.tokens().tolist() == ids.tolist()
    for place in rng.integers(0, n, 30).tolist() if n else []:
        assert file.access(place) == ids[place]
    for token in {0, 1, largest, largest + 1, 1 << 20, *(ids[:5].tolist())}:
        places = np.flatnonzero(ids == token)
        low, high = sorted(rng.integers(0, n + 1, 2).tolist())
        assert file.count(token) == len(places)
        assert file.count(token, low, high) == ((places >= low) & (places < high)).sum()
        assert [file.find(token, k) for k in range(0, len(places), 1 + len(places) // 20)] == places[:: 1 + len(places) // 20].tolist()
        with pytest.raises(IndexError):
            file.find(token, len(places))


def test_damage_is_an_error():
    content = wavelet.build(np.arange(1000, dtype="<u4"), np.array([(1, 0, 1000)], wavelet.DOCUMENT))
    with pytest.raises(ValueError):
        wavelet.WaveletFile(b"none" + content)
    with pytest.raises(ValueError):
        wavelet.WaveletFile(content[:-10])


def test_repeated_ids_take_little_room():
    ids = np.tile(np.arange(500, dtype="<u4"), 2000)
    assert len(wavelet.build(ids, np.array([(1, 0, len(ids))], wavelet.DOCUMENT))) < ids.nbytes / 10


@pytest.fixture(scope="module")
def shards(spark, tmp_path_factory):
    """Odd texts in no order, some ids missing or repeated, in many small shards; and the ids expected, in order."""
    texts = odd_strings(150)
    rows = [(None if i % 50 == 7 else i - i % 20 // 19, t, "x") for i, t in enumerate(texts)] + [(None, None, None), (5, None, "y")]
    random.Random(3).shuffle(rows)
    folder = str(tmp_path_factory.mktemp("shards") / "own")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, partition string").repartition(6)
    wavelet.write_shards(docs, VOCABULARY, folder, end_id=2, shard_tokens=500)
    library = Tokenizer.from_file(VOCABULARY)
    want = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in rows]
    return folder, want


def test_documents_come_back_in_order(spark, shards):
    folder, want = shards
    read = wavelet.read_documents(spark, folder).cache()
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in read.collect()), key=repr) == sorted(want, key=repr)
    rows = wavelet.with_starts(read.selectExpr("doc_id", "n_tokens", "partition", "place", "crc32(ids) AS crc")).orderBy("start").collect()
    assert rows[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sorted(r["crc"] for r in rows) == sorted(zlib.crc32(np.array(t, "<u4").tobytes()) for _, t in want)


def test_counts_and_occurrences_without_decoding(spark, shards):
    folder, want = shards
    tokens = [2, 64, 220, 50_256, 50_000]
    found = {r["token"]: r["n"] for r in wavelet.count_tokens(spark, folder, tokens).collect()}
    assert found == {t: sum(ids.count(t) for _, ids in want) for t in tokens}
    rows = sorted(((r["token"], r["doc_id"], r["place"]) for r in wavelet.occurrences(spark, folder, tokens).collect()), key=repr)
    assert rows == sorted(((t, i, p) for i, ids in want for p, t in enumerate(ids) if t in tokens), key=repr)


def test_shards_of_odd_rows(spark, odd_documents, no_documents, tmp_path):
    for name, docs in (("odd", odd_documents), ("none", no_documents)):
        wavelet.write_shards(docs, VOCABULARY, str(tmp_path / name), end_id=2)
        rows = wavelet.with_starts(wavelet.read_documents(spark, str(tmp_path / name))).collect()
        assert len(rows) == docs.count() and sum(r["n_tokens"] for r in rows) == max((r["start"] + r["n_tokens"] for r in rows), default=0)

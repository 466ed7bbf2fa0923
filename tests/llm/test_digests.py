"""What the registered queries return, row by row, against the libraries and plain Python, on the smallest test tables."""

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabscope.llm import queries
from tests.llm.test_alignment import NAMES, plainly

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def texts():
    rows = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def result(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


KINDS = [
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def test_secrets(spark, texts):
    rows = {r["doc_id"]: r for r in result(spark, "op2_secret_ownership")}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        spans = sorted((m.start(), no, f"{kind}:{m.start()}:{m.end()}") for no, (kind, pattern, good) in enumerate(KINDS) for m in pattern.finditer(text) if good(m))
        base = [s for _, _, s in spans]
        assert [rows[i][f"n_{k}"] for k, _, _ in KINDS] == [sum(s.startswith(k + ":") for s in base) for k, _, _ in KINDS]
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(rows[i]["spans"].split(",")) | {""}


def test_pieces(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r["doc_id"]: r for r in result(spark, "op4_sentencepiece_round_trip")}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = [1, *library.encode(text, num_threads=1), 2]
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert rows[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_rules(spark, texts):
    rows = {r["doc_id"]: r for r in result(spark, "op8_divergence_rules")}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        counts = {w: windows.count(w) for w in set(windows)} if len(windows) < 3000 else {}
        if windows and not counts:
            for w in windows:
                counts[w] = counts.get(w, 0) + 1
        repeated = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(repeated) > 20 * len(words)) and not (r["base_failed"] and r["kept"])


def test_packing(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = {}, {}
    for r in result(spark, "op9_pack_minimum_slack"):
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == texts.keys()
    for i, text in texts.items():
        ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() and sum(r["length"] for r in own) <= 2048
    filled = sum(r["length"] for own in sequences.values() for r in own) / (2048 * len(sequences))
    assert filled > 0.98


def test_token_shards(spark, texts):
    library, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    rows = {r["doc_id"]: r for r in result(spark, "op12_wavelet_shards")}
    assert rows.keys() == texts.keys()
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_alignment(spark, texts):
    rows = result(spark, "op13_coalesced_alignment")
    assert sorted(tuple(r[n] for n in NAMES) for r in rows) == sorted(plainly(list(texts.items())))

"""Alignment of two tokenizers against the definition, token by token."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabscope.llm import alignment, bytelevel
from tests.llm.conftest import ODD_TEXTS
from tests.llm.test_tokens import odd_strings

VOCABULARY, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plainly(texts):
    """The contract's columns of each (id, text), by the libraries and loops."""
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    names, counts, found = bytelevel.byte_names(), Counter(), []
    for i, text in texts:
        raw = b" " + (text or "").encode()
        a = [(t.ids, t.tokens) for t in [library.encode(" " + (text or ""), add_special_tokens=False)]][0]
        a = list(zip(a[0], (bytes(names[c] for c in t) for t in a[1]), strict=True))
        b = [(n, bytes([n - 3]) if pieces.is_byte(n) else pieces.id_to_piece(n).replace("▁", " ").encode()) for n in pieces.encode(text or "")]
        if not text or b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            found.append((i, [], [], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(t) for _, t in a]).tolist(), np.cumsum([len(t) for _, t in b]).tolist()
        groups, rest_a, rest_b = [], list(zip(a, ends_a, strict=True)), list(zip(b, ends_b, strict=True))
        for high in sorted(set(ends_a) & set(ends_b)):
            sides = []
            for rest in (rest_a, rest_b):
                own = []
                while not own or own[-1][1] < high:
                    own.append(rest.pop(0))
                sides.append(",".join(str(n) for (n, _), _ in own))
            groups.append("|".join(sides))
        at_end = {e: [y for (y, _), f in zip(b, ends_b, strict=True) if e == f] for e in set(ends_a)} if len(a) < 300 else {f: [y] for (y, _), f in zip(b, ends_b, strict=True)}
        links = [(x, y) for (x, _), e in zip(a, ends_a, strict=True) for y in at_end.get(e, [])]
        counts.update(links)
        found.append((i, a, b, groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(i, len(a), len(b), len(g), len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), d) for i, a, b, g, ls, d in found]


@pytest.fixture(scope="module")
def texts():
    return [*enumerate([*odd_strings(120), *ODD_TEXTS, "the cat sat on the mat " * 30, "x</s> <unk> <0x41> <|endoftext|>"]), (3, "a copy"), (None, "a copy")]


@pytest.mark.parametrize("head", [0, 5, 1 << 20])
def test_alignment_is_the_definition(spark, texts, head):
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id bigint, text string, pairs string").repartition(5)
    rows = alignment.with_counts(alignment.align(docs, VOCABULARY, MODEL), MODEL, head_pairs=head).collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in rows), key=repr) == sorted(plainly(texts), key=repr)


def test_other_relations(spark):
    docs = spark.createDataFrame([(1, "internationalisation of tokenizers, notwithstanding their incompatibilities")], "doc_id bigint, text string")
    links = {r: alignment.align(docs, VOCABULARY, MODEL, related=r).first()["n_links"] for r in alignment.RELATIONS}
    assert links["same"] < links["ends"] < links["overlap"], links


def test_overlaps_are_of_one_group():
    pair = alignment.pair_of(VOCABULARY, MODEL)
    a, b = pair.ids(odd_strings(200, seed=5))
    a, b = pair.tokens(a, 0), pair.tokens(b, 1)
    group_a, group_b, groups = alignment.coalesce(a, b)
    at_a, at_b = alignment.overlaps(a, b)
    assert (group_a[at_a] == group_b[at_b]).all()
    assert len(np.unique(group_a)) == len(np.unique(group_b)) == groups == len(np.intersect1d(a.end, b.end))
    assert len(at_a) == sum(int(((b.start < e) & (b.end > s)).sum()) for s, e in zip(a.start, a.end, strict=True))


def test_alignment_on_odd_rows(odd_documents, no_documents):
    rows = alignment.with_counts(alignment.align(odd_documents, VOCABULARY, MODEL), MODEL)
    assert rows.columns == list(NAMES[:5]) + ["groups_sha256", "n_best", "count_sum"]
    assert rows.count() == odd_documents.count()
    assert all(r["groups_sha256"] == "" and r["count_sum"] == 0 for r in rows.where("n_a = 0").collect())
    assert alignment.with_counts(alignment.align(no_documents, VOCABULARY, MODEL), MODEL).count() == 0


def test_byte_codec_is_the_library():
    for specials in (True, False):
        library, codec = Tokenizer.from_file(VOCABULARY), bytelevel.ByteCodec(VOCABULARY, specials)
        library.encode_special_tokens = not specials
        assert codec.fast is not None
        for text in [*odd_strings(), " " * 400_000 + "a", "\n" * 1_100_000]:
            assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]
        codec.fast = None
        assert codec.encode("by the library <|endoftext|>").tolist() == library.encode("by the library <|endoftext|>", add_special_tokens=False).ids
    # Both libraries class every character alike.
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c % 7 == 3]
    codec = bytelevel.byte_codec(VOCABULARY, False)
    encoded = library.encode_batch_fast([f"a{c}a 1{c}1 .{c}. {c} {c}" for c in characters], add_special_tokens=False)
    assert all(codec.encode(f"a{c}a 1{c}1 .{c}. {c} {c}").tolist() == e.ids for c, e in zip(characters, encoded, strict=True))

"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tabscope.llm import best_position
from tests.llm.conftest import ODD_TEXTS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plainly(docs, items, k):
    """Every document's score for every item, by the definition."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_all, l_all = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    rows = []
    for item, words in asked.items():
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_all) // max(1, l_all)
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        rows += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(scored[:k], 1)]
    return sorted(rows, key=repr)


def corpus(seed, n, words=60):
    """Texts of Zipf words, copies among them, so that many scores are equal."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Ñandú", "中文", "x_y", "É"]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(1, 40))) for _ in range(n)]
    texts += texts[: n // 3] * 2
    return [(i, t) for i, t in enumerate(texts)], [(i, " ".join(rng.sample(vocabulary, rng.randint(1, 12)))) for i in range(12)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("k,shard,at_once", [(5, 1, 100), (50, 300, 5), (3, 1 << 20, 100)])
def test_search_is_the_definition(spark, seed, k, shard, at_once):
    docs, items = corpus(seed, 150)
    items += [(2, "a second text of an item w7"), (None, "w3 w4"), (70, None), (71, "never-met"), (72, "w1 W1 w1")]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((docs, "doc_id bigint, text string"), (items, "item_id bigint, text string"))]
    rows = best_position.search(frames[0].repartition(4), frames[1], k, items_at_once=at_once, shard_postings=shard).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == plainly(docs, items, k)


def test_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "word one"), (2, ""), (3, "aaa é 中文")], "item_id bigint, text string").selectExpr("*", "'x' AS item", "1 AS rank")
    rows = best_position.search(odd_documents, items, 50).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert sorted((tuple(r) for r in rows), key=repr) == plainly(docs, [(1, "word one"), (2, ""), (3, "aaa é 中文")], 50)
    assert len(docs) > len(ODD_TEXTS)
    assert best_position.search(no_documents, items, 50).count() == 0
    assert best_position.search(odd_documents, items.limit(0), 50).count() == 0


def postings_of(docs):
    words = sorted({t for _, text in docs for t in terms(text)})
    rows = [(i, words.index(t), n) for i, (_, text) in enumerate(docs) for t, n in sorted(Counter(terms(text)).items())]
    rows.sort()
    return words, [np.array(c, np.int64) for c in zip(*rows, strict=True)]


def test_reading_stops_before_the_lists_end():
    """Where the best documents are plain, few others are looked up; nothing is lost by it."""
    rng = np.random.default_rng(4)
    n_docs, n_terms = 20_000, 6
    doc, term = np.repeat(np.arange(n_docs), n_terms), np.tile(np.arange(n_terms), n_docs)
    impact = (rng.pareto(1.0, n_docs)[doc] * 1000 + rng.integers(0, 50, len(doc))).astype(np.int64)
    shard = best_position.Shard(doc, term, impact, n_docs, n_terms)
    asked = np.array([0, 2, 3, 5])
    ids = rng.permutation(n_docs)
    total = np.bincount(doc, np.isin(term, asked) * impact, minlength=n_docs).astype(np.int64)
    want = np.lexsort((ids, -total))[:10]
    found, score, looked_up = shard.search(asked, 10, 1, ids)
    assert dict(zip(found.tolist(), score.tolist(), strict=True)) == {d: total[d] for d in want.tolist()}
    assert looked_up < n_docs / 20
    again, _, fewer = shard.search(asked, 10, int(score.min()), ids)
    assert set(again.tolist()) == set(found.tolist()) and fewer <= looked_up


def test_ties_at_the_end_go_to_the_smallest_ids():
    n = 500
    shard = best_position.Shard(np.arange(n), np.zeros(n, np.int64), np.full(n, 7), n, 1)
    ids = np.arange(n)[::-1].copy()
    found, _, looked_up = shard.search(np.array([0]), 50, 1, ids)
    assert sorted(ids[found].tolist()) == list(range(50)) and looked_up == n


def test_impacts_are_whole_numbers():
    words, (doc, term, tf) = postings_of(corpus(9, 40)[0])
    n = np.bincount(doc, tf).astype(np.int64)
    norm = best_position.length_norms(n, len(n), int(n.sum()))
    weight = best_position.weights(len(n), np.bincount(term, minlength=len(words)))
    found = best_position.impacts(weight[term], tf, norm[doc])
    assert found.dtype == np.int64
    assert found.tolist() == [int(weight[t]) * (10**9 * int(f) // (1000 * int(f) + 20 * int(norm[d]))) for d, t, f in zip(doc, term, tf, strict=True)]

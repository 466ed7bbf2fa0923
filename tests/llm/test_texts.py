"""Near duplicates, rules, classifier: against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tabscope.llm import importance, near_text, rules
from tabscope.llm.graph import components, spanning
from tabscope.llm.words import shingle_sets, word_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "ba ke li mo nu par sel tir von wex".split()


def prose(rng, n):
    return [rng.choice(SYLLABLES) + rng.choice(SYLLABLES) + rng.choice(["", "a", "es"]) for _ in range(n)]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = WORD.findall(lowered(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def groups(nodes, links):
    low = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def near_texts(seed=3):
    """Copies with more and more changed words, a chain, copies in another case, and many near copies of one text."""
    rng = random.Random(seed)
    texts = [" ".join(prose(rng, rng.randint(1, 150))) for _ in range(60)]
    for _ in range(150):
        words = rng.choice(texts[:20]).split()
        for _ in range(rng.randint(0, max(1, len(words) // 12))):
            words[rng.randrange(len(words))] = rng.choice(prose(rng, 1))
        texts.append(" ".join(words))
    base = prose(rng, 140)
    for _ in range(200):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(140)] = "odd" + rng.choice(SYLLABLES)
        texts.append(" ".join(words))
    texts += [texts[0].upper(), texts[1].replace(" ", "\n  ")]
    return texts


def test_near_duplicates_are_those_of_brute_force(spark):
    texts = near_texts()
    sets = [shingles(t) for t in texts]
    links = []
    for a in range(len(sets)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                links.append((a, b))
    want = groups(range(len(sets)), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in near_text.near_duplicates(docs).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(s) for k, s in enumerate(sets)}
    assert all(r["kept"] == (k == want[k]) for k, r in got.items())


@pytest.mark.parametrize(("few", "block", "per_member"), [(2, 8, 0), (2, 8, 4), (64, 4096, 4)])
def test_template_families_below_the_threshold(spark, monkeypatch, few, block, per_member):
    """Texts of one template at 0.5 to 0.7 and a few at 0.75 or more, by joins, by blocks of signatures, and by whole crowds."""
    monkeypatch.setattr(near_text, "FEW", few)
    monkeypatch.setattr(near_text, "BLOCK_SIGNATURES", block)
    monkeypatch.setattr(near_text, "BLOCK_TEXTS", block)
    monkeypatch.setattr(near_text, "PAIRS_PER_MEMBER", per_member)
    rng = random.Random(17)
    texts = []
    for changed in (2, 3, 4, 6):
        template = prose(rng, 120)
        for _ in range(25):
            words = list(template)
            for place in rng.sample(range(120), changed):
                words[place] = f"own{rng.randint(0, 10**9)}"
            texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_text.near_duplicates(docs).collect()}
    assert got == groups(range(len(sets)), links)


def test_near_duplicates_are_the_same_without_broadcasts(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(near_texts())), "doc_id bigint, text string")
    want = sorted(near_text.near_duplicates(docs).collect())
    for name, value in (("BROADCAST_IDS", 0), ("BROADCAST_ROWS", 0), ("PAIRS_PER_TASK", 1), ("SIGNATURES_PER_PART", 8), ("LINKS_PER_PART", 8)):
        monkeypatch.setattr(near_text, name, value)
    assert sorted(near_text.near_duplicates(docs).collect()) == want


def test_near_duplicates_of_few_texts_take_few_tasks(spark):
    """Shuffles of 64 parts that nothing merges: most steps are on tables that fill one part."""
    docs = spark.createDataFrame(list(enumerate(near_texts())), "doc_id bigint, text string")
    tracker = spark.sparkContext.statusTracker()
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    earlier = set(tracker.getJobIdsForGroup())
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        near_text.near_duplicates(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for job in set(tracker.getJobIdsForGroup()) - earlier for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    assert 0 < tasks < 4000, tasks  # 8859 before small tables were gathered, 2529 after


def test_blocks_of_a_crowd_emit_in_proportion_to_members(spark):
    """All signatures alike, all labels different: every pair passes, and as many links come back as members, not pairs."""
    rows = [(1, n, 100, [7] * near_text.PACKED, n, n) for n in range(200)]
    inside = spark.createDataFrame(rows, "key bigint, rep bigint, n bigint, s array<bigint>, label bigint, zone bigint")
    pairs = near_text.likely_in_blocks(inside, 75, 0.2).collect()
    assert len(pairs) <= 2 * len(rows) and all(p["dense"] for p in pairs)
    joined = components(spark.createDataFrame(pairs))
    assert {r["component"] for r in joined.collect()} == {0} and joined.count() == 200


@pytest.mark.parametrize("per_part", [3, 100_000])
def test_components_look_hot_labels_up(spark, monkeypatch, per_part):
    from tabscope.llm import graph

    monkeypatch.setattr(graph, "LINKS_PER_PART", per_part)
    monkeypatch.setattr(graph, "HOT_SHARE", 8)
    links = [(1, n) for n in range(2, 60)] + [(n, n + 1) for n in range(100, 130)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: 1 for n in range(1, 60)} | {n: 100 for n in range(100, 131)}


def test_near_duplicates_on_odd_rows(odd_documents, no_documents):
    rows = near_text.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r["doc_id"]: r for r in rows}
    # Texts without words link with nothing; rows with a null id are left alone.
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["kept"] for i in (0, 1, 2, 3))
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert [r["component_id"] for r in rows if r["doc_id"] == 4] == [4, 4, 4]
    assert near_text.near_duplicates(no_documents).count() == 0


def test_rows_that_repeat_an_id_are_one_document(spark):
    rng = random.Random(5)
    a, b = (" ".join(prose(rng, 40)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (2, b), (9, a), (9, b)], "doc_id bigint, text string")
    assert {r["component_id"] for r in near_text.near_duplicates(docs).collect()} == {1}


def test_signature_estimates_similarity(spark):
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    packed = [near_text.pack(near_text.minima_of(s)).view(np.int64).tolist() for s in (a, b)]
    row = spark.createDataFrame([packed], "a array<bigint>, b array<bigint>")
    from pyspark.sql import functions as F

    estimate = row.select(near_text.similarity_estimate(F.col("a"), F.col("b"))).first()[0]
    assert abs(estimate - 1500 / 2500) < 0.2
    assert row.select(near_text.similarity_estimate(F.col("a"), F.col("a"))).first()[0] == 1


def test_word_codes_tell_words_apart():
    texts = [b"one two one", b"", b"  One\x0btwo ", "né nè".encode()]
    codes, first = word_codes(texts, lower=True)
    assert np.diff(first).tolist() == [3, 0, 2, 2]
    assert codes[0] == codes[2] == codes[3] and codes[1] == codes[4] and len(set(codes.tolist())) == 4
    assert [len(s) for s in shingle_sets([b"a b c d", b"a b c d e a b c d e", b""], 5)] == [1, 5, 0]


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(1)
    path = list(range(100, 160))
    rng.shuffle(path)
    links = list(zip(path, path[1:], strict=False)) + [(5, n) for n in range(6, 90)] + [(200, 200), (None, 3)]
    df = components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in df.collect()} == {n: 100 for n in path} | {n: 5 for n in range(5, 90)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_spanning_connects_what_the_marks_connect():
    met = np.array([[1, 1, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0], [0, 0, 1, 0]], bool)
    of_row, label = spanning(met)
    assert of_row.tolist() == [0, 0, 4, 2] and label.tolist() == [0, 0, 2, 3]
    assert [x.size for x in spanning(np.zeros((2, 0), bool))] == [2, 0]


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(words)
    counts = (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return *counts, n < 10 or 100 * len(covered) > 20 * n


def distance(p, q):
    total_p, total_q, out = sum(p), sum(q), 0.0
    for x, y in zip(p, q, strict=True):
        x, y = x / total_p, y / total_q
        m = (x + y) / 2
        out += sum(0.5 * v * math.log2(v / m) for v in (x, y) if v)
    return math.sqrt(max(out, 0))


def shape(text):
    kinds = [str.islower, str.isupper, str.isdigit, lambda c: c in " \t\n\v\f\r", lambda c: c in "#*$%&|<>"]
    chars = [0] * 7
    for c in text:
        chars[6 if ord(c) > 127 else next((i for i, k in enumerate(kinds) if k(c)), 5)] += 1
    words = Counter(lowered(w) for w in WORD.findall(text))
    common = [words.get(w, 0) for w in rules.WORDS]
    return chars, [*common, words.total() - sum(common)]


def test_rules_are_those_of_brute_force(spark, odd_documents):
    rng = random.Random(4)
    clean = [" ".join(rng.choice(["the", "of", "and", *prose(rng, 3)]) for _ in range(rng.randint(60, 200))) + "." for _ in range(60)]
    junk = [" ".join(w.upper() + "!!$$" for w in prose(rng, 120)), "the same five words again " * 30, "line\n" * 20]
    texts = clean + junk + clean[:1] * 5
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    shapes = [shape(t) for t in dict.fromkeys(texts)]
    reference = [[sum(column) for column in zip(*side, strict=True)] for side in zip(*shapes, strict=True)]
    got = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute_rules(text)
        if len(text) >= 200 and r["n_words"] >= 50:
            own = shape(text)
            assert r["char_distance"] == pytest.approx(distance(own[0], reference[0]), abs=1e-9)
            assert r["word_distance"] == pytest.approx(distance(own[1], reference[1]), abs=1e-9)
        else:
            assert r["char_distance"] is None and r["word_distance"] is None
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in range(60, 63))
    odd = rules.judge(odd_documents).collect()
    assert len(odd) == odd_documents.count()
    for r in odd:
        text = odd_documents.where(f"doc_id <=> {r['doc_id'] if r['doc_id'] is not None else 'NULL'}").first()["text"]
        if r["doc_id"] is not None:
            assert tuple(r)[1:7] == brute_rules(text)


def test_rules_without_documents(no_documents):
    assert rules.judge(no_documents).count() == 0


def test_classifier_refuses_unseen_junk_and_keeps_clean(spark):
    rng = random.Random(6)
    clean = [" ".join(prose(rng, 80)) for _ in range(300)]
    junk = [" ".join(w + "%%%" for w in prose(rng, 80)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id bigint, text string")
    labels = [(i, int(i < 300), 0) for i in range(0, 360, 2)] + [(None, 1, 0), (5, None, 0)]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = importance.resample(docs, labels).collect()
    held_out = [r for r in rows if r["doc_id"] % 2]
    right = sum(r["kept"] == (r["doc_id"] < 300) for r in held_out)
    assert right / len(held_out) > 0.98
    again = importance.resample(docs, labels).collect()
    assert sorted(rows) == sorted(again)


def test_classifier_refuses_a_few_toxic_words_in_long_texts(spark):
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(100, 600)) for _ in range(1500)]
    for words in texts[1000:]:
        for _ in range(rng.randint(2, 4)):
            words[rng.randrange(len(words))] = rng.choice(["vile", "Scum", "rot", "filth"])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 1000)) for i in range(0, 1500, 2)], "doc_id bigint, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in importance.resample(docs, labels).collect()}
    unseen = range(1, 1500, 2)
    assert np.mean([kept[i] for i in unseen if i < 1000]) > 0.98
    assert np.mean([kept[i] for i in unseen if i >= 1000]) < 0.05


def test_classifier_scores_are_log_ratios():
    texts = [b"a b a", b"c", b""]
    totals = np.zeros((2, importance.BUCKETS), np.int64)
    found = list(importance.buckets_of(texts))
    assert [len(s) + len(p) for s, p in found] == [5, 1, 0]
    for place, (singles, pairs) in enumerate(found):
        for bucket in [*singles, *pairs]:
            totals[0, bucket] += 1
            totals[1, bucket] += place == 0
    ratios = importance.log_ratios(totals, 1.0)
    a, c = found[0][0][0], found[1][0][0]
    assert ratios[a] == pytest.approx(math.log((2 + 1) / (2 * 5 / 6 + 1)))
    assert ratios[c] == pytest.approx(math.log(1 / (1 * 5 / 6 + 1)))


def test_classifier_on_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = importance.resample(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(r["score"] == 0 for r in rows if r["n_grams"] == 0)
    assert all(r["kept"] for r in importance.resample(odd_documents, labels.limit(0)).collect())
    assert importance.resample(no_documents, labels).count() == 0


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000])
def test_kth_largest(spark, k):
    rng = random.Random(9)
    values = [rng.choice([0.0, -1e300, 5.5, rng.gauss(0, 1), rng.gauss(0, 1e-9)]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_threshold_keeps_the_good():
    good, bad = np.linspace(0, 1, 1000), np.linspace(-5, 0.5, 1000)
    assert np.mean(good >= importance.threshold_of(good, bad, 0.99)) >= 0.99
    assert importance.threshold_of(good, bad[:0], 0.99) == -np.inf


def test_the_fiftieth_text_changes_no_verdict(spark):
    """A language's reference grows by degrees: junk among 5, 49 or 50 texts is refused, clean texts stay; what is not judged is null."""
    rng = random.Random(8)
    common = "the of and to in a is that for it was".split()
    clean = lambda: " ".join(rng.choice([*common, *prose(rng, 12)]) for _ in range(200))
    rows = [(i, clean(), "en") for i in range(80)]
    for lang, n in (("x", 5), ("y", 49), ("z", 50)):
        first = len(rows)
        rows += [(first + i, clean(), lang) for i in range(n - 1)] + [(10_000 + n, " ".join("@%&^~" + str(rng.randint(0, 999)) for _ in range(300)), lang)]
    rows.append((20_000, "short but varied text of more than ten words in all here", "w"))
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert [got[10_000 + n]["kept"] for n in (5, 49, 50)] == [False] * 3
    assert all(got[i]["kept"] for i, _, _ in rows if i < 10_000)
    assert got[20_000]["kept"] and got[20_000]["char_distance"] is None and got[20_000]["word_distance"] is None

"""The pipeline on a planted corpus, and its stages on odd rows."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_texts import groups, prose, shingles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def clean_text(rng):
    return " ".join(rng.choice(["the", "of", "and", *prose(rng, 4)]) for _ in range(rng.randint(60, 160)))


@pytest.fixture(scope="module")
def corpus():
    """Clean texts 0-149, repeated lines 200-209, shouting 210-229, copies 300-319, secrets in 400-404."""
    rng = random.Random(11)
    clean = [clean_text(rng) for _ in range(150)]
    texts = dict(enumerate(clean))
    texts |= {200 + i: "the same few words over again\n" * 20 for i in range(10)}
    texts |= {210 + i: " ".join(w.upper() + "!!" for w in prose(rng, 100)) for i in range(20)}
    texts |= {300 + i: clean[i] if i % 2 else clean[i] + " tail" for i in range(20)}
    texts |= {400 + i: f"{clean_text(rng)} token = 'zq9XkLm2PqRs7Tu{i}' {clean_text(rng)}" for i in range(5)}
    return texts


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in corpus.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 200 or i >= 300), 0) for i in corpus if i % 2]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_do_what_they_decide(spark, corpus, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.dtypes == before.dtypes
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = set(range(150)) | set(range(300, 320)) | set(range(400, 405))
    assert clean <= kept["quality_rules"].keys() and not kept["quality_rules"].keys() & set(range(200, 210))
    assert len(clean - kept["quality_classifier"].keys()) <= 2
    judged = kept["quality_classifier"]
    sets = {i: shingles(t) for i, t in judged.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = groups(sets, links)
    assert kept["near_duplicates"] == {i: t for i, t in judged.items() if low[i] == i}
    for i, text in kept["secret_scan"].items():
        before = kept["near_duplicates"][i]
        assert text == before if i < 400 else "zq9" not in text and "[SECRET]" in text
    assert sum(r["length"] for r in docs.collect()) == sum({r["doc_id"]: r["doc_tokens"] for r in docs.collect()}.values())
    assert {r["doc_id"] for r in docs.collect()} == kept["secret_scan"].keys()


def test_run_is_the_stages_in_order(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "secret_scan", "pack"]
    rows = corpus_pipeline.run(spark, folder).collect()
    clean = set(range(150)) | set(range(400, 405))
    assert len(clean - {r["doc_id"] for r in rows}) <= 2
    assert not {r["doc_id"] for r in rows} & (set(range(200, 230)) | set(range(300, 320)))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd_documents, folder, name, stage):
    out = stage(spark, odd_documents, folder)
    n = odd_documents.count()
    if name == "pack":
        assert out.count() >= n
    else:
        assert out.columns == odd_documents.columns
        assert {r["_before"] for r in out.collect()} <= {"extra"}
    if name == "quality_rules":
        # Only long texts with varied words pass; that a row has no id saves none.
        assert out.where("doc_id IS NULL").count() == 0
    if name in ("quality_classifier", "secret_scan"):
        assert out.count() == n
    if name == "near_duplicates":
        # "word" is there four times, once without an id; the other texts of no id or a shared one stay.
        assert out.where("text = 'word'").count() == 1 and out.count() == n - 3
    assert stage(spark, odd_documents.limit(0), folder).count() == 0


def test_rows_of_one_id_are_judged_alone(spark, folder):
    rng = random.Random(5)
    clean, junk = [clean_text(rng) for _ in range(4)], "the same few words over again\n" * 20
    rows = [(7, clean[0]), (7, junk), (7, clean[1]), (None, clean[2]), (None, junk), (None, clean[2]), (9, clean[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.quality_rules(spark, docs, folder)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted((r for r in rows if r[1] != junk), key=repr)
    once = corpus_pipeline.near_duplicates(spark, kept, folder)
    assert sorted(((r["doc_id"], r["text"]) for r in once.collect()), key=repr) == sorted([(7, clean[0]), (7, clean[1]), (None, clean[2]), (9, clean[3])], key=repr)


def test_no_secret_is_left_in_any_column(spark, folder):
    row = [(1, "a token=abcdefgh12345 b", "en", "s", 23)]
    docs = spark.createDataFrame(row, SCHEMA).selectExpr("*", "'mine' AS _before", "'keep' AS _place", "1 AS _hash", "array(2) AS _spans", "3 AS place", "4 AS spans", "5 AS hash")
    out = corpus_pipeline.secret_scan(spark, docs, folder).first().asDict()
    assert "abcdefgh12345" not in str(out)
    assert out["n_chars"] == len(out["text"]) and out["_before"] == "mine" and out["_place"] == "keep" and out["_spans"] == [2] and out["hash"] == 5

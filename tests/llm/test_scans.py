"""Secrets, licences, shards, vectors: against brute force, and on odd rows."""

import hashlib
import random
import re
import textwrap
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tabscope.llm import licences, queries, secrets, sharding, vectors
from tabscope.session import checkpoint_folder
from tests.llm.test_texts import groups

ASSIGN = re.compile(r'(?i:(password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(out))


def test_base_spans_are_those_of_brute_force(spark):
    rng = random.Random(7)
    bits = ["token", "PassWord", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "é😀", "AKIA", "ABCDEF123456", "0123456789abcdef", "\n", "abcdefgh", "x=", "zzzz"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    texts += ["token: secret : abcdefgh", "AKIAAKIA1234567890", "a" * 40, "token=" * 9 + "x"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    for r in secrets.scan(docs).collect():
        base = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] != "owned")
        assert base == base_spans(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_secret_query_tells_owners_of_every_span(spark, tmp_path):
    rows = [(i, "a token=EXAMPLEkey12345 b", f"owner{i % 4}") for i in range(8)] + [(8, "x zq9XkLm2PqRs7TuVw8Yz token=EXAMPLEkey12345", "owner0"), (9, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_secret_ownership"](spark, str(tmp_path)).collect()}
    assert got[0]["ownership"] == "4:9" and got[8]["ownership"] == "1:1,4:9" and got[9]["ownership"] == got[9]["spans"] == ""
    assert got[0]["n_copied"] == got[8]["n_copied"] == 1


def overlapping(span, others):
    return any(o[0] < span[1] and span[0] < o[1] for o in others)


def owned_spans(text):
    """Long mixed tokens that overlap no base span."""
    base = [tuple(map(int, s.split(":")[1:])) for s in base_spans(text).split(",") if s]
    found = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and len(set(m[0])) >= 10]
    return [s for s in found if not overlapping(s, base)]


def redacted(text, spans):
    out, at, ends = "", 0, sorted((start, end) for start, end in spans)
    for start, end in ends:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


@pytest.mark.parametrize("block", [4, 16, 256])
def test_many_spans_of_one_text_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(secrets, "BLOCK", block)
    rng = random.Random(block)
    bits = ["token=abcdefgh12 ", "é😀 ", "AKIA" + "ABCDEF123456" + " ", "0123456789abcdef" * 2 + "\n", "zz9Qm3LkPw7RtYx2VbN8", "secret: ", " ", "word ", "/", "x=short token=ab "]
    texts = ["".join(rng.choice(bits) for _ in range(n)) for n in [0, 1, 2, 5, 9, 17, 40, 130, 900, 3000] for _ in range(3)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    kept = {}
    for r in secrets.scan(docs).collect():
        text = texts[r["doc_id"]]
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] != "owned") == base_spans(text)
        assert [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "owned"] == owned_spans(text)
        kept[r["doc_id"]] = [(s["start"], s["end"]) for s in r["spans"]]
    for r in secrets.redact(docs).collect():
        assert r["text"] == redacted(texts[r["doc_id"]], kept[r["doc_id"]])


def test_ownership_parts_examples_from_live_ones(spark):
    example, live, shared = "token=EXAMPLEkey12345", "zq9XkLm2PqRs7TuVw8Yz", "kk8JhGfDs3AqWeRtYuIoP0"
    rows = [(i, f"see {example} here", f"owner{i}") for i in range(4)]
    rows += [(10, f"mine é {live} end", "owner1"), (11, f"again {live}", "owner1"), (12, f"a {shared}", "owner1"), (13, f"b {shared}", "owner2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert all(s["copied"] and s["n_owners"] == 4 for i in range(4) for s in got[i])
    assert [(s["kind"], s["start"], s["end"], s["n_repositories"]) for s in got[10]] == [("owned", 7, 27, 2)]
    # An unnamed token that two owners have is no secret of either.
    assert got[12] == got[13] == []
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[0] == "see [EXAMPLE] here" and clean[10] == "mine é [SECRET] end" and clean[12] == rows[6][1]


def test_one_owners_token_is_live_in_any_number_of_documents(spark):
    live, named = "zq9XkLm2PqRs7TuVw8Yz", "token=kk8JhGfDs3AqWeRt"
    rows = [(i, f"page {i} {live} {named} end", "owner", f"repo{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, repo string")
    for repository in ("doc_id", "repo"):
        for r in secrets.scan(docs, repository=repository).collect():
            assert [(s["kind"], s["n_repositories"], s["copied"]) for s in r["spans"]] == [("owned", 300, False), ("assign", 300, False)]
        clean = secrets.redact(docs, repository=repository)
        assert {r["text"] for r in clean.collect()} == {f"page {i} [SECRET] [SECRET] end" for i in range(300)}
    # Repositories of two owners tell of a copy, documents do not.
    shared = docs.union(docs.selectExpr("doc_id + 1000", "text", "'other'", "repo || 'b'"))
    assert {s["copied"] for r in secrets.scan(shared, repository="repo").collect() for s in r["spans"]} == {True}
    assert {s["copied"] for r in secrets.scan(shared).collect() for s in r["spans"]} == {False}


def test_overlapping_spans_are_replaced_together(spark):
    key = "0123456789abcdef" * 2
    docs = spark.createDataFrame([(1, f'x token = "{key}" y {key}z', "a")], "doc_id bigint, text string, source string")
    assert secrets.redact(docs).first()["text"] == 'x [SECRET]" y [SECRET]z'


def test_secrets_on_odd_rows(odd_documents, no_documents):
    rows = secrets.scan(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    texts = {r["doc_id"]: r["text"] for r in odd_documents.collect() if r["doc_id"] is not None}
    for r in rows:
        if r["doc_id"] is not None:
            assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]) == base_spans(texts[r["doc_id"]])
    clean = secrets.redact(odd_documents)
    assert clean.columns == odd_documents.columns and clean.count() == odd_documents.count()
    assert secrets.scan(no_documents).count() == secrets.redact(no_documents).count() == 0


def brute_shards(rows, limit):
    hashes = [int(hashlib.md5(f"{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16) for i, t in rows]
    names = [f"{h:060b}" for h in hashes]
    sizes = [len((t or "").encode()) for _, t in rows]
    out = []
    for name in names:
        for depth in range(61):
            total = sum(s for n, s in zip(names, sizes, strict=True) if n[:depth] == name[:depth])
            if total <= limit or depth == 60:
                out.append((name[:depth], total))
                break
    return out


@pytest.mark.parametrize("limit", [1, 60, 500, 10**9])
def test_shards_are_those_of_splitting_buckets(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "é" * rng.randint(1, 50)])) for _ in range(60)] + [(7, "same")] * 9
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.assign(df, limit).collect()
    want = brute_shards(rows, limit)
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    assert sorted(((r["doc_id"], r["bytes"], r["shard"], r["shard_bytes"]) for r in got), key=key) == sorted(((i, len((t or "").encode()), *w) for (i, t), w in zip(rows, want, strict=True)), key=key)
    assert all(r["oversized"] == (r["shard_bytes"] > limit) for r in got)


def test_shards_on_odd_rows(odd_documents, no_documents):
    assert sharding.assign(odd_documents, 100).count() == odd_documents.count()
    assert sharding.assign(no_documents, 100).count() == 0


def dice(a, b):
    grams = []
    for text in (a, b):
        words = re.findall(r"[^\W_]+", text.lower())
        grams.append(set(zip(words, words[1:], strict=False)))
    return 2 * len(grams[0] & grams[1]) / max(1, len(grams[0]) + len(grams[1])) if min(map(len, grams)) else 0


def words_in(text):
    return re.findall(r"[^\W_]+", text.lower())


def best_template(unit):
    best = max(((dice(unit, body), -n, name) for n, (name, body) in enumerate(licences.TEMPLATES)), default=None)
    return best if best and best[0] >= 0.8 else None


def notices_between(words):
    """Every window of every template, from left to right."""
    hits = []
    for n, (name, body) in enumerate(licences.TEMPLATES):
        template = words_in(body)
        pairs = set(zip(template, template[1:], strict=False))
        for i in range(len(words) - 1):
            window = words[i : i + len(template)]
            if (words[i], words[i + 1]) in pairs and (score := dice(" ".join(window), body)) >= 0.8:
                hits.append((i, -score, n, i + len(window), name))
    kept = []
    for i, minus, n, end, name in sorted(hits):
        if not kept or i >= kept[-1][3]:
            kept.append((i, minus, n, end, name))
        elif (minus, n) < kept[-1][1:3]:
            kept[-1] = (i, minus, n, end, name)
    return [(-minus, -n, name) for _, minus, n, _, name in kept]


def brute_notices(text):
    lines = [(line, best_template(line)) for line in text.split("\n")]
    found, words = [], []
    for line, best in [*lines, ("", (0, 0, ""))]:
        if best is None:
            words += words_in(line)
        else:
            found += notices_between(words) + ([best] if best[0] else [])
            words = []
    if not found and len(lines) > 1 and (best := best_template(text)):
        found = [best]
    return found


def licence_texts():
    rng = random.Random(8)
    common = "the of software license under to use in this is a work permission version terms".split()
    texts = ["", "licensed", "\n\n", " ".join(common * 30), "\n".join(" ".join(rng.choices(common, k=9)) for _ in range(60))]
    for name, body in licences.TEMPLATES:
        words = body.split()
        texts += [body.upper(), f"Intro text.\n{body}\nmore", " ".join(words[: len(words) * 2 // 3]), "\n".join(words)]
        wrapped = "\n".join("# " + line for line in textwrap.wrap("Copyright 2020 by the authors of this thing. " + body + " Some code follows here.", 76))
        texts += [wrapped, wrapped + "\n" + "x = 1\n" * 40 + wrapped, f"Copyright 2020 by its authors. {body} See the file LICENSE.", f"{body} {body}\nSo {body} {body}"]
        words[rng.randrange(len(words))] = "changed"
        texts += ["Head\n" + " ".join(words), "Some words before " + " ".join(words) + " and after", "tail " + " ".join(words[: len(words) * 9 // 10])]
    bodies = [body for _, body in licences.TEMPLATES]
    texts += ["So: " + " ".join(rng.sample(bodies, len(bodies))) + " end", "\n".join("\n".join(textwrap.wrap("by " + b, 30)) for b in bodies)]
    return texts


def test_licences_are_those_of_brute_force(spark):
    texts = licence_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = licences.scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        best = brute_notices(texts[r["doc_id"]])
        assert r["n_notices"] == len(best) and r["licences"] == ",".join(sorted({b[2] for b in best})), texts[r["doc_id"]]
        assert r["best_dice"] == (pytest.approx(max(b[0] for b in best)) if best else None)


def test_every_template_is_found_wrapped_and_within_a_line(spark):
    rows = []
    for name, body in licences.TEMPLATES:
        rows += [(name, "\n".join(textwrap.wrap(body + " More text.", 76, initial_indent="// ", subsequent_indent="// ")) + "\ncode" * 40)]
        rows += [(name, f"Copyright 2020 by its authors. {body} See the file LICENSE.")]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id bigint, text string")
    for r in licences.scan(docs).collect():
        assert r["n_notices"] >= 1 and rows[r["doc_id"]][0] in r["licences"].split(","), rows[r["doc_id"]]


def test_licence_query_and_its_sql_agree_on_planted_notices(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(licence_texts())), "doc_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_notices, licences, best_dice FROM ({queries._licence_sql()})").fetchall()}
    for r in licences.scan(docs).collect():
        assert (r["n_notices"], r["licences"]) == want[r["doc_id"]][:2] and r["best_dice"] == want[r["doc_id"]][2]


def test_licences_on_odd_rows(odd_documents, no_documents):
    rows = licences.scan(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(r["n_notices"] == 0 and r["best_dice"] is None for r in rows)
    assert licences.scan(no_documents).count() == 0


def test_vectors_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.3])).astype(np.float32) for i in range(500)]
    rows += [rows[0]] * 40 + [rows[1] * 3, -rows[2]]
    x = np.array(rows, dtype=np.float64)
    cosine = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    links = [(a, b) for a, b in zip(*np.nonzero(cosine >= 0.95), strict=True) if a != b]
    want = groups(range(len(rows)), links)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    degree = np.bincount([a for a, _ in links], minlength=len(rows))
    assert {k: r["n_links"] for k, r in got.items()} == dict(enumerate(degree.tolist()))
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(r["kept"] == (want[k] == k) for k, r in got.items())


def test_vectors_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e-40, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, list int, unit string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()}
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)) and got[None] == (0, None, True)
    assert got[7] == (2, 7, True) and got[8] == (2, 7, False) and got[10] == (2, 7, False)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_recall_in_many_dimensions(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(150, 64)), 8, axis=0)
    x += rng.normal(size=x.shape) * rng.choice([0.05, 0.12, 0.17, 0.22], size=len(x))[:, None]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((unit @ unit.T) >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(df).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum() and want.sum() > 1000


@pytest.mark.parametrize("width,rank", [(64, 4), (768, 6)])
def test_no_link_is_lost_in_a_subspace(spark, monkeypatch, width, rank):
    """Vectors of low effective rank, in groups, and half of them of another length."""
    monkeypatch.setattr(vectors, "BLOCK", 512)
    rng = np.random.default_rng(rank)
    x = np.repeat(rng.normal(size=(400, rank)), 5, axis=0)
    x = (x + 0.25 * rng.normal(size=x.shape)) @ np.linalg.qr(rng.normal(size=(width, rank)))[0].T
    x[1::2, width - 8 :] = 0
    dims = np.where(np.arange(len(x)) % 2, width - 8, width)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.95) & (dims[:, None] == dims[None, :])
    df = spark.createDataFrame([(i, r[:d].tolist()) for i, (r, d) in enumerate(zip(x, dims, strict=True))], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()


def test_what_vectors_write_grows_with_their_number(spark, monkeypatch):
    """Some sixty parts, all of which meet: no part is written again for each that it meets."""
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x[1::2] = x[::2] + 0.02 * rng.normal(size=(1500, 64))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    folders = [Path(checkpoint_folder(spark).removeprefix("file:")), *map(Path, local)]

    def files():
        return {f: f.stat().st_size for folder in folders for f in folder.rglob("*") if f.is_file()}

    before = files()
    got = vectors.near_duplicates(df).collect()
    written = sum(size for f, size in files().items() if f not in before)
    assert sum(r["n_links"] for r in got) == 3000 and sum(r["kept"] for r in got) == 1500
    # Shuffles and checkpoints together; 18.8 times the vectors when they were sent to each part they meet.
    assert x.nbytes < written < 8 * x.nbytes

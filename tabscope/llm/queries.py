"""The registered queries of this subpackage, each beside its check in SQL where SQL can say it.

The queries apply the operators to whole tables with their production
parameters and derive the columns asked of them.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.session import checkpoint_folder, cut_lineage, tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build: Query) -> Query:
        QUERIES[name] = lambda spark, folder: build(tune(spark), str(folder).rstrip("/"))
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BROADCAST_ROWS = 1_000_000


def table_of(ids: DataFrame) -> DataFrame:
    """Materialised ids, marked for broadcast while there are few enough of them; beyond that a join shuffles."""
    stored = cut_lineage(ids)
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


# Words of a text in the checking engine; \n and the like are control characters 9 to 13.
SQL_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
SQL_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _component_sql(nodes: str, node: str, links: str) -> str:
    """Smallest reachable node by repeated steps, as the body of WITH RECURSIVE."""
    return (
        f"reach(node, low) AS (SELECT {node}, {node} FROM {nodes} UNION SELECT l.b, r.low FROM reach r JOIN {links} l ON l.a = r.node WHERE r.low < l.b), "
        "component AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)"
    )


# ── 10: MinHash near-dedup ────────────────────────────────────────────────────

OP10_SQL = f"""
WITH RECURSIVE worded AS (SELECT doc_id, {SQL_WORDS.format(text=SQL_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents),
runs AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS run FROM worded),
sizes AS (SELECT d.doc_id, count(r.run) AS n FROM documents d LEFT JOIN runs r USING (doc_id) GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM runs x JOIN runs y USING (run) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * same >= 75 * (p.n + q.n - same)),
{_component_sql("documents", "doc_id", "links")}
SELECT s.doc_id, s.n AS n_shingles, component_id, s.doc_id = component_id AS kept FROM sizes s JOIN component c ON c.node = s.doc_id
"""


@register("op10_minhash_near_duplicates", OP10_SQL)
def _near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from tabscope.llm.near_text import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


# ── 4: SentencePiece encoding and decoding ────────────────────────────────────


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op4_sentencepiece_round_trip")
def _round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from tabscope.llm.pieces import decode, encode

    model = vocabulary("piece_bpe_32k.model")
    both = decode(encode(table(spark, folder, "documents"), model), model)
    return both.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(encode(decoded, 'UTF-8'), 256) AS decoded_sha256")


# ── 9: packing ────────────────────────────────────────────────────────────────


def packed(docs: DataFrame) -> DataFrame:
    from tabscope.llm.packing import pack, pieces_of, tokenised

    tokens = tokenised(docs, vocabulary("word_bpe_49k.json"))
    pieces = pieces_of(tokens).selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens")
    return pack(pieces)


@register("op9_pack_minimum_slack")
def _pack(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


# ── 5: WARC ───────────────────────────────────────────────────────────────────

# Base32 in the checking engine: five hex digits of the SHA-1 are four characters.
SQL_BASE32 = (
    "array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform(range(0, 4), lambda j: "
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr({hex}, 5 * k + 1, 5) AS INTEGER) >> (15 - 5 * j)) & 31)::INTEGER, 1)), '')), '')"
)
OP5_SQL = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS original FROM hashed)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {SQL_BASE32.format(hex="h")} AS payload_digest,
  CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < original THEN original END AS refers_to
FROM grouped
"""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all machines of the cluster share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid4().hex}"


@register("op5_warc_merged_index", OP5_SQL)
def _archives(spark: SparkSession, folder: str) -> DataFrame:
    from tabscope.llm.archives import merged_index, sorted_runs, with_revisits, write_archives

    # Pages have no time of capture: one second after another from a fixed day on.
    captured_at = F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0)))
    captures = with_revisits(table(spark, folder, "pages"), "page_id", "url", "html", captured_at, least_bytes=0)
    archives = shared_folder(spark, "archives")
    write_archives(captures, archives)
    return merged_index(sorted_runs(spark, archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# ── 2: secrets ────────────────────────────────────────────────────────────────


@register("op2_secret_ownership")
def _secrets(spark: SparkSession, folder: str) -> DataFrame:
    from tabscope.llm.secrets import BASE, as_text, scan

    found = scan(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind.name) for kind in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.encode(as_text(base), "UTF-8"), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["copied"])).cast("bigint").alias("n_copied"),
        # owners:repositories of each span's value, in the order of ``spans``
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["n_owners"], s["n_repositories"])), ",").alias("ownership"),
    )


# ── 3: sharding ───────────────────────────────────────────────────────────────

SHARD_BYTES = 16 << 20
OP3_SQL = f"""
WITH rows AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS hash FROM documents),
ways AS (SELECT doc_id, bytes, hash, d, hash >> (60 - d) AS bucket FROM rows, (SELECT unnest(range(0, 61))::INTEGER AS d)),
buckets AS (SELECT d, bucket, sum(bytes)::BIGINT AS shard_bytes FROM ways GROUP BY 1, 2),
found AS (SELECT w.doc_id, w.bytes, w.hash, w.d, b.shard_bytes,
  row_number() OVER (PARTITION BY w.doc_id, w.hash ORDER BY w.d) AS place
  FROM ways w JOIN buckets b USING (d, bucket) WHERE b.shard_bytes <= {SHARD_BYTES} OR d = 60)
SELECT doc_id, bytes, substr(lpad(bin(hash), 60, '0'), 1, d) AS shard, d AS shard_depth, shard_bytes, shard_bytes > {SHARD_BYTES} AS oversized
FROM found WHERE place = 1
"""


@register("op3_extendible_shards", OP3_SQL)
def _shards(spark: SparkSession, folder: str) -> DataFrame:
    from tabscope.llm.sharding import assign

    return assign(table(spark, folder, "documents"), SHARD_BYTES)


# ── 6: licences ───────────────────────────────────────────────────────────────


def _licence_sql() -> str:
    from tabscope.llm.licences import TEMPLATES

    rows = ", ".join("({}, '{}', '{}')".format(n, name, body.replace("'", "''")) for n, (name, body) in enumerate(TEMPLATES))
    words = r"list_filter(regexp_split_to_array(lower({unit}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return f"""
WITH RECURSIVE templates AS (SELECT no, name, len(w) AS length, {grams.format(w="w")} AS g
  FROM (SELECT no, name, {words.format(unit="body")} AS w FROM (VALUES {rows}) v(no, name, body))),
lines AS (SELECT doc_id, line, {words.format(unit="unit")} AS w FROM (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS unit FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE contains(text, chr(10)))),
cut AS (SELECT doc_id, line, {grams.format(w="w")} AS g FROM lines WHERE len(w) > 1),
scored AS (SELECT doc_id, line, no, name, 2.0::DOUBLE * len(list_intersect(c.g, t.g)) / (len(c.g) + len(t.g)) AS dice FROM cut c JOIN templates t
  ON 2 * least(len(c.g), len(t.g)) >= 0.8 * (len(c.g) + len(t.g))),
best AS (SELECT doc_id, line, name, dice FROM scored WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, no) = 1),
between_lines AS (SELECT l.doc_id, l.line, l.w, b.line IS NULL AS free,
  count(b.line) OVER (PARTITION BY l.doc_id ORDER BY l.line) AS part
  FROM lines l LEFT JOIN best b USING (doc_id, line) WHERE l.line > 0),
parts AS (SELECT doc_id, part, flatten(list(w ORDER BY line)) AS w FROM between_lines WHERE free GROUP BY doc_id, part),
pairs AS (SELECT doc_id, part, i, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, part, w, unnest(range(1, len(w))) AS i FROM parts)),
begun AS (SELECT p.doc_id, p.part, p.i, t.no FROM pairs p JOIN (SELECT no, unnest(g) AS gram FROM templates) t USING (gram)),
wins AS (SELECT doc_id, part, i, no, name, g, w[i : i + length - 1] AS w FROM begun JOIN parts USING (doc_id, part) JOIN templates USING (no)),
cut_wins AS (SELECT doc_id, part, i, i + len(w) AS past, no, name, g, {grams.format(w="w")} AS h FROM wins),
hits AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY i, dice DESC, no) AS k FROM (
  SELECT doc_id, part, i, past, no, name, 2.0::DOUBLE * len(list_intersect(g, h)) / (len(g) + len(h)) AS dice FROM cut_wins) WHERE dice >= 0.8),
held AS (SELECT doc_id, part, k, past, no, name, dice, 1 AS notice FROM hits WHERE k = 1
  UNION ALL SELECT h.doc_id, h.part, h.k,
    CASE WHEN h.i >= o.past OR h.dice > o.dice OR (h.dice = o.dice AND h.no < o.no) THEN h.past ELSE o.past END,
    CASE WHEN h.i >= o.past OR h.dice > o.dice OR (h.dice = o.dice AND h.no < o.no) THEN h.no ELSE o.no END,
    CASE WHEN h.i >= o.past OR h.dice > o.dice OR (h.dice = o.dice AND h.no < o.no) THEN h.name ELSE o.name END,
    CASE WHEN h.i >= o.past OR h.dice > o.dice OR (h.dice = o.dice AND h.no < o.no) THEN h.dice ELSE o.dice END,
    o.notice + CASE WHEN h.i >= o.past THEN 1 ELSE 0 END
  FROM held o JOIN hits h ON h.doc_id = o.doc_id AND h.part = o.part AND h.k = o.k + 1),
notices AS (SELECT doc_id, name, dice FROM best WHERE line > 0 UNION ALL
  SELECT doc_id, name, dice FROM (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY doc_id, part, notice ORDER BY k DESC) = 1)),
met AS (SELECT * FROM notices UNION ALL SELECT doc_id, name, dice FROM best WHERE line = 0 AND doc_id NOT IN (SELECT doc_id FROM notices))
SELECT d.doc_id, count(m.name)::BIGINT AS n_notices, coalesce(string_agg(DISTINCT m.name, ',' ORDER BY m.name), '') AS licences, max(m.dice) AS best_dice
FROM documents d LEFT JOIN met m USING (doc_id) GROUP BY d.doc_id
"""


@register("op6_licence_dice", _licence_sql())
def _licences(spark: SparkSession, folder: str) -> DataFrame:
    from tabscope.llm.licences import scan

    return scan(table(spark, folder, "documents"))


# ── 8: quality rules ──────────────────────────────────────────────────────────


@register("op8_divergence_rules")
def _rules(spark: SparkSession, folder: str) -> DataFrame:
    from tabscope.llm.rules import judge

    return judge(table(spark, folder, "documents"))


# ── 7: quality classifier ─────────────────────────────────────────────────────


@register("op7_importance_resampling")
def _importance(spark: SparkSession, folder: str) -> DataFrame:
    from tabscope.llm.importance import resample

    return resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


# ── 1: embedding near-dedup ───────────────────────────────────────────────────

OP1_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
usable AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) >= 0.95 * x.norm * y.norm),
{_component_sql("embeddings", "vec_id", "links")},
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component c ON c.node = e.vec_id LEFT JOIN counted ON a = e.vec_id
"""


@register("op1_quantised_near_duplicates", OP1_SQL)
def _near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    from tabscope.llm.vectors import near_duplicates

    return near_duplicates(table(spark, folder, "embeddings"))


# ── 12: token ids in wavelet matrices ─────────────────────────────────────────


@register("op12_wavelet_shards")
def _token_shards(spark: SparkSession, folder: str) -> DataFrame:
    from tabscope.llm.wavelet import read_documents, with_starts, write_shards

    shards = shared_folder(spark, "token-shards")
    write_shards(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), shards, end_id=2)
    read = read_documents(spark, shards).select("doc_id", "n_tokens", "partition", "place", F.crc32("ids").alias("ids_crc32"))
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")


# ── 13: cross-tokenizer alignment ─────────────────────────────────────────────


@register("op13_coalesced_alignment")
def _alignment(spark: SparkSession, folder: str) -> DataFrame:
    from tabscope.llm.alignment import align, with_counts

    model = vocabulary("piece_bpe_32k.model")
    rows = align(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), model, related="ends")
    return with_counts(rows, model).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# ── 11: ranked lexical search ─────────────────────────────────────────────────

SQL_TERMS = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {SQL_TERMS.format(text=SQL_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS n_all, coalesce(sum(len(w)), 0)::BIGINT AS l_all FROM d),
asked AS (SELECT DISTINCT item_id, unnest({SQL_TERMS.format(text=SQL_LOWER.format(text="coalesce(text, '')"))}) AS t FROM benchmark),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY 1, 2),
weights AS (SELECT t, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tfs, totals WHERE t IN (SELECT t FROM asked) GROUP BY t, n_all),
norms AS (SELECT doc_id, 50 + (50 * len(w) * n_all) // l_all AS m FROM d, totals WHERE len(w) > 0),
scored AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN tfs USING (t) JOIN norms USING (doc_id) GROUP BY 1, 2),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""


@register("op11_best_position_search", OP11_SQL)
def _search(spark: SparkSession, folder: str) -> DataFrame:
    from tabscope.llm.best_position import search

    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)

"""Secrets in texts, told apart by who owns them. DataFrame functions only.

Candidates are found by patterns. The hash of each candidate's value is counted
over the whole corpus: in how many repositories and at how many owners it
occurs. A value that many owners have is a copied example; one that a single
owner has looks live. Long mixed tokens that no pattern names are spans only
if they look live in this sense.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.columns import unused_name
from tabscope.session import cut_lineage

SPAN = "struct<start:int, kind_no:int, end:int, kind:string, value:string>"
BROADCAST_ROWS = 100_000
# Matches of one text handled together. A growing array is copied for each new
# element, so long ones are built from blocks: no case is treated otherwise.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # in the syntax of Java
    value_group: int
    least: int  # characters of the value


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The patterns asked for.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = f"({'|'.join(map(either_case, KEYWORDS))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = (Kind("assign", ASSIGN, 2, 8), Kind("access", "AKIA[A-Z0-9]+", 0, 16), Kind("hex", "[0-9a-f]{32,}", 0, 32))
# A run of token characters; it must hold a digit and a letter, and at least ten different characters.
OWNED = Kind("owned", "[A-Za-z0-9+/_-]{20,}", 0, 20)
VARIETY = 10


def spans(text: Column, kind: Kind, kind_no: int) -> Column:
    """All matches of a kind that are long enough, as an array of SPAN in order, in code points."""
    pattern = F.lit(kind.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(kind.value_group)) if kind.value_group else whole
    # The text after the last match is a gap too many.
    joined = F.arrays_zip(whole.alias("whole"), values.alias("value"), F.split(text, kind.pattern, -1).alias("gap"))
    nothing = F.array().cast(f"array<{SPAN}>")

    def step(done: Column, match: Column) -> Column:
        begin = done["at"] + F.length(match["gap"])
        end = begin + F.coalesce(F.length(match["whole"]), F.lit(0))
        span = F.struct(
            begin.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"), F.lit(kind.name).alias("kind"), match["value"].alias("value")
        )
        kept = F.when(F.length(match["value"]) >= kind.least, F.array(span)).otherwise(nothing)
        return F.struct(end.alias("at"), F.concat(done["out"], kept).alias("out"))

    def placed(part: Column) -> Column:
        """Length of a block of matches, and its spans counted from its beginning."""
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step)

    def begun(parts: Column) -> Column:
        """Where each block begins, and the end of the last."""
        return F.aggregate(parts, F.array(F.lit(0)), lambda at, part: F.concat(at, F.array(F.element_at(at, -1) + part["at"])))

    def moved(part: Column, by: Column) -> Column:
        def move(s: Column) -> Column:
            return F.struct((s["start"] + by).alias("start"), s["kind_no"].alias("kind_no"), (s["end"] + by).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))

        return F.transform(part["out"], move)

    parts = let(joined, lambda all_matches: F.transform(blocks(all_matches, BLOCK), placed))
    found = let(parts, lambda p: let(begun(p), lambda at: F.flatten(F.transform(p, lambda part, k: moved(part, F.get(at, k))))))
    # Texts without a match, nearly all, are read once.
    return F.coalesce(F.when(text.rlike(kind.pattern), found), nothing)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def blocks(items: Column, size: int) -> Column:
    """An array cut into arrays of at most ``size``; one empty one if there are no items."""
    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * size + 1, size))


def clear_of(tokens: Column, base: Column, sizes: tuple[int, ...]) -> Column:
    """The ``tokens``, in order and apart from each other, that overlap none of ``base``.

    Each block of tokens is held only against what lies within its own range.
    """
    if not sizes:
        return F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))

    def near(part: Column) -> Column:
        first, last = F.get(part, F.lit(0)), F.get(part, F.size(part) - 1)
        return F.struct(part.alias("tokens"), F.filter(base, lambda b: (b["start"] < last["end"]) & (first["start"] < b["end"])).alias("base"))

    return F.flatten(F.transform(F.transform(blocks(tokens, sizes[0]), near), lambda f: clear_of(f["tokens"], f["base"], sizes[1:])))


def candidates(text: Column) -> Column:
    """Spans of the base kinds, and long mixed tokens that overlap none of them."""
    base = F.concat(*(spans(text, kind, no) for no, kind in enumerate(BASE)))
    tokens = F.filter(
        spans(text, OWNED, len(BASE)),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(s["value"], ""))) >= VARIETY),
    )
    found = F.struct(base.alias("base"), tokens.alias("tokens"))
    clear = lambda f: F.when(F.size(f["base"]) > 0, clear_of(f["tokens"], f["base"], (BLOCK * BLOCK // 16, BLOCK // 4))).otherwise(f["tokens"])
    return let(found, lambda f: F.concat(f["base"], clear(f)))


def with_ownership(docs: DataFrame, doc_id: str, text: str, repository: str, owner: str, many_owners: int, many_repositories: int) -> DataFrame:
    """One row per input row: ``doc_id``, ``text_hash``, ``spans``.

    ``spans`` is an array by start and then kind, each with ``n_owners`` and
    ``n_repositories`` of its value, and ``copied``: whether at least
    ``many_owners`` owners have it, or several owners in at least
    ``many_repositories`` repositories. Documents that stand for repositories
    are no sign of a copy, however many there are.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = cut_lineage(
        docs.select(
            F.col(doc_id).cast("bigint").alias("doc_id"),
            F.xxhash64(whole).alias("text_hash"),
            F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
            F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
            candidates(whole).alias("found"),
        )
    )
    each = found.where(F.size("found") > 0).select("doc_id", "text_hash", "repository", "owner", F.inline("found"))
    each = each.withColumn("hash", F.sha2("value", 256)).drop("value")
    held = each.groupBy("hash", "owner", "repository").count().groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    held = held.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))
    # A table of its own, so that the join may split a value that very many documents hold.
    held = cut_lineage(held)
    # The spans of a text do not depend on whose it is: rows with a null id may share them.
    place = F.coalesce("doc_id", F.lit(-1)).alias("place")
    judged = each.select(place, "text_hash", "hash", "start", "kind_no", "end", "kind").distinct().join(held, "hash")
    spread = (F.col("n_owners") > 1) & (F.col("n_repositories") >= many_repositories) & F.lit(repository != doc_id)
    judged = judged.withColumn("copied", (F.col("n_owners") >= many_owners) | spread)
    judged = judged.where((F.col("kind") != OWNED.name) | ~F.col("copied") & (F.col("n_owners") == 1))
    span = F.struct("start", "kind_no", "end", "kind", "hash", "n_owners", "n_repositories", "copied")
    by_text = judged.groupBy("place", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    rows = found.select("doc_id", "text_hash", place).join(by_text, ["place", "text_hash"], "left").drop("place")
    return rows.withColumn("spans", F.coalesce("spans", F.array().cast(by_text.schema["spans"].dataType)))


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    repository: str = "doc_id",
    owner: str = "source",
    many_owners: int = 3,
    many_repositories: int = 50,
) -> DataFrame:
    """``doc_id``, ``spans`` (see :func:`with_ownership`) for each input row.

    Null or empty texts have no spans. Rows that repeat repeat their result but
    count once. A null owner or repository counts as one of its own name, the
    empty one. Other columns are ignored.
    """
    return with_ownership(docs, doc_id, text, repository, owner, many_owners, many_repositories).drop("text_hash")


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    repository: str = "doc_id",
    owner: str = "source",
    many_owners: int = 3,
    many_repositories: int = 50,
    live_mark: str = "[SECRET]",
    copied_mark: str = "[EXAMPLE]",
    chars: str | None = None,
) -> DataFrame:
    """All rows and columns of ``docs``, each span of the text replaced by a mark.

    Spans that overlap are replaced together, by the mark for live ones if any
    of them is not a copied example. Texts without spans stay as they are, null
    included. A column of lengths in code points, ``chars``, follows the text it
    belongs to. Columns may have any names; a null id shares the spans of other
    rows of its text; no rows give none.
    """
    place, hashed, held = (unused_name(n, docs.columns) for n in ("place", "hash", "spans"))
    decided = with_ownership(docs, doc_id, text, repository, owner, many_owners, many_repositories).where(F.size("spans") > 0)
    decided = cut_lineage(decided.select(F.coalesce("doc_id", F.lit(-1)).alias(place), F.col("text_hash").alias(hashed), F.col("spans").alias(held)).distinct())
    if decided.count() <= BROADCAST_ROWS:
        decided = F.broadcast(decided)
    keyed = docs.withColumns({place: F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-1)), hashed: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})

    def mark(live: Column) -> Column:
        return F.when(live, F.lit(live_mark)).otherwise(F.lit(copied_mark))

    def within(done: Column, block: Column, region: Column) -> Column:
        """One block of spans; ``region`` is the text from where ``done`` stands to the block's last start."""

        def step(now: Column, span: Column) -> Column:
            apart = span["start"] >= now["at"]
            before = F.concat(
                now["out"],
                F.when(now["at"] > 0, mark(now["live"])).otherwise(F.lit("")),
                F.substring(region, now["at"] - done["at"] + 1, span["start"] - now["at"]),
            )
            return F.struct(
                F.greatest(now["at"], span["end"]).alias("at"),
                F.when(apart, ~span["copied"]).otherwise(now["live"] | ~span["copied"]).alias("live"),
                F.when(apart, before).otherwise(now["out"]).alias("out"),
            )

        return F.aggregate(block, F.struct(done["at"].alias("at"), done["live"].alias("live"), F.lit("").alias("out")), step)

    def block_step(done: Column, block: Column) -> Column:
        region = F.substring(F.col(text), done["at"] + 1, F.element_at(block, -1)["start"] - done["at"])
        now = let(region, lambda r: within(done, block, r))
        return let(now, lambda n: F.struct(n["at"].alias("at"), n["live"].alias("live"), F.concat(done["out"], F.array(n["out"])).alias("out")))

    first = F.struct(F.lit(0).alias("at"), F.lit(False).alias("live"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(
        blocks(F.col(held), BLOCK),
        first,
        block_step,
        lambda s: F.concat(F.array_join(s["out"], ""), mark(s["live"]), F.substring(F.col(text), s["at"] + 1, F.length(F.col(text)))),
    )
    joined = keyed.join(decided, [place, hashed], "left")
    found = F.col(held).isNotNull()
    joined = joined.withColumn(text, F.when(found, clean).otherwise(F.col(text)))
    if chars is not None:
        joined = joined.withColumn(chars, F.when(found, F.length(text).cast(docs.schema[chars].dataType)).otherwise(F.col(chars)))
    return joined.select(*docs.columns)

"""Which columns predict a target: importances of a random forest, and the forest as a model that scores tables."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.columns import is_numeric, missing_as_null, ref, require, small_table, text_of
from tabscope.functions.quantiles import exact_quantiles
from tabscope.session import cut_lineage, parts_for

MIN_ROWS = 20
MAX_FEATURES = 10
TREES = 200
DEPTH = 8
SEED = 42
TEST_SHARE = 0.25
CODE_VALUES = 10
# Rows of one part of a small training table; parts follow the number of rows, so the forest is the same on every cluster.
ROWS_PER_PART = 2000
# Text that stands for a missing value; it is a category of its own.
MISSING_TEXT = "nan"
# Code of a text that the training rows do not have.
UNSEEN = -1.0

TABLE_SCHEMA = (
    "applicable boolean, reason string, target string, task string, score_name string, score double, "
    "n_rows_used bigint, n_train bigint, n_test bigint, rank int, column string, importance double"
)


@dataclass(frozen=True)
class Scorer:
    """A trained forest with all it takes to score raw rows.

    ``features`` is (position, feature, kind, median) with kind number, truth or
    text; ``codes`` is (feature, value, code) for the texts; ``classes`` is
    (label, value), empty for a quantity.
    """

    model: RandomForestClassificationModel | RandomForestRegressionModel
    features: DataFrame
    codes: DataFrame
    classes: DataFrame

    def encode(self, df: DataFrame) -> DataFrame:
        """``df`` with the vector of its features; numbers are filled with medians, texts are looked up."""
        rows = self.features.orderBy("position").collect()  # one per feature
        out = missing_as_null(df)
        require(out, *(r["feature"] for r in rows))
        for r in rows:
            name = f"__f{r['position']}"
            if r["kind"] == "text":
                codes = self.codes.filter(F.col("feature") == r["feature"]).select(F.col("value").alias("__value"), F.col("code").alias(name))
                out = out.join(codes, _feature_text(out, r["feature"]) == F.col("__value"), "left").drop("__value")
                out = out.withColumn(name, F.coalesce(name, F.lit(UNSEEN)))
            else:
                out = out.withColumn(name, F.coalesce(ref(r["feature"]).cast("double"), F.lit(r["median"]), F.lit(0.0)))
        inputs = [f"__f{r['position']}" for r in rows]
        return VectorAssembler(inputCols=inputs, outputCol="__features").transform(out).drop(*inputs)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``: the likeliest class's text, or the expected quantity."""
        keep = [F.col(f"`{c}`") for c in df.columns if c != "prediction"]
        scored = self.model.transform(self.encode(df.drop("prediction")))
        if isinstance(self.model, RandomForestRegressionModel):
            return scored.select(*keep, "prediction")
        classes = self.classes.select(F.col("label").alias("prediction"), F.col("value").alias("__class"))
        return scored.join(classes, "prediction").select(*keep, F.col("__class").alias("prediction"))

    def save(self, folder: str) -> None:
        self.model.write().overwrite().save(f"{folder}/forest")
        for name in ("features", "codes", "classes"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Scorer:
        tables = {name: spark.read.parquet(f"{folder}/{name}") for name in ("features", "codes", "classes")}
        kind = RandomForestRegressionModel if tables["classes"].isEmpty() else RandomForestClassificationModel
        return Scorer(kind.load(f"{folder}/forest"), **tables)


@dataclass(frozen=True)
class Importance:
    """``table`` is the result; ``model`` scores tables with the same columns."""

    table: DataFrame
    model: Scorer | None = None


def is_classification_target(df: DataFrame, target: str) -> bool:
    """Numbers are a quantity unless they are few distinct whole codes; anything else is a category."""
    require(df, target)
    if not is_numeric(df.schema[target].dataType):
        return True
    values = missing_as_null(df.select(ref(target).alias("v")))
    v = F.col("v")
    row = values.agg(F.approx_count_distinct(v).alias("d"), F.max(F.abs(v.cast("double") % 1)).alias("part")).first()
    if row["part"] or row["d"] > 10 * CODE_VALUES:
        return False
    return values.agg(F.count_distinct(v)).first()[0] <= CODE_VALUES


def rank_codes(values: DataFrame) -> DataFrame:
    """Number the distinct ``value`` texts 0, 1, 2 ... in text order, without a single-task sort.

    The values are range-partitioned and sorted; a row's number is its place in
    its partition plus the sizes of the partitions before it.
    """
    low_bits = (1 << 33) - 1
    placed = cut_lineage(
        values.distinct()
        .orderBy("value")
        .select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    )
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # one row per partition
    if not sizes:
        return placed.select("value", F.lit(0.0).alias("code"))
    starts, total = [], 0
    for part in range(max(sizes) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    start = F.lit(starts)[F.col("part")]
    return placed.select("value", (start + F.col("place").bitwiseAND(F.lit(low_bits))).cast("double").alias("code"))


def ranked_within(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds each row's place in its group, from 0, in the given order; rows that tie get different places.

    Rows are range-partitioned, so a group of any size is sorted by many tasks;
    its places in a partition follow those of its rows in earlier ones.
    """
    spread = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = cut_lineage(spread.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__place")))
    parts = placed.groupBy(group, "__part").agg(F.min("__place").alias("__first"), F.count("*").alias("__size"))
    earlier = F.sum("__size").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("__before", F.coalesce(earlier, F.lit(0))).drop("__size")
    ranked = placed.join(parts, [group, "__part"]).withColumn(name, F.col("__before") + F.col("__place") - F.col("__first"))
    return ranked.drop("__part", "__place", "__first", "__before")


def _feature_text(df: DataFrame, column: str) -> Column:
    return F.coalesce(text_of(df, column), F.lit(MISSING_TEXT))


def _encoding(df: DataFrame, features: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The features with their kinds and medians, and the codes of all text features.

    ``df`` has the features under the names that are the keys.
    """
    kinds = {c: "number" if is_numeric(df.schema[c].dataType) else "truth" if isinstance(df.schema[c].dataType, T.BooleanType) else "text" for c in features}
    medians = exact_quantiles(df, [c for c, k in kinds.items() if k == "number"], [0.5])
    rows = [(i, features[c], k, medians[c][0] if k == "number" else None) for i, (c, k) in enumerate(kinds.items())]
    spark = df.sparkSession
    codes = [rank_codes(df.select(_feature_text(df, c).alias("value"))).select(F.lit(features[c]).alias("feature"), "value", "code") for c, k in kinds.items() if k == "text"]
    empty = small_table(spark, [], "feature string, value string, code double")
    return small_table(spark, rows, "position int, feature string, kind string, median double"), cut_lineage(reduce(DataFrame.unionByName, codes, empty))


def _test_sizes(counts: DataFrame, total: int, n_test: int) -> DataFrame:
    """Share ``n_test`` out over classes (label, count) in proportion, largest remainders first: (label, in_test)."""
    exact = F.col("count") * n_test / total
    parts = cut_lineage(counts.select("label", F.floor(exact).alias("whole"), (exact - F.floor(exact)).alias("part")))
    left = n_test - (parts.agg(F.sum("whole")).first()[0] or 0)
    more = parts.orderBy(F.desc("part"), "label").limit(int(left)).select("label", F.lit(1).alias("more"))
    return parts.join(more, "label", "left").select("label", (F.col("whole") + F.coalesce("more", F.lit(0))).alias("in_test"))


def predict_importance(
    df: DataFrame,
    target: str,
    max_features: int = MAX_FEATURES,
    key: list[str] | None = None,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = SEED,
) -> Importance:
    """Train a forest on three quarters of the rows, score it on the rest, rank the features.

    The split is exact and, for classes, keeps their proportions. With ``key`` it
    depends on the row keys only and is the same on every cluster.
    """
    require(df, target)
    spark = df.sparkSession

    def refused(reason: str) -> Importance:
        row = (False, reason, target, *[None] * 9)
        return Importance(small_table(spark, [row], TABLE_SCHEMA))

    working = missing_as_null(df).na.drop(subset=[target])
    names = {f"x{i}": c for i, c in enumerate(c for c in df.columns if c != target)}
    kind = text_of(working, target)
    if key is None:
        draws = [F.rand(seed).alias("draw"), F.rand(seed + 1).alias("tie")]
    else:
        # Rows with one key are told apart by all their values.
        everything = [text_of(working, c) for c in working.columns]
        draws = [F.xxhash64(*[ref(c) for c in key], F.lit(seed)).alias("draw"), F.xxhash64(*everything, F.lit(seed)).alias("tie")]
    # Everything after this reads these rows, whatever happens to executors.
    marked = cut_lineage(working.select(*draws, ref(target).alias("y"), kind.alias("kind"), *[ref(c).alias(x) for x, c in names.items()]))
    n = marked.count()
    if n < MIN_ROWS:
        return refused(f"at least {MIN_ROWS} rows with a target are needed")
    classify = is_classification_target(marked, "y")
    classes = small_table(spark, [], "label double, value string")
    if classify:
        found = marked.groupBy("kind").count()
        smallest = found.agg(F.count("*").alias("n"), F.min("count").alias("least")).first()
        if smallest["n"] < 2:
            return refused("the target has only one distinct value")
        if smallest["least"] < 2:
            return refused("every class needs at least two rows")
        classes = cut_lineage(rank_codes(found.select(F.col("kind").alias("value"))).select(F.col("code").alias("label"), "value"))
        labelled = marked.join(classes.withColumnRenamed("value", "kind"), "kind").drop("kind", "y").withColumn("stratum", F.col("label"))
    else:
        labelled = marked.withColumn("label", F.col("y").cast("double")).drop("kind", "y").withColumn("stratum", F.lit(0.0))
    if not names:
        return refused("no other columns can serve as features")

    ranked = ranked_within(labelled, "stratum", ["draw", "tie"], "rank")
    counts = labelled.groupBy(F.col("stratum").alias("label")).count()
    sizes = _test_sizes(counts, n, math.ceil(TEST_SHARE * n)).withColumnRenamed("label", "stratum")
    split = ranked.join(sizes, "stratum").withColumn("in_test", F.col("rank") < F.col("in_test")).drop("rank", "stratum")

    features, codes = _encoding(marked, names)
    encoder = Scorer(None, features.withColumn("feature", F.concat(F.lit("x"), "position")), *_renamed(codes, names), classes)
    parts = parts_for(n, -(-n // ROWS_PER_PART))
    label = F.col("label")
    if classify:
        label = label.alias("label", metadata={"ml_attr": {"type": "nominal", "num_vals": smallest["n"]}})
    vectors = encoder.encode(split).select(F.col("__features"), label, "in_test", "draw", "tie")
    vectors = vectors.repartition(parts, "draw").sortWithinPartitions("draw", "tie").persist()
    try:
        forest = RandomForestClassifier if classify else RandomForestRegressor
        model = forest(
            labelCol="label", featuresCol="__features", numTrees=trees, maxDepth=depth, seed=seed,
            featureSubsetStrategy="sqrt" if classify else "all",
        ).fit(vectors.filter(~F.col("in_test")))
        scored = model.transform(vectors.filter("in_test"))
        y, guess = F.col("label"), F.col("prediction")
        sums = scored.agg(
            F.count("*").alias("n_test"),
            F.avg((y == guess).cast("double")).alias("accuracy"),
            F.sum((y - guess) * (y - guess)).alias("missed"),
            (F.var_pop(y) * F.count(y)).alias("spread"),
        ).first()
    finally:
        vectors.unpersist()
    if classify:
        name, score = "accuracy", sums["accuracy"]
    else:
        name, score = "r2", 1 - sums["missed"] / sums["spread"] if sums["spread"] else 0.0
    weights = model.featureImportances.toArray()
    ordered = sorted(zip(names.values(), weights), key=lambda pair: (-pair[1], pair[0]))[:max_features]
    head = (True, None, target, "classification" if classify else "regression", name, round(float(score), 4))
    sizes_ = (n, n - sums["n_test"], sums["n_test"])
    records = [(*head, *sizes_, i + 1, c, round(float(w), 4)) for i, (c, w) in enumerate(ordered)]
    return Importance(small_table(spark, records, TABLE_SCHEMA), Scorer(model, features, codes, classes))


def _renamed(codes: DataFrame, names: dict[str, str]) -> tuple[DataFrame]:
    """Codes under the working names of the features."""
    pairs = small_table(codes.sparkSession, [(c, x) for x, c in names.items()], "feature string, x string")
    return (codes.join(F.broadcast(pairs), "feature").select(F.col("x").alias("feature"), "value", "code"),)

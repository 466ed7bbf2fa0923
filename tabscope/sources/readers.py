"""Table readers: the file extension picks the format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.columns import long_texts, ref, text_columns
from tabscope.functions.text import number_of_stripped, strip, to_number

# Cell texts that mean "missing" in CSV.
MISSING_MARKS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_INTEGER = r"\A[+-]?\d{1,19}\z"
_BOOLEANS = ["True", "TRUE", "true", "False", "FALSE", "false"]


def load(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Read one table.

    ``schema`` spares CSV and JSON the pass that finds the types. With
    ``multi_line`` a CSV cell may span lines and JSON need not have one record
    per line; then Spark has to read text files whole, one task each. If it is
    left out, CSV is split among tasks, as is JSON in files ending in ``.jsonl``
    or ``.ndjson``; other JSON is read whole.
    """
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if extension == "parquet":
        return spark.read.parquet(path)
    if extension in ("json", "jsonl", "ndjson"):
        # These names promise one record per line, so the file is split among tasks.
        whole = extension == "json" if multi_line is None else multi_line
        reader = spark.read.option("multiLine", whole)
        return (reader.schema(schema) if schema else reader).json(path)
    if extension == "csv":
        return read_csv(spark, path, schema, bool(multi_line))
    raise ValueError(f"no reader for files ending in .{extension}")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header; number and truth columns are recognised.

    Text that looks like a date stays text, to be converted by choice. The marks
    of a missing value are null with and without a schema.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"')
    if schema:
        # Columns of other types are null where the text does not fit, marks included.
        typed = reader.schema(schema).csv(path)
        texts = set(text_columns(typed))
        return typed.select(*[_present(c) if c in texts else ref(c) for c in typed.columns])
    raw = reader.csv(path)
    return infer_types(raw.select(*[_present(c) for c in raw.columns]))


def _present(name: str) -> Column:
    return F.when(~ref(name).isin(MISSING_MARKS), ref(name)).alias(name)


def infer_types(df: DataFrame) -> DataFrame:
    """Retype text columns whose every value is a whole number, a number or a truth value.

    One aggregation decides about all columns.
    """
    names = text_columns(df)
    if not names:
        return df

    texts = long_texts(df, names).filter(F.col("value").isNotNull()).withColumn("trimmed", strip(F.col("value")))
    trimmed = F.col("trimmed")
    counts = texts.groupBy("column").agg(
        F.count("*").alias("values"),
        F.count_if(trimmed.rlike(_INTEGER) & trimmed.try_cast("bigint").isNotNull()).alias("whole"),
        F.count_if(number_of_stripped(trimmed).isNotNull()).alias("number"),
        F.count_if(F.col("value").isin(_BOOLEANS)).alias("truth"),
    )
    casts: dict[str, Column] = {}
    for row in counts.collect():  # one row per text column that has values
        c = row["column"]
        if row["whole"] == row["values"]:
            casts[c] = strip(ref(c)).try_cast("bigint")
        elif row["number"] == row["values"]:
            casts[c] = to_number(ref(c))
        elif row["truth"] == row["values"]:
            casts[c] = F.lower(ref(c)) == "true"
    return df.select(*[casts.get(c, ref(c)).alias(c) for c in df.columns])

"""Columns that hold personal data, found by the shape of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.columns import long_texts, position_in, small_table, text_columns
from tabscope.functions.dates import parse_stripped
from tabscope.functions.text import digits_of, strip

# The share of values that must fit, the shapes, and the labels.
MATCH_THRESHOLD = 0.8
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
SSN = r"^\d{3}-\d{2}-\d{4}$"
PHONE_SEPARATOR = r"[-\s()+]"
IP_ADDRESS = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
CREDIT_CARD = r"^\d[\d\s-]{11,22}\d$"
LABELS = {
    "email": "Email address",
    "ssn": "Social Security Number",
    "credit_card": "Credit card number",
    "ip_address": "IP address",
    "phone": "Phone number",
}
CARD_DIGITS = (13, 19)
PHONE_DIGITS = (7, 15)

RATES = ["email", "ssn", "card_shape", "card_valid", "ip_shape", "ip_valid", "phone"]


def _share(test: Column, among: Column) -> Column:
    """Share of the values in ``among`` that pass; null if there are none."""
    return F.avg(F.when(among, F.coalesce(test, F.lit(False)).cast("double")))


def _rates(v: Column) -> dict[str, Column]:
    present = v.isNotNull()
    # Digits are only picked out of values whose shape or separators make them worth it.
    card = v.rlike(CREDIT_CARD)
    card_digits = F.when(card, digits_of(v))
    ip = v.rlike(IP_ADDRESS)
    separated = v.rlike(PHONE_SEPARATOR)
    octets = F.forall(F.split(F.when(ip, v), r"\."), lambda x: x.cast("int") <= 255)
    return {
        "email": _share(v.rlike(EMAIL), present),
        "ssn": _share(v.rlike(SSN), present),
        "card_shape": _share(card, present),
        "card_valid": _share(F.call_function("luhn_check", card_digits), F.length(card_digits).between(*CARD_DIGITS)),
        "ip_shape": _share(ip, present),
        "ip_valid": _share(octets, ip),
        "phone": _share(F.length(F.when(separated, digits_of(v))).between(*PHONE_DIGITS), present),
    }


def pii_rates(df: DataFrame) -> DataFrame:
    """Match rates of every text column, from one pass over all of them."""
    texts = text_columns(df)
    trimmed = long_texts(df, texts).withColumn("value", strip(F.col("value")))
    rates = [rate.alias(name) for name, rate in _rates(F.col("value")).items()]
    return trimmed.groupBy("column").agg(*rates).select(position_in(texts, F.col("column")).alias("position"), "*")


def detect_pii_columns(df: DataFrame) -> DataFrame:
    """Rows ``(column, kind, label)``: per column the first kind that most of its values fit.

    Dates with separators have as many digits as phone numbers, so columns that
    would pass as phone numbers are read once more to see whether they are dates.
    """
    schema = "column string, kind string, label string"
    spark = df.sparkSession
    texts = text_columns(df)
    if not texts:
        return small_table(spark, [], schema)
    enough = lambda rate: rate is not None and rate >= MATCH_THRESHOLD
    kinds: dict[str, str] = {}
    for row in pii_rates(df).collect():  # one row per text column
        if enough(row["email"]):
            kinds[row["column"]] = "email"
        elif enough(row["ssn"]):
            kinds[row["column"]] = "ssn"
        elif enough(row["card_shape"]) and enough(row["card_valid"]):
            kinds[row["column"]] = "credit_card"
        elif enough(row["ip_shape"]) and enough(row["ip_valid"]):
            kinds[row["column"]] = "ip_address"
        elif enough(row["phone"]):
            kinds[row["column"]] = "phone"
    phones = [c for c in texts if kinds.get(c) == "phone"]
    if phones:
        trimmed = long_texts(df, phones).withColumn("value", strip(F.col("value")))
        dates = _share(parse_stripped(F.col("value")).isNotNull(), F.col("value").isNotNull())
        for row in trimmed.groupBy("column").agg(dates.alias("dates")).collect():  # one row per such column
            if enough(row["dates"]):
                del kinds[row["column"]]
    return small_table(spark, [(c, kinds[c], LABELS[kinds[c]]) for c in texts if c in kinds], schema)


def drop_pii_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The table without its personal-data columns, for anything that leaves the house."""
    found = [r["column"] for r in detect_pii_columns(df).collect()]
    return df.drop(*[c for c in found if c not in keep])

import pytest

from tabscope.operators.pii import detect_pii_columns, drop_pii_columns
from tests.conftest import as_dicts


def found(table, values):
    rows = as_dicts(detect_pii_columns(table("v string", [(v,) for v in values])))
    return rows[0]["kind"] if rows else None


CARDS = ["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "4012888888881881"]


@pytest.mark.parametrize(
    "values, kind",
    [
        (["a@x.com", "b.c@y.org", "d@z.net"], "email"),
        ([" a@x.com ", "b@y.org\n"], "email"),
        (["555-123-4567", "(555) 987-6543", "+1 555 222 3333"], "phone"),
        (["123-45-6789", "987-65-4321"], "ssn"),
        (["192.168.0.1", "10.0.0.255", "8.8.8.8"], "ip_address"),
        (CARDS, "credit_card"),
        ([str(i) for i in range(1000000, 1000020)], None),
        (["2024-01-05", "2024-02-06", "2024-03-07"], None),
        (["999.999.999.999", "888.777.666.555"], None),
        ([str(1234567890123456 + i) for i in range(20)], None),
        (["a@x.com", "b@x.com"] + ["text"] * 8, None),
        (["a@x.com"] * 8 + ["text"] * 2, "email"),
        (["Alice", "Bob"], None),
        ([None, None], None),
    ],
)
def test_kinds(table, values, kind):
    assert found(table, values) == kind


def test_each_column_has_one_kind_and_can_be_dropped(table):
    df = table("id int, mail string, phone string, note string", [(1, "a@x.com", "555-123-4567", "x"), (2, "b@x.com", "555-123-4568", None)])
    rows = as_dicts(detect_pii_columns(df))
    assert [(r["column"], r["kind"], r["label"]) for r in rows] == [("mail", "email", "Email address"), ("phone", "phone", "Phone number")]
    assert drop_pii_columns(df).columns == ["id", "note"]
    assert drop_pii_columns(df, keep=("mail",)).columns == ["id", "mail", "note"]
    assert detect_pii_columns(df.select("id")).count() == 0

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from payrecheck.functions import money, names, text
from payrecheck.functions.dates import parse_date, utc_stamp

VENDORS = {
    "AT&T CORP": "ATT",
    "THE ACME COMPANY": "ACME",
    "Acme, Inc.": "ACME",
    "ACME INC": "ACME",
    "Smith and Sons LLC": "SMITHSONS",
    "Smith & Sons, L.L.C.": "SMITHSONSLLC",
    "the the Co Inc": None,
    "   ***  ": None,
    "": None,
    None: None,
    "Anderson Land Co": "ANDERSONLAND",
    "Company Store": "COMPANYSTORE",
    "Theodore The": "THEODORE",
    "INCA TRAIL LTD CORP": "INCATRAIL",
    "Café Straße GmbH": "CAFÉSTRASSEGMBH",
    "A B Inc": "AB",
}
INVOICES = {
    "INV-0042": "42",
    "inv 42": "42",
    "INV": None,
    "000": "0",
    "INVOICE-0042": "INVOICE0042",
    "INV42A": "42A",
    " 00-7/b ": "7B",
    "--": None,
    "": None,
    None: None,
    "INVÉ1": "INVÉ1",
    " INV-9\t": "9",
}
DATES = {
    "2024-06-11": (2024, 6, 11),
    "2024-6-1": (2024, 6, 1),
    "2024-06-11T00:00:00.000": (2024, 6, 11),
    "2024-06-11T23:59:59+02:00": (2024, 6, 11),
    "20240611T10": (2024, 6, 11),
    "6/1/2024": (2024, 6, 1),
    "06/01/70": (1970, 6, 1),
    "6/1/68": (2068, 6, 1),
    "2024/6/1": (2024, 6, 1),
    "20240611": (2024, 6, 11),
    "2024-W24-2": (2024, 6, 11),
    "2020W537": (2021, 1, 3),
    "2021-W53-1": None,
    "13/13/2020": None,
    "2024": None,
    "2024-06": None,
    "OCT 5": None,
    "2024-02-30": None,
    " \t": None,
}
MONEY = {
    "$1,234.50": "1234.50",
    "-12.3": "-12.30",
    " 7 ": "7.00",
    "1E+3": "1000.00",
    "1_000": "1000.00",
    "1.100": "1.10",
    "-3450.005": None,
    "0.0000000000000000000001": None,
    "(1.00)": None,
    "NaN": None,
    "": None,
    ".5": "0.50",
}


def apply(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "table, expr",
    [(VENDORS, text.canonical_vendor), (INVOICES, text.canonical_invoice)],
)
def test_keys(spark, table, expr):
    assert apply(spark, table, expr) == list(table.values())


def test_dates(spark):
    want = [v and dt.date(*v) for v in DATES.values()]
    assert apply(spark, DATES, parse_date) == want


def test_money(spark):
    want = [v and Decimal(v) for v in MONEY.values()]
    assert apply(spark, MONEY, money.parse_money) == want


def test_labels(spark):
    one = spark.range(1)
    row = one.select(
        money.money_label(F.lit("-1234567.5").cast("decimal(18,2)")),
        utc_stamp(F.timestamp_seconds(F.lit(0))),
        names.title_department(F.lit("  bureau OF the o'neil-and works ")),
        names.approver_for(F.lit(" public  works ")),
        names.approver_for(F.lit(None).cast("string")),
        text.normalise_status(F.lit(" void-ed__x ")),
        text.markdown_cell(F.lit("a|b\nc")),
    ).first()
    assert row[0] == "-$1,234,567.50"
    assert row[1] == "1970-01-01 00:00:00 UTC"
    assert row[2] == "Bureau of the O'Neil-And Works"
    assert (row[3], row[4]) == ("Elena Voss", "Alex Rivera")
    assert row[5] == "VOID ED X"
    assert row[6] == "a\\|b c"


def test_masking(spark):
    shown = apply(
        spark,
        ["Jane Doe", "Doe, Jane A.", "Acme Supply", "Madonna", "A B C D E", "Jane 2 Doe", None],
        names.mask_personal_name,
    )
    assert shown == [
        "Individual · J. D.",
        "Individual · D. J. A.",
        "Acme Supply",
        "Madonna",
        "A B C D E",
        "Jane 2 Doe",
        None,
    ]


def test_canonical_mask_follows_raw_name(spark):
    df = spark.createDataFrame([("JANEDOE", "Jane Doe"), ("ACME", "Acme Inc")], "c string, r string")
    rows = df.select(names.mask_canonical(F.col("c"), F.col("r"))).collect()
    assert [r[0] for r in rows] == ["Individual · J. D.", "ACME"]


def test_pair_ids(spark):
    ids = apply(spark, ["s:a:b", "x:y:a:b", "a:b", "s::b"], text.candidate_pair_ids)
    assert [i and tuple(i) for i in ids] == [("a", "b"), ("a", "b"), None, None]

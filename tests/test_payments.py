from decimal import Decimal

import pytest
from conftest import line

from payrecheck.operators.payments import aggregate_payments, field_disagreements


def test_two_hundred_lines_sum_exactly(make_lines):
    amounts = ["10.01", "20.02", "30.03", "0.10", "41.33"]
    rows = [line("t", amount=amounts[i % 5]) for i in range(200)]
    got = aggregate_payments(make_lines(rows)).first()
    assert got.amount == Decimal("4059.60")
    assert got.line_count == 200
    assert got.distinct_line_amounts == sorted(Decimal(a) for a in amounts)


@pytest.mark.parametrize("partitions", [1, 7])
def test_agree_or_null(spark, make_lines, partitions):
    rows = [
        line("a", department=" ", vendor_name_raw="X"),
        line("a", department="FIRE", vendor_name_raw="Y"),
        line("a", department=None, vendor_name_raw="X", po_number="PO2"),
        line("b"),
    ]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        payments = aggregate_payments(make_lines(rows[::-1]).repartition(3))
        got = {r.transaction_id: r for r in payments.collect()}
        named = {tuple(r) for r in field_disagreements(payments).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got["a"].department == "FIRE"
    assert got["a"].vendor_name_raw == ""
    assert got["a"].po_number is None
    assert got["a"].disagreed_fields == ["po_number", "vendor_name_raw"]
    assert got["b"].disagreed_fields == []
    assert named == {("a", "po_number"), ("a", "vendor_name_raw")}


def test_blank_id_is_an_error(make_lines):
    with pytest.raises(Exception, match="transaction_id is required"):
        aggregate_payments(make_lines([line(" ")])).collect()

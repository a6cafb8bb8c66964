import datetime as dt

import pytest

from payrecheck.operators.dismissal import dismiss
from payrecheck.operators.findings import rules_only_verdicts
from payrecheck.operators.funnel import dollars_at_risk, survivors
from payrecheck.schema import CANDIDATE

SPLIT = {
    "a": {"amount": "91.21", "line_count": 3, "distinct_line_amounts": ["30.00", "31.21"]},
    "b": {"amount": "1383.53", "line_count": 6, "distinct_line_amounts": ["1.00", "2.00"]},
}


def candidates(spark, *pairs):
    from decimal import Decimal

    rows = [(f"s:{a}:{b}", a, b, "split_payment", Decimal(1), "blocking") for a, b in pairs]
    return spark.createDataFrame(rows, CANDIDATE)


def outcome(spark, make_payments, left, right, pair=("a", "b")):
    payments = make_payments([{"tid": "a", **left}, {"tid": "b", **right}])
    found = candidates(spark, pair)
    residual, verdicts = dismiss(found, payments)
    rows = verdicts.collect()
    assert residual.count() + len(rows) == 1
    return rows[0].explanation_type if rows else None


def test_line_split(spark, make_payments):
    assert outcome(spark, make_payments, SPLIT["a"], SPLIT["b"]) == "line_split"


@pytest.mark.parametrize(
    "change",
    [
        {"invoice_number_raw": "999"},
        {"vendor_id": "V2"},
        {"vendor_id": None, "vendor_name_raw": "Other"},
        {"amount": "91.21"},
        {"line_count": 1},
        {"distinct_line_amounts": []},
        {"distinct_line_amounts": ["31.21", "30.00"]},
        {"payment_date": dt.date(2024, 3, 5)},
        {"payment_date": None},
        {"payment_method": "CHECK"},
        {"po_number": "PO9"},
    ],
)
def test_line_split_needs_every_proof(spark, make_payments, change):
    assert outcome(spark, make_payments, SPLIT["a"], {**SPLIT["b"], **change}) is None


@pytest.mark.parametrize("change", [{"payment_method": None}, {"po_number": None}, {"vendor_id": None}])
def test_absent_values_do_not_conflict(spark, make_payments, change):
    assert outcome(spark, make_payments, SPLIT["a"], {**SPLIT["b"], **change}) == "line_split"


@pytest.mark.parametrize("status, hit", [("Void-ed", False), (" voided ", True), ("CANCELLED", True), (None, False), ("paid", False)])
def test_cancelled(spark, make_payments, status, hit):
    got = outcome(spark, make_payments, {}, {"payment_status": status})
    assert got == ("cancelled" if hit else None)


def test_cancelled_wins_over_line_split(spark, make_payments):
    left = {**SPLIT["a"], "payment_status": "REVERSED"}
    assert outcome(spark, make_payments, left, SPLIT["b"]) == "cancelled"


def test_same_id_needs_no_rows_and_missing_rows_stay(spark, make_payments):
    assert outcome(spark, make_payments, {}, {}, pair=("z", "z")) == "none"
    assert outcome(spark, make_payments, {"payment_status": "VOID"}, {}, pair=("a", "z")) is None


def test_rules_only_gives_each_candidate_one_verdict(spark, make_payments):
    payments = make_payments([{"tid": "a"}, {"tid": "b"}, {"tid": "c", "payment_status": "VOID"}])
    found = candidates(spark, ("a", "b"), ("a", "c"), ("a", "gone"))
    rows = {r.candidate_id: r for r in rules_only_verdicts(found, payments).collect()}
    assert {k: v.verdict for k, v in rows.items()} == {
        "s:a:b": "escalate",
        "s:a:c": "dismiss",
        "s:a:gone": "escalate",
    }
    assert rows["s:a:b"].confidence is None and rows["s:a:b"].model_used is None
    assert [e.field for e in rows["s:a:gone"].evidence] == ["transaction_ids", "signal", "amount_at_risk"]
    assert len(rows["s:a:b"].evidence) == 10
    verdicts = rules_only_verdicts(found, payments)
    assert survivors(found, verdicts).count() == 2
    assert dollars_at_risk(found).first().distinct_pairs == 3

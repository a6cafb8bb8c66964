"""Steps over candidates that must not exchange, write or widen all of them."""

from decimal import Decimal

from pyspark.sql import functions as F

from payrecheck.operators import scoring as S
from payrecheck.operators.blocking import block
from payrecheck.operators.dismissal import rule_candidates
from payrecheck.operators.findings import SHOWN_FIELDS, judged_candidates
from payrecheck.operators.funnel import dollars_at_risk
from payrecheck.operators.signals import default_signals, lone_signals
from payrecheck.plans.runs import rules_only_run
from payrecheck.schema import Capabilities
from payrecheck.session import ADVISORY_CONF, stage
from tests.conftest import line


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _payments(make_payments):
    return make_payments(
        [
            {"tid": "A"},
            {"tid": "B"},
            {"tid": "C", "vendor_name_raw": "Other Works LLC", "vendor_id": "V2"},
            {"tid": "D", "invoice_number_raw": "INV-200"},
            {"tid": "E", "invoice_number_raw": "INV-200", "payment_status": "VOID"},
        ]
    )


def test_pairs_of_lone_signals_are_added_up_before_the_exchange(make_payments):
    signals = default_signals(Capabilities())
    assert set(lone_signals(signals)) == {"fuzzy_vendor", "invoice_variant"}
    without = default_signals(Capabilities(has_invoice_number=False, has_invoice_amount=False))
    assert lone_signals(without) == ("fuzzy_vendor",)
    found = block(_payments(make_payments))
    lone = lone_signals(signals)
    assert found.filter(F.col("signal").isin(*lone)).count() > 1
    assert dollars_at_risk(found, lone).first() == dollars_at_risk(found).first()
    assert dollars_at_risk(found.limit(0), lone).first() == dollars_at_risk(found.limit(0)).first()


def test_a_run_joins_no_candidates(make_lines):
    run = rules_only_run(make_lines([line("A"), line("B"), line("C", payment_status="VOID")]))
    for table in (run.candidates, run.residual, run.verdicts):
        assert "Join" not in _plan(table)
    assert run.residual.select("left_id", "right_id").distinct().collect() == [("A", "B")]


def test_cases_are_found_without_their_pairs_meeting_all_others(spark, make_payments):
    payments = _payments(make_payments)
    truth = spark.createDataFrame(
        [
            ("dup", "duplicate", "exact_duplicate", ["A", "B"], Decimal("100.00")),
            ("twice", "duplicate", "exact_duplicate", ["A", "B", "Z"], Decimal("1.00")),
            ("void", "decoy", "cancelled", ["D", "E"], None),
            ("far", "decoy", "recurring", ["C"], None),
        ],
        "case_id string, kind string, label string, transaction_ids array<string>, amount decimal(18,2)",
    )
    known = S.with_cases(payments, truth)
    judged = judged_candidates(rule_candidates(known, fields=(*SHOWN_FIELDS, S.CASES)), known)
    inside = S.inside_cases(judged)
    assert "Join" not in _plan(inside).split("Generate")[0]
    assert {(r.left_id, r.right_id) for r in inside.collect()} == {("A", "B"), ("D", "E")}
    every = S.case_hits(S.flagged_pairs(judged), truth)
    cases = S.case_hits(S.flagged_pairs(inside), truth)
    assert sorted(cases.collect()) == sorted(every.collect())
    assert {r.case_id for r in cases.filter("hit").collect()} == {"dup", "twice"}


def test_a_staged_job_divides_its_exchange(spark):
    was = spark.conf.get(ADVISORY_CONF)
    grouped = spark.range(200_000).groupBy("id").agg(F.count("*").alias("n"))
    assert len(stage(grouped, "divided", "100b").inputFiles()) > 1
    assert spark.conf.get(ADVISORY_CONF) == was

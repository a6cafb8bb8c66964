"""Work that grows with the payments must not cross an exchange once for every candidate."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from checks import whole_results as W
from payrecheck.operators.blocking import block
from payrecheck.operators.dismissal import RULE_FIELDS, dismiss, rule_candidates
from payrecheck.operators.explanations import (
    SERIES_FIELDS,
    explain_candidates,
    explained_candidates,
    related_payments,
    series_candidates,
)
from payrecheck.operators.findings import SHOWN_FIELDS, rules_only_verdicts
from payrecheck.operators.packets import confirmed_findings, journal_entries
from payrecheck.operators.review import (
    DEPARTMENT_FACTS,
    PAYMENT_FIELDS,
    finding_view,
    pending,
    review_queue,
    rules_only_findings,
    with_department_facts,
)
from payrecheck.plans.runs import payments_from_lines
from payrecheck.schema import LEDGER_LINE
from payrecheck.session import stage


def _payments(spark, n=40):
    day = dt.date(2024, 1, 5)
    rows = [
        (f"T{i:04d}", f"Acme {i % 3} Inc.", f"v{i % 3}", f"INV-{i % 2}", day, day, Decimal(5 + i % 2),
         Decimal(8), f"PO-{i % 4}", "EFT", "Voided" if i % 5 == 0 else None, f"unit {i % 2}", None)
        for i in range(n)
        for _ in range(1 + i % 2)
    ]
    return stage(payments_from_lines(spark.createDataFrame(rows, LEDGER_LINE)), "payments")


def _same(one, other):
    names = sorted(one.columns)
    assert names == sorted(other.columns)
    rows = [sorted(map(str, x.select(*names).collect())) for x in (one, other)]
    assert rows[0] and rows[0] == rows[1]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_read_carried_rows_without_a_join(spark):
    payments = _payments(spark)
    plain, carried = block(payments), rule_candidates(payments, fields=SHOWN_FIELDS)
    for one, other in zip(dismiss(plain, payments), dismiss(carried, payments), strict=True):
        _same(one, other)
        assert "Join" not in _plan(other)
    verdicts = rules_only_verdicts(carried, payments)
    _same(rules_only_verdicts(plain, payments), verdicts)
    assert "Join" not in _plan(verdicts)


def test_findings_read_carried_rows_without_a_join(spark):
    payments = _payments(spark)
    carried = rules_only_findings(rule_candidates(payments, fields=PAYMENT_FIELDS), payments)
    plain = rules_only_findings(block(payments), payments)
    shown = ["candidate_id", "amount_at_risk", "verdict", *[f"{s}.{f}" for s in "lr" for f in PAYMENT_FIELDS]]
    for df in (plain, carried):
        assert "is_cancelled" not in df.schema["l"].dataType.names
    rows = [sorted(map(str, df.select(*shown).collect())) for df in (plain, carried)]
    assert rows[0] and rows[0] == rows[1]
    assert "Join" not in _plan(carried)


def test_candidates_that_lack_a_field_are_joined(spark):
    payments = _payments(spark)
    partly = block(payments, carry=RULE_FIELDS[:2])
    for one, other in zip(dismiss(block(payments), payments), dismiss(partly, payments), strict=True):
        _same(one, other)


def test_carried_rows_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr("payrecheck.operators.blocking.TILE", 3)
    payments = _payments(spark)
    _same(dismiss(block(payments), payments)[0], dismiss(rule_candidates(payments), payments)[0])
    _same(
        dismiss(block(payments, cap=2), payments)[0],
        dismiss(rule_candidates(payments, cap=2), payments)[0],
    )


def test_series_meet_payments_not_candidates(spark):
    payments = _payments(spark)
    carried = series_candidates(payments)
    related = related_payments(carried, payments)
    _same(related_payments(block(payments), payments), related)
    assert set(SERIES_FIELDS) <= set(related.columns)
    # Every join stands below the pairs.
    plan = _plan(related)
    assert "Join" not in plan[: plan.index("posexplode")]


def test_explanations_read_carried_rows_without_a_join_of_candidates(spark):
    said = ["Progress payment 1 of 5", "progress payment 2 of 5", "Line 1 of 2", "line 2 of 2",
            "VOID", "balance outstanding", None]
    text = F.element_at(
        F.array(*[F.lit(t) for t in said]), F.substring("transaction_id", 2, 4).cast("int") % 7 + 1
    )
    payments = stage(_payments(spark, 50).withColumn("description", text), "described")
    tests = explain_candidates(explained_candidates(payments), payments)
    _same(explain_candidates(block(payments), payments), tests)
    found = tests.agg(*[F.max(c) for c in ("cancelled", "line_split", "progress_payment")]).first()
    assert all(found)
    plan = _plan(tests)
    assert "Join" not in plan[: plan.index("posexplode")]


def test_findings_and_decisions_are_never_broadcast(spark):
    """Of 40 payments there are 780 pairs of one key, which the optimiser does not expect."""
    payments = _payments(spark)
    findings = rules_only_findings(rule_candidates(payments, fields=PAYMENT_FIELDS), payments)
    decisions = findings.select(
        "candidate_id", F.lit("R. Viewer").alias("approver"), F.lit("confirmed").alias("decision"),
        F.lit("checked").alias("reason"), F.lit(True).alias("becomes_rule"),
    )
    entries = journal_entries(confirmed_findings(findings, decisions))
    assert entries.count() == 2 * findings.count()
    for df in (entries, pending(findings, decisions.limit(1))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_departments_are_read_once_a_payment(spark):
    payments = _payments(spark)
    plain = rule_candidates(payments, fields=PAYMENT_FIELDS)
    known = with_department_facts(payments)
    carried = rule_candidates(known, fields=(*PAYMENT_FIELDS, *DEPARTMENT_FACTS))
    plain, carried = (rules_only_findings(c, payments) for c in (plain, carried))
    none = plain.select("candidate_id").limit(0)
    _same(finding_view(plain), finding_view(carried))
    _same(review_queue(plain, none), review_queue(carried, none))
    assert finding_view(plain).schema["left"] == finding_view(carried).schema["left"]
    # Titles are written below the pairs.
    plan = _plan(finding_view(carried))
    assert "initcap" in plan and "initcap" not in plan[: plan.index("posexplode")]


def test_splits_grow_with_the_files(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(60_000).selectExpr("repeat('x', 99) AS value").coalesce(1).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []

    def read():
        seen.append(int(spark.conf.get("spark.sql.files.maxPartitionBytes")))
        return spark.read.text(path)

    assert W._divided(spark, path, read).count() == 60_000
    W._SPLITS, was = 10, W._SPLITS
    try:
        W._divided(spark, path, read)
    finally:
        W._SPLITS = was
    assert seen == [W._SPLIT, 600_000]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before

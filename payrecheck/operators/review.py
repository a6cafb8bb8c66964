"""The review queue: what waits for a person, and what they decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrecheck.functions.money import money_label
from payrecheck.functions.names import (
    approver_for,
    mask_canonical,
    mask_personal_name,
    redact_pair,
    title_department,
)
from payrecheck.functions.text import optional_text, signal_label, strip
from payrecheck.operators.dismissal import CANCELLED, annotate
from payrecheck.operators.findings import verdict_columns
from payrecheck.operators.funnel import FUNNEL
from payrecheck.operators.lookup import attach_pair
from payrecheck.operators.spread import spread_left_join
from payrecheck.schema import DECISIONS, TRANSACTION

PENDING_OUTCOMES = ("escalate", "errored")
PAYMENT_FIELDS = tuple(f for f in TRANSACTION.fieldNames() if f != "disagreed_fields")

# What is shown of a payment's department, found once for a payment instead of once for each of its pairs.
DEPARTMENT_FACTS = ("approver", "department_title")

# The fields shown side by side, with their labels.
DIFF_FIELDS = {
    "vendor_name_raw": "Vendor",
    "amount": "Amount",
    "invoice_number_raw": "Invoice",
    "invoice_date": "Invoice date",
    "payment_date": "Paid",
    "invoice_amount": "Invoice amount",
    "po_number": "PO",
    "payment_method": "Method",
    "payment_status": "Status",
    "department": "Department",
    "description": "Description",
    "transaction_id": "Id",
}
NOTHING_SHOWN = "—"


def with_department_facts(payments: DataFrame) -> DataFrame:
    """``payments`` with approver and title of their department, for blocking to carry."""
    unit = F.col("department")
    shown = (approver_for(unit), title_department(unit))
    return payments.withColumns(dict(zip(DEPARTMENT_FACTS, shown, strict=True)))


def _department(findings: DataFrame) -> tuple[Column, Column]:
    """Approver and title of the left payment's department, as carried where they were."""
    left = F.col("l")
    if set(DEPARTMENT_FACTS) <= set(findings.schema["l"].dataType.names):
        return left[DEPARTMENT_FACTS[0]], left[DEPARTMENT_FACTS[1]]
    return approver_for(left["department"]), title_department(left["department"])


def assemble_findings(
    candidates: DataFrame, verdicts: DataFrame, payments: DataFrame, strict: bool = True
) -> DataFrame:
    """Candidate, verdict and both payments in one row per candidate.

    In strict mode a candidate without a verdict or payment fails the job;
    otherwise it is left out.
    """
    joined = attach_pair(candidates, payments, PAYMENT_FIELDS).join(
        verdicts.select("candidate_id", F.struct("*").alias("verdict")),
        "candidate_id",
        "left",
    )
    whole = F.col("l").isNotNull() & F.col("r").isNotNull() & F.col("verdict").isNotNull()
    if not strict:
        return joined.filter(whole)
    lacking = F.concat(
        F.lit("no verdict or payment for candidate "), F.col("candidate_id")
    )
    return joined.withColumn(
        "candidate_id", F.when(whole, F.col("candidate_id")).otherwise(F.raise_error(lacking))
    )


def rules_only_findings(candidates: DataFrame, payments: DataFrame) -> DataFrame:
    """``assemble_findings`` of the rules' verdicts, in one pass over the candidates.

    Every candidate has its verdict here; one without a payment fails the job.
    """
    fields = ("department", "description", *PAYMENT_FIELDS)
    lacking = F.concat(F.lit("no payment for candidate "), F.col("candidate_id"))
    whole = F.col("l").isNotNull() & F.col("r").isNotNull()
    checked = F.when(whole, F.col("candidate_id")).otherwise(F.raise_error(lacking))
    own = [c for c in candidates.columns if c not in ("candidate_id", "l", "r")]
    sides = [F.col(s).dropFields(CANCELLED).alias(s) for s in ("l", "r")]
    return annotate(candidates, payments, *fields).select(
        checked.alias("candidate_id"), *own, *sides, F.struct(*verdict_columns()).alias("verdict")
    )


def pending(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Escalated or errored findings nobody has decided.

    No side is broadcast: the sizes that the optimiser expects of pairs are those of payments.
    """
    waiting = findings.filter(F.col("verdict.verdict").isin(*PENDING_OUTCOMES))
    return waiting.hint("merge").join(decisions.select("candidate_id"), "candidate_id", "left_anti")


def review_queue(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue as reviewers see it; sort with ``in_queue_order``."""
    left = F.col("l")
    approver, department = _department(findings)
    return pending(findings, decisions).select(
        "candidate_id",
        "amount_at_risk",
        mask_personal_name(left["vendor_name_raw"]).alias("vendor_name"),
        "signal",
        F.col("verdict.confidence").alias("confidence"),
        approver.alias("approver"),
        department.alias("department"),
    )


def in_queue_order(queue: DataFrame) -> DataFrame:
    """Largest amount first, then by id: for display and sinks only."""
    return queue.orderBy(F.desc("amount_at_risk"), F.asc("candidate_id"))


def with_display_labels(queue: DataFrame) -> DataFrame:
    """Text columns for a screen: money, signal, percent."""
    given = F.col("confidence").isNotNull()
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))
    spaced = signal_label(F.col("signal"))
    # Percent rounds halves up, as a screen does.
    percent = F.when(given, F.concat(F.floor(clamped * 100 + 0.5).cast("string"), F.lit("%")))
    return queue.withColumns(
        {
            "amount_label": money_label(F.col("amount_at_risk")),
            "signal_label": F.concat(F.upper(F.substring(spaced, 1, 1)), F.substr(spaced, F.lit(2))),
            "confidence_label": F.coalesce(percent, F.lit(NOTHING_SHOWN)),
        }
    )


def verdict_label(verdict: Column) -> Column:
    return F.when(verdict == "errored", F.lit("Errored, not guessed")).otherwise(
        F.initcap(verdict)
    )


def _masked(side: str) -> Column:
    row = F.col(side).dropFields(*DEPARTMENT_FACTS)
    raw = row["vendor_name_raw"]
    return row.withField("vendor_name_raw", mask_personal_name(raw)).withField(
        "vendor_canonical", mask_canonical(row["vendor_canonical"], raw)
    )


def finding_view(findings: DataFrame) -> DataFrame:
    """One finding in full, with personal names masked wherever they occur."""
    approver, department = _department(findings)
    masked_evidence = F.transform(
        "verdict.evidence",
        lambda e: e.withField("values", F.transform(e["values"], redact_pair)),
    )
    return findings.select(
        "candidate_id",
        "amount_at_risk",
        "signal",
        approver.alias("approver"),
        department.alias("department"),
        _masked("l").alias("left"),
        _masked("r").alias("right"),
        redact_pair(F.col("verdict.reasoning")).alias("reasoning"),
        masked_evidence.alias("evidence"),
        "verdict.model_used",
        "verdict.confidence",
        "verdict.verdict",
    )


def field_diff(findings: DataFrame) -> DataFrame:
    """``candidate_id, field, left, right, differs``: twelve rows per finding.

    Shown texts are compared, so two absent values do not differ.
    """
    views = findings.select("candidate_id", _masked("l").alias("l"), _masked("r").alias("r"))

    def shown(side: str, name: str) -> Column:
        value = F.col(f"{side}.{name}")
        text = money_label(value) if name.endswith("amount") else value.cast("string")
        return F.coalesce(F.nullif(text, F.lit("")), F.lit(NOTHING_SHOWN))

    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("field"),
                shown("l", name).alias("left"),
                shown("r", name).alias("right"),
            )
            for name, label in DIFF_FIELDS.items()
        ]
    )
    return (
        views.select("candidate_id", F.explode(rows).alias("d"))
        .select("candidate_id", "d.*")
        .withColumn("differs", F.col("left") != F.col("right"))
    )


def intake_decisions(
    submitted: DataFrame, findings: DataFrame, decided: DataFrame
) -> DataFrame:
    """Check a batch of decisions: ``seq`` orders them, the first usable one wins.

    Returns every submitted row with ``reject_reason`` (null = accepted), the
    stripped reason and the approver filled in from the department.
    """
    known = findings.select("candidate_id", _department(findings)[0].alias("_default"))
    before = decided.select("candidate_id", F.lit(True).alias("_decided")).distinct()
    # The batch is small beside the findings: look up its distinct ids, not rows.
    ids = submitted.select("candidate_id").distinct()
    status = ids.join(known, "candidate_id", "left").join(before, "candidate_id", "left")
    reason = optional_text(F.col("reason"))
    numbers = submitted.groupBy("seq").agg(F.count(F.lit(1)).alias("_same"))
    numbered = submitted.join(numbers, "seq", "left")
    checked = spread_left_join(numbered, status, ["candidate_id"], "seq").withColumn(
        "reject_reason",
        # Two rows with one number have no order.
        F.when(F.col("seq").isNull(), "seq is required")
        .when(F.col("_same") > 1, "repeated seq")
        .when(reason.isNull(), "reason is required")
        .when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "unknown decision")
        .when(F.col("_default").isNull(), "unknown candidate")
        .when(F.col("_decided"), "already decided"),
    )
    # The earliest usable row per candidate, combined map-side; it is found
    # again by its unique seq, so no candidate's rows meet in one window.
    winners = (
        checked.filter("reject_reason IS NULL")
        .groupBy("candidate_id")
        .agg(F.min("seq").alias("seq"))
        .select("candidate_id", "seq", F.lit(True).alias("_first"))
    )
    late = F.col("reject_reason").isNull() & F.col("_first").isNull()
    return checked.join(winners, ["candidate_id", "seq"], "left").select(
        "seq",
        "candidate_id",
        F.coalesce(optional_text(F.col("approver")), F.col("_default")).alias("approver"),
        "decision",
        strip(F.col("reason")).alias("reason"),
        F.coalesce("becomes_rule", F.lit(True)).alias("becomes_rule"),
        F.when(late, F.lit("already decided"))
        .otherwise(F.col("reject_reason"))
        .alias("reject_reason"),
    )


def accepted_decisions(checked: DataFrame) -> DataFrame:
    return checked.filter("reject_reason IS NULL").select(
        "candidate_id", "approver", "decision", "reason", "becomes_rule"
    )


def review_stats(
    findings: DataFrame,
    decisions: DataFrame,
    funnel: DataFrame | None = None,
    data_source: str = "pipeline",
) -> DataFrame:
    """One row: pending, money pending, decisions by kind, and the funnel."""
    money = "decimal(28,2)"
    zero = F.lit(0).cast("bigint")
    none = F.lit(0).cast(money)
    waiting = pending(findings, decisions).agg(
        F.coalesce(F.sum("amount_at_risk").cast(money), none).alias("dollars_at_risk"),
        F.count(F.lit(1)).alias("pending"),
        zero.alias("confirmed"),
        zero.alias("dismissed"),
    )
    decided = decisions.agg(
        none.alias("dollars_at_risk"),
        zero.alias("pending"),
        *[
            F.count(F.when(F.col("decision") == d, 1)).alias(d)
            for d in ("confirmed", "dismissed")
        ],
    )
    parts = waiting.unionByName(decided)
    columns = ["dollars_at_risk", "pending", "confirmed", "dismissed"]
    if funnel is not None:
        parts = parts.unionByName(funnel, allowMissingColumns=True)
        columns = [*FUNNEL, *columns]
    return parts.agg(*[F.sum(c).alias(c) for c in columns]).select(
        *[F.col(c).cast(money if c == "dollars_at_risk" else "bigint").alias(c) for c in columns],
        F.lit(data_source).alias("data_source"),
    )

"""Rules-only findings: every candidate no rule dismissed goes to a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrecheck.functions.money import money_text
from payrecheck.functions.text import text_or_empty
from payrecheck.operators.dismissal import annotate, dismissal_fields, evidence
from payrecheck.schema import VERDICT_FIELDS

EVIDENCE_FIELDS = (
    "vendor_canonical",
    "invoice_canonical",
    "amount",
    "po_number",
    "payment_date",
    "payment_status",
    "department",
    "description",
)
# What verdicts show of a payment besides what the rules read.
SHOWN_FIELDS = ("department", "description")
_REASON = (
    "No fixed rule (cancelled, same transaction, line split) explains the pair; "
    "rules cannot weigh it further, so it is reported."
)


def _finding_evidence() -> Column:
    stake = ("amount_at_risk", [money_text(F.col("amount_at_risk"))])
    signal = ("signal", [F.col("signal")])
    sides = [
        (
            field,
            [text_or_empty(F.col(f"{s}.{field}").cast("string")) for s in ("l", "r")],
        )
        for field in EVIDENCE_FIELDS
    ]
    ids = ("transaction_ids", [F.col("left_id"), F.col("right_id")])
    missing = F.col("l").isNull() | F.col("r").isNull()
    return F.when(missing, evidence(ids, signal, stake)).otherwise(
        evidence(signal, stake, *sides)
    )


def finding_fields() -> dict[str, Column]:
    """Escalation of an annotated candidate: no model, no confidence."""
    zero = F.lit(0).cast("long")
    return {
        "candidate_id": F.col("candidate_id"),
        "verdict": F.lit("escalate"),
        "explanation_type": F.lit("none"),
        "reasoning": F.lit(_REASON),
        "evidence": _finding_evidence(),
        "confidence": F.lit(None).cast("double"),
        "model_used": F.lit(None).cast("string"),
        "tokens_in": zero,
        "tokens_out": zero,
        "cache_read": zero,
    }


def verdict_columns() -> list[Column]:
    """The verdict of an annotated candidate, by rule or as a finding."""
    dismissed = F.col("explanation_type").isNotNull()
    rule, finding = dismissal_fields(), finding_fields()
    return [F.when(dismissed, rule[f]).otherwise(finding[f]).alias(f) for f in VERDICT_FIELDS]


def judged_candidates(candidates: DataFrame, payments: DataFrame) -> DataFrame:
    """``rules_only_verdicts`` beside the candidate each of them is of, and its payments."""
    annotated = annotate(candidates, payments, *SHOWN_FIELDS)
    own = [c for c in annotated.columns if c not in ("candidate_id", "explanation_type")]
    return annotated.select(*own, *verdict_columns())


def rules_only_verdicts(candidates: DataFrame, payments: DataFrame) -> DataFrame:
    """One verdict per candidate, from rules alone, in one pass over the candidates."""
    annotated = annotate(candidates, payments, *SHOWN_FIELDS)
    return annotated.select(*verdict_columns())

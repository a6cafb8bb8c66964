"""Remove candidates a fixed rule proves innocent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrecheck.functions.money import amounts_text
from payrecheck.functions.text import normalise_status, strip, text_or_empty
from payrecheck.operators.blocking import block
from payrecheck.operators.lookup import attach_pair
from payrecheck.operators.once import compute_once
from payrecheck.schema import (
    CANCELLED_STATUSES,
    DETERMINISTIC,
    EVIDENCE,
    VERDICT_FIELDS,
    Capabilities,
)

RULE_FIELDS = (
    "vendor_id",
    "vendor_canonical",
    "vendor_name_raw",
    "invoice_canonical",
    "invoice_number_raw",
    "amount",
    "payment_date",
    "payment_method",
    "payment_status",
    "po_number",
    "line_count",
    "distinct_line_amounts",
)

# Found once for a payment instead of once for each of its pairs.
CANCELLED = "is_cancelled"

_REASONS = {
    "none": "The candidate names one transaction twice, so there is no pair.",
    "cancelled": "The status of at least one payment is cancelled or reversed.",
    "line_split": (
        "Line counts and line amounts show distribution lines of one invoice, "
        "not two payments."
    ),
}


def evidence(*items: tuple[str, list[Column]]) -> Column:
    """``array<struct<field, values>>`` from named lists of text columns."""
    return F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.array(*values).alias("values"))
            for name, values in items
        ]
    ).cast(EVIDENCE)


def is_cancelled(status: Column) -> Column:
    known = normalise_status(status).isin(*CANCELLED_STATUSES)
    return F.coalesce(known, F.lit(False))


def with_rule_facts(payments: DataFrame) -> DataFrame:
    """``payments`` with what a rule needs to know of one payment alone."""
    return payments.withColumn(CANCELLED, is_cancelled(F.col("payment_status")))


def rule_candidates(
    payments: DataFrame,
    capabilities: Capabilities = Capabilities(),
    cap: int | None = None,
    fields: tuple[str, ...] = (),
) -> DataFrame:
    """``block`` whose candidates carry what the rules read, and ``fields``, of both payments.

    Rules then need no join, whatever the number of candidates.
    """
    carry = (*RULE_FIELDS, CANCELLED, *fields)
    return block(with_rule_facts(payments), capabilities, cap, carry=carry)


def _both(field: str) -> Column:
    return F.col(f"l.{field}").isNotNull() & F.col(f"r.{field}").isNotNull()


def _equal(field: str) -> Column:
    return F.col(f"l.{field}") == F.col(f"r.{field}")


def _same_text(field: str) -> Column:
    left, right = strip(F.col(f"l.{field}")), strip(F.col(f"r.{field}"))
    return (left != "") & (left == right)


def _conflict(field: str) -> Column:
    """Both sides have a value and the values differ."""
    return F.coalesce(~_equal(field), F.lit(False))


def same_invoice() -> Column:
    by_key = (F.col("l.invoice_canonical") != "") & _equal("invoice_canonical")
    return (
        F.when(_both("invoice_canonical"), by_key)
        .when(_both("invoice_number_raw"), _same_text("invoice_number_raw"))
        .otherwise(F.lit(False))
    )


def same_vendor() -> Column:
    return (
        F.when(_both("vendor_id"), _equal("vendor_id"))
        .when(_both("vendor_canonical"), _equal("vendor_canonical"))
        .otherwise(F.coalesce(_same_text("vendor_name_raw"), F.lit(False)))
    )


def is_line_split() -> Column:
    """All proofs together: one invoice of one vendor, paid in distribution lines."""
    amounts = [F.sort_array(f"{s}.distinct_line_amounts") for s in ("l", "r")]
    proofs = (
        (F.col("l.transaction_id") != F.col("r.transaction_id"))
        & same_invoice()
        & same_vendor()
        & (F.col("l.amount") != F.col("r.amount"))
        & (F.col("l.line_count") >= 2)
        & (F.col("r.line_count") >= 2)
        & (F.size(amounts[0]) > 0)
        & (F.size(amounts[1]) > 0)
        & (amounts[0] != amounts[1])
        & _equal("payment_date")
        & ~_conflict("payment_method")
        & ~_conflict("po_number")
    )
    return F.coalesce(proofs, F.lit(False))


def explain_pairs(attached: DataFrame) -> DataFrame:
    """Add ``explanation_type``: the first rule that fires, else null.

    The order matters: one id twice needs no rows; a missing row stops the other
    rules; a cancelled payment wins over a line split.
    """
    missing = F.col("l").isNull() | F.col("r").isNull()
    cancelled = F.col(f"l.{CANCELLED}") | F.col(f"r.{CANCELLED}")
    rule = (
        F.when(
            (F.col("left_id") != "") & (F.col("left_id") == F.col("right_id")),
            F.lit("none"),
        )
        .when(missing, F.lit(None))
        .when(cancelled, F.lit("cancelled"))
        .when(is_line_split(), F.lit("line_split"))
    )
    return compute_once(attached, {"explanation_type": rule})


def annotate(candidates: DataFrame, payments: DataFrame, *extra: str) -> DataFrame:
    """Candidates with both rows attached and the dismissing rule, if any."""
    fields = (*RULE_FIELDS, CANCELLED, *extra)
    return explain_pairs(attach_pair(candidates, with_rule_facts(payments), fields))


def dismissal_fields() -> dict[str, Column]:
    """The verdict columns of an annotated candidate that a rule dismissed."""
    rule = F.col("explanation_type")

    def both(field: str, render=text_or_empty) -> list[Column]:
        return [render(F.col(f"{side}.{field}")) for side in ("l", "r")]

    proof = (
        F.when(
            rule == "cancelled", evidence(("payment_status", both("payment_status")))
        )
        .when(
            rule == "line_split",
            evidence(
                ("line_count", both("line_count", lambda c: c.cast("string"))),
                ("distinct_line_amounts", both("distinct_line_amounts", amounts_text)),
            ),
        )
        .otherwise(
            evidence(("transaction_id", [F.col("left_id"), F.col("right_id")]))
        )
    )
    zero = F.lit(0).cast("long")
    return {
        "candidate_id": F.col("candidate_id"),
        "verdict": F.lit("dismiss"),
        "explanation_type": rule,
        "reasoning": F.coalesce(*[F.when(rule == k, F.lit(v)) for k, v in _REASONS.items()]),
        "evidence": proof,
        "confidence": F.lit(1.0),
        "model_used": F.lit(DETERMINISTIC),
        "tokens_in": zero,
        "tokens_out": zero,
        "cache_read": zero,
    }


def dismissal_verdicts(annotated: DataFrame) -> DataFrame:
    """A verdict for each candidate a rule dismissed."""
    fields = dismissal_fields()
    return annotated.filter("explanation_type IS NOT NULL").select(
        *[fields[f].alias(f) for f in VERDICT_FIELDS]
    )


def dismiss(
    candidates: DataFrame, payments: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(residual candidates, dismissal verdicts)``."""
    annotated = annotate(candidates, payments)
    own = [c for c in candidates.columns if c not in ("l", "r")]
    residual = annotated.filter("explanation_type IS NULL").select(*own)
    return residual, dismissal_verdicts(annotated)


def dismissals_by_explanation(verdicts: DataFrame) -> DataFrame:
    return (
        verdicts.filter(F.col("verdict") == "dismiss")
        .groupBy("explanation_type")
        .agg(F.count(F.lit(1)).alias("dismissed"))
    )

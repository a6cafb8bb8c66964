"""Record layouts and fixed vocabularies shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

_LINE_FIELDS: list[tuple[str, T.DataType]] = [
    ("transaction_id", T.StringType()),
    ("vendor_name_raw", T.StringType()),
    ("vendor_id", T.StringType()),
    ("invoice_number_raw", T.StringType()),
    ("invoice_date", T.DateType()),
    ("payment_date", T.DateType()),
    ("amount", MONEY),
    ("invoice_amount", MONEY),
    ("po_number", T.StringType()),
    ("payment_method", T.StringType()),
    ("payment_status", T.StringType()),
    ("department", T.StringType()),
    ("description", T.StringType()),
]

LEDGER_LINE = T.StructType([T.StructField(n, t) for n, t in _LINE_FIELDS])
LINE_FIELDS: tuple[str, ...] = tuple(n for n, _ in _LINE_FIELDS)
REQUIRED_FIELDS: tuple[str, ...] = ("transaction_id", "vendor_name_raw", "amount")
OPTIONAL_FIELDS: tuple[str, ...] = tuple(
    n for n in LINE_FIELDS if n not in REQUIRED_FIELDS
)

# Payment-grain fields whose value must agree over all lines of a payment.
IDENTITY_FIELDS: tuple[str, ...] = tuple(
    n for n in LINE_FIELDS if n not in ("transaction_id", "amount")
)

TRANSACTION = T.StructType(
    list(LEDGER_LINE.fields)
    + [
        T.StructField("vendor_canonical", T.StringType()),
        T.StructField("invoice_canonical", T.StringType()),
        T.StructField("line_count", T.LongType()),
        T.StructField("distinct_line_amounts", T.ArrayType(MONEY)),
        T.StructField("disagreed_fields", T.ArrayType(T.StringType())),
    ]
)

EVIDENCE = T.ArrayType(
    T.StructType(
        [
            T.StructField("field", T.StringType()),
            T.StructField("values", T.ArrayType(T.StringType())),
        ]
    )
)

CANDIDATE = T.StructType(
    [
        T.StructField("candidate_id", T.StringType()),
        T.StructField("left_id", T.StringType()),
        T.StructField("right_id", T.StringType()),
        T.StructField("signal", T.StringType()),
        T.StructField("amount_at_risk", MONEY),
        T.StructField("stage_generated", T.StringType()),
    ]
)

VERDICT = T.StructType(
    [
        T.StructField("candidate_id", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("explanation_type", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("evidence", EVIDENCE),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("model_used", T.StringType()),
        T.StructField("tokens_in", T.LongType()),
        T.StructField("tokens_out", T.LongType()),
        T.StructField("cache_read", T.LongType()),
    ]
)
VERDICT_FIELDS: tuple[str, ...] = tuple(VERDICT.fieldNames())

DECISION = T.StructType(
    [
        T.StructField("candidate_id", T.StringType()),
        T.StructField("approver", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("becomes_rule", T.BooleanType()),
    ]
)

TRUTH = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("transaction_ids", T.ArrayType(T.StringType())),
        T.StructField("amount", MONEY),
        T.StructField("why", T.StringType()),
    ]
)

RECORDING = T.StructType(
    [
        T.StructField("request_key", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("response_json", T.StringType()),
    ]
)
# As stored: with the request that the key is the hash of.
STORED_RECORDING = T.StructType([*RECORDING.fields, T.StructField("request_json", T.StringType())])

# Names that appear in results.
SIGNALS = (
    "exact_duplicate",
    "fuzzy_vendor",
    "invoice_variant",
    "split_payment",
    "cross_department",
    "overpayment_vs_invoice",
)
OUTCOMES = ("dismiss", "escalate", "errored")
EXPLANATIONS = (
    "cancelled",
    "line_split",
    "progress_payment",
    "recurring",
    "different_po",
    "partial_pair",
    "none",
)
DECISIONS = ("confirmed", "dismissed")
DECOY_REASONS = EXPLANATIONS[:-1]
CANCELLED_STATUSES = (
    "CANCELLED",
    "CANCELED",
    "REVERSED",
    "REVERSAL",
    "VOID",
    "VOIDED",
)
DETERMINISTIC = "deterministic"
BLOCKING_STAGE = "blocking"


@dataclass(frozen=True)
class Capabilities:
    """Which optional fields a source fills; chooses plan branches on the driver."""

    has_invoice_number: bool = True
    has_po_number: bool = True
    has_payment_status: bool = True
    has_vendor_id: bool = True
    has_invoice_amount: bool = True

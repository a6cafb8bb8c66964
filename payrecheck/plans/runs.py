"""Ledger lines in, verdicts out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from payrecheck.functions.text import with_canonical_keys
from payrecheck.operators.adjudication import AdjudicationConfig, adjudicate
from payrecheck.operators.blocking import block
from payrecheck.operators.dismissal import dismiss, rule_candidates
from payrecheck.operators.findings import SHOWN_FIELDS, rules_only_verdicts
from payrecheck.operators.payments import aggregate_payments
from payrecheck.schema import Capabilities
from payrecheck.session import stage


#: Least and greatest texts are combined in sorted order, so a task sorts all lines it has, many
#: times as long in memory as in the narrow exchange that they come from.
TASK_BYTES = "4m"


def payments_from_lines(lines: DataFrame) -> DataFrame:
    """Stages 1-2 as one lazy plan."""
    return with_canonical_keys(aggregate_payments(lines))


def staged_payments(lines: DataFrame) -> DataFrame:
    """Stages 1-2 written once: blocking and both lookups read the result."""
    return stage(payments_from_lines(lines), "payments", TASK_BYTES)


@dataclass(frozen=True)
class Run:
    """The tables of a run, for the views that need more than verdicts.

    Candidates of ``rules_only_run`` carry what rules and verdicts read of both payments.
    """

    lines: DataFrame
    payments: DataFrame
    candidates: DataFrame
    residual: DataFrame
    verdicts: DataFrame


def rules_only(
    lines: DataFrame,
    capabilities: Capabilities = Capabilities(),
    cap: int | None = None,
) -> DataFrame:
    """Stages 1-4, then every residual candidate is escalated."""
    payments = staged_payments(lines)
    candidates = rule_candidates(payments, capabilities, cap, SHOWN_FIELDS)
    return rules_only_verdicts(candidates, payments)


def rules_only_run(
    lines: DataFrame,
    capabilities: Capabilities = Capabilities(),
    cap: int | None = None,
) -> Run:
    """As ``rules_only``, keeping every stage.

    There can be far more candidates than payments: each reader pairs the payments again, which
    takes one exchange of payments, instead of writing all candidates or joining them.
    """
    payments = staged_payments(lines)
    candidates = rule_candidates(payments, capabilities, cap, SHOWN_FIELDS)
    residual, _ = dismiss(candidates, payments)
    verdicts = rules_only_verdicts(candidates, payments)
    return Run(lines, payments, candidates, residual, verdicts)


def full_run(
    lines: DataFrame,
    recordings: DataFrame,
    config: AdjudicationConfig,
    capabilities: Capabilities = Capabilities(),
    cap: int | None = None,
) -> Run:
    """Stages 1-5: dismissals plus recorded answers, one verdict per candidate."""
    payments = staged_payments(lines)
    candidates = stage(block(payments, capabilities, cap), "candidates")
    residual, dismissed = dismiss(candidates, payments)
    judged = adjudicate(residual, payments, recordings, config)
    return Run(lines, payments, candidates, residual, dismissed.unionByName(judged))

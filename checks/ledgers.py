"""Ledgers, recordings, decisions and truth derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payrecheck.operators.adjudication import AdjudicationConfig, request_key
from payrecheck.operators.dismissal import rule_candidates
from payrecheck.operators.review import (
    DEPARTMENT_FACTS,
    PAYMENT_FIELDS,
    rules_only_findings,
    with_department_facts,
)
from payrecheck.plans.runs import staged_payments
from checks.star_schema import ledger_from_orders

CONFIG = AdjudicationConfig(model_fast="fast-model", model_escalate="careful-model")


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    return ledger_from_orders(spark, folder)


def payments_of(spark: SparkSession, folder: str) -> DataFrame:
    return staged_payments(lines_of(spark, folder))


def findings_of(spark: SparkSession, folder: str) -> DataFrame:
    """Rules-only findings of the derived ledger with both payments attached."""
    payments = payments_of(spark, folder)
    fields = (*PAYMENT_FIELDS, *DEPARTMENT_FACTS)
    candidates = rule_candidates(with_department_facts(payments), fields=fields)
    return rules_only_findings(candidates, payments)


def digit(column: str, place: int) -> Column:
    """A digit of the order number inside an id such as ``ORD000012345``."""
    return F.substring(column, place, 1).cast("int")


def recordings_for(requests: DataFrame) -> DataFrame:
    """Recorded answers for requests, by the hundreds digit of the left payment.

    0-2 escalate, 3-4 dismiss with nested evidence, 5-6 unsure (5 also has the
    second model's answer), 7 cut off, 8 malformed, 9 not recorded.
    """
    kind = digit("left_id", 10)
    cid = F.col("candidate_id")

    def answer(verdict: str, why: str, confidence: str, values: str, more: str = "") -> Column:
        head = F.concat(F.lit('{"candidate_id":"'), cid, F.lit('","verdict":"'))
        tail = (
            f'{verdict}","explanation_type":"{why}","reasoning":"recorded",'
            f'"evidence":[{{"field":"po_number","values":{values}}}],"confidence":{confidence}{more}}}'
        )
        return F.concat(head, F.lit(tail))

    def envelope(content: Column, finish: str, usage: str) -> Column:
        message = F.to_json(F.struct(content.alias("content")))
        return F.concat(
            F.lit(f'{{"choices":[{{"finish_reason":"{finish}","message":'),
            message,
            F.lit(f"}}],\"usage\":{usage}}}"),
        )

    usage = '{"prompt_tokens":100,"completion_tokens":20,"prompt_tokens_details":{"cached_tokens":5}}'
    texts = '{"prompt_tokens":"90","completion_tokens":10,"prompt_cache_hit_tokens":7}'
    plain, nested = '["a"]', '["a",["b","c"],null,3]'
    first = (
        F.when(kind <= 2, envelope(answer("escalate", "none", "0.9", plain), "stop", usage))
        .when(kind <= 4, envelope(answer("dismiss", "different_po", "0.8", nested), "stop", texts))
        .when(kind <= 6, envelope(answer("escalate", "none", "0.5", plain), "stop", usage))
        .when(kind == 7, envelope(answer("escalate", "none", "0.9", plain), "length", usage))
        .when(
            kind == 8,
            envelope(answer("escalate", "none", "0.9", plain, ',"extra":1'), "stop", usage),
        )
    )
    second = F.when(
        kind == 5,
        envelope(
            answer("dismiss", "recurring", "0.95", "null"),
            "stop",
            '{"prompt_tokens":50,"completion_tokens":5}',
        ),
    )
    payload = F.col("payload")
    both = F.array(
        *[
            F.struct(
                request_key(payload, model, CONFIG).alias("request_key"),
                F.lit(model).alias("model"),
                response.alias("response_json"),
            )
            for model, response in (
                (CONFIG.model_fast, first),
                (CONFIG.model_escalate, second),
            )
        ]
    )
    return requests.select(F.explode(both).alias("r")).select("r.*").filter(
        "response_json IS NOT NULL"
    )


def decisions_on(candidates: DataFrame) -> DataFrame:
    """Decisions on candidates whose tens digit is 0-3: even hundreds confirm."""
    return candidates.filter(digit("left_id", 11) <= 3).select(
        "candidate_id",
        F.lit("R. Viewer").alias("approver"),
        F.when(digit("left_id", 10) % 2 == 0, "confirmed")
        .otherwise("dismissed")
        .alias("decision"),
        F.lit("checked the file..").alias("reason"),
        (digit("left_id", 10) % 3 == 0).alias("becomes_rule"),
    )


def truth_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled cases: re-entered orders are duplicates, changed ones decoys."""
    key = F.col("o_orderkey")
    num = F.lpad(key.cast("string"), 9, "0")

    def ids(prefix: str) -> Column:
        return F.array(F.concat(F.lit(prefix), num), F.concat(F.lit("ORD"), num))

    reasons = F.array(*[F.lit(r) for r in ("cancelled", "line_split", "recurring")])
    decoy = F.try_element_at(reasons, (F.floor(key / 30) % 3 + 1).cast("int"))
    cases = F.array(
        F.when(
            key % 20 == 0,
            F.struct(
                F.concat(F.lit("dup-"), num).alias("case_id"),
                F.lit("duplicate").alias("kind"),
                F.lit("exact_duplicate").alias("label"),
                ids("DUP").alias("transaction_ids"),
                (key % 1000).cast("decimal(18,2)").alias("amount"),
            ),
        ),
        F.when(
            key % 30 == 0,
            F.struct(
                F.concat(F.lit("decoy-"), num).alias("case_id"),
                F.lit("decoy").alias("kind"),
                decoy.alias("label"),
                ids("SPL").alias("transaction_ids"),
                F.lit(None).cast("decimal(18,2)").alias("amount"),
            ),
        ),
    )
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey")
    return orders.select(F.explode(cases).alias("c")).filter("c IS NOT NULL").select("c.*")


def with_descriptions(payments: DataFrame) -> DataFrame:
    """Payments with a description by order number and kind of entry."""
    number = F.substring("transaction_id", 4, 9).cast("bigint") + F.ascii("transaction_id")
    texts = {
        0: F.concat(F.lit("Progress payment "), (number % 5 + 1).cast("string"), F.lit(" of 5")),
        1: F.lit("Partial payment, balance outstanding"),
        2: F.lit("Cancelled by issuer"),
        3: F.concat(F.lit("GL distribution line "), (number % 2 + 1).cast("string"), F.lit(" of 2")),
    }
    chosen = F.coalesce(*[F.when(number % 6 == k, t) for k, t in texts.items()], F.lit("Services"))
    return payments.withColumn("description", chosen)

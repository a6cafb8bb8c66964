"""Further registered queries: orders, planted cases, stores, whole texts, rare rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from checks import ledgers as L
from checks import queries as Q
from checks import sql as q
from checks.queries import registered
from payrecheck.operators import adjudication as A
from payrecheck.operators import blocking as B
from payrecheck.operators import orders as O
from payrecheck.operators import packets as K
from payrecheck.operators import planting as P
from payrecheck.operators import review as R
from payrecheck.operators import scoring as S
from payrecheck.operators.dismissal import dismiss, rule_candidates
from payrecheck.operators.payments import aggregate_payments
from payrecheck.plans.runs import TASK_BYTES, full_run, rules_only, rules_only_run
from payrecheck.schema import CANDIDATE, DECOY_REASONS, LINE_FIELDS
from payrecheck.session import stage
from payrecheck.sources import ledger_csv as C
from payrecheck.sources import records as Rec
from payrecheck.sources import sinks
from payrecheck.sources.layouts import LOS_ANGELES
from payrecheck.streaming.live import ask_into_store

# --- sources ---------------------------------------------------------------

_SPLIT, _SPLITS = 128 << 10, 2000
# Records of one of the large files; a smaller ledger is one file.
_RECORDS_OF_FILE = 1_000_000


def _divided(spark, path, read):
    """What ``read`` gives, staged while the files of ``path`` are cut into many splits.

    A split has 128 kB; of files with more than 2,000 such splits it grows with their size, or
    starting the tasks would take longer than their work.
    """
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    split = {
        "spark.sql.files.maxPartitionBytes": str(max(_SPLIT, -(-size // _SPLITS))),
        "spark.sql.files.openCostInBytes": "1k",
    }
    was = {k: spark.conf.get(k) for k in split}
    try:
        for k, v in split.items():
            spark.conf.set(k, v)
        return stage(read(), "divided")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def _large_files(spark, d) -> str:
    path = Q._scratch(spark, "one-file")
    # Joined by all tasks first: a file's task only copies its rows.
    cells = stage(Q._as_los_angeles_cells(L.lines_of(spark, d)), "cells")
    C.write_cells(cells.coalesce(max(1, cells.count() // _RECORDS_OF_FILE)), path)
    return path


@registered(Q.ORACLES["ingest_los_angeles"])
def ingest_multiline(spark, d):
    """A large file with a quoted line break in every row, read by many tasks."""
    path = _large_files(spark, d)
    return _divided(spark, path, lambda: C.read_ledger(spark, path, LOS_ANGELES, multiline=True))


@registered(
    q.query(
        q.LEDGER,
        select="SELECT transaction_id, vendor_name_raw, amount, department FROM ledger"
        " ORDER BY transaction_id, amount, payment_method, vendor_name_raw, department LIMIT 500",
    )
)
def ledger_slice(spark, d):
    """The first 500 records of a sorted ledger, cut out whole and read again."""
    path, out = Q._scratch(spark, "sorted"), Q._scratch(spark, "slice")
    lines = L.lines_of(spark, d).orderBy(
        "transaction_id", "amount", "payment_method", "vendor_name_raw", "department"
    )
    # Files follow each other in the order of the rows.
    C.write_cells(Q._as_los_angeles_cells(lines), path)
    written = _divided(spark, path, lambda: Rec.csv_slice(Rec.csv_records(spark, path), 500))
    written.coalesce(1).write.text(out)
    lines = C.read_ledger(spark, out, LOS_ANGELES, multiline=True)
    return lines.select("transaction_id", "vendor_name_raw", "amount", "department")


@registered(
    q.query(
        q.LEDGER,
        select="""
SELECT transaction_id, vendor_name_raw || ' café €' AS vendor_name_raw, amount,
  CASE WHEN CAST(substr(transaction_id, 4) AS BIGINT) % 4 <> 0 THEN invoice_amount END
    AS invoice_amount,
  (SELECT count(*) FROM ledger) AS rows_in FROM ledger""",
    )
)
def ingest_rare_cells(spark, d):
    """Windows bytes, rows that are wholly blank, blank optional money, and the row count."""
    lines = L.lines_of(spark, d)
    number = F.substring("transaction_id", 4, 9).cast("bigint")
    spaced = lines.withColumn(
        "vendor_name_raw", F.concat("vendor_name_raw", F.lit(" café €"))
    ).withColumn("kind", F.explode(F.when(number % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    cells = {
        "id": F.col("transaction_id"),
        "payee": F.col("vendor_name_raw"),
        "paid": F.col("amount").cast("string"),
        "billed": F.when(number % 4 == 0, F.lit("  ")).otherwise(F.col("invoice_amount").cast("string")),
    }
    # Kind 1 is a blank row behind the row itself.
    rows = spaced.select(*[F.when(F.col("kind") == 0, c).otherwise(F.lit(" ")).alias(n) for n, c in cells.items()])
    path = Q._scratch(spark, "rare")
    # Byte 0x80 is the euro sign of Windows; the writer knows Latin-1 only.
    rows = rows.withColumn("payee", F.translate("payee", "€", "\x80"))
    rows.write.option("header", True).option("quoteAll", True).option("encoding", "ISO-8859-1").csv(path)
    layout = Q.LedgerLayout(
        {"transaction_id": "id", "vendor_name_raw": "payee", "amount": "paid", "invoice_amount": "billed"},
        encoding="cp1252",
    )
    read = C.read_cells(spark, path, "cp1252", layout.source_columns)
    n = C.count_rows(read).first().rows_in
    return C.strict_lines(read, layout).select(
        "transaction_id", "vendor_name_raw", "amount", "invoice_amount", F.lit(n).alias("rows_in")
    )


@registered(
    q.query(
        q.LEDGER,
        q.payments(),
        select="SELECT transaction_id, CAST(amount AS VARCHAR) AS amount,"
        " CAST(invoice_amount AS VARCHAR) AS invoice_amount, line_count,"
        " '[' || array_to_string(list_transform(amounts, lambda a: '\"' || a || '\"'), ',') || ']' AS amounts"
        " FROM tx",
    )
)
def payments_json(spark, d):
    """Payments written as JSON lines, money as text and nulls kept, read back as text."""
    path = Q._scratch(spark, "payments-json")
    sinks.write_payments_json(L.payments_of(spark, d), path)
    fields = {"transaction_id": "$.transaction_id", "amount": "$.amount",
              "invoice_amount": "$.invoice_amount", "amounts": "$.distinct_line_amounts"}
    text = [F.get_json_object("value", p).alias(n) for n, p in fields.items()]
    return spark.read.text(path).select(
        *text, F.get_json_object("value", "$.line_count").cast("bigint").alias("line_count")
    )


@registered(
    q.query(
        q.LEDGER,
        q.payments(),
        """
given AS (SELECT *, CAST(substr(transaction_id, 11, 1) AS INTEGER) AS m FROM tx)""",
        select=f"""
SELECT transaction_id, CASE m WHEN 0 THEN 'bad value of amount' WHEN 1 THEN 'missing or extra keys'
    WHEN 2 THEN 'bad value of invoice_date' END AS failure,
  CASE WHEN m > 2 THEN amount END AS amount, CASE WHEN m > 2 THEN line_count END AS line_count,
  CASE WHEN m > 2 THEN invoice_date END AS invoice_date, CASE WHEN m > 2 THEN vendor_canonical END AS vendor_canonical,
  CASE WHEN m > 2 THEN array_to_string(amounts, ',') END AS amounts
FROM given""",
    )
)
def payments_json_read(spark, d):
    """Payments written as JSON lines, some then broken, read back as exact values."""
    payments = L.payments_of(spark, d)
    whole, broken = Q._scratch(spark, "payments-json"), Q._scratch(spark, "payments-broken")
    sinks.write_payments_json(payments, whole)
    lines = spark.read.text(whole)
    line = F.col("value")
    of = F.substring(F.get_json_object(line, "$.transaction_id"), 11, 1).cast("int")
    unquoted = F.regexp_replace(line, r'"amount":"([0-9.]+)"', r'"amount":$1')
    other = F.regexp_replace(line, r'"invoice_date":"[0-9-]+"', '"invoice_date":"2024-02-30"')
    extra = F.regexp_replace(line, r"^\{", '{"more":1,')
    changed = F.when(of == 0, unquoted).when(of == 1, extra).when(of == 2, other).otherwise(line)
    lines.select(changed.alias("value")).write.text(broken)
    read, rejects = sinks.read_payments_json(spark, broken)
    shown = ("amount", "line_count", "invoice_date", "vendor_canonical")
    good = read.select(
        "transaction_id", F.lit(None).cast("string").alias("failure"), *shown,
        F.array_join(F.col("distinct_line_amounts").cast("array<string>"), ",").alias("amounts"),
    )
    bad = rejects.select(F.get_json_object("line", "$.transaction_id").alias("transaction_id"), "failure")
    return good.unionByName(bad, allowMissingColumns=True)


_HOT = "CASE WHEN CAST(substr(transaction_id, 4) AS BIGINT) % 3 = 0 THEN 'HOT' ELSE transaction_id END"
_SPREAD = "CAST(amount + CAST(substr(transaction_id, 4) AS BIGINT) AS DECIMAL(18,2))"


@registered(
    q.query(
        q.LEDGER,
        f"hot AS (SELECT * REPLACE ({_HOT} AS transaction_id, {_SPREAD} AS amount) FROM ledger)",
        q.payments("hot"),
        select="SELECT transaction_id, amount, line_count, len(amounts) AS n_amounts,"
        " sha256(array_to_string(amounts, ',')) AS amounts_sha256, array_to_string(disagreed, ',') AS disagreed FROM tx",
    )
)
def payments_hot_id(spark, d):
    """One id with a third of all lines, most of them with an amount of its own."""
    lines = L.lines_of(spark, d).withColumns(
        {"transaction_id": F.expr(_HOT), "amount": F.expr(_SPREAD)}
    )
    amounts = F.array_join(F.col("distinct_line_amounts").cast("array<string>"), ",")
    payments = stage(aggregate_payments(lines), "payments", TASK_BYTES)
    return payments.select(
        "transaction_id", "amount", "line_count", F.size("distinct_line_amounts").cast("bigint").alias("n_amounts"),
        F.sha2(amounts, 256).alias("amounts_sha256"), F.array_join("disagreed_fields", ",").alias("disagreed"),
    )


# --- orders ----------------------------------------------------------------


@registered(
    q.query(*Q._TX, select="SELECT transaction_id, row_number() OVER (ORDER BY transaction_id) AS rank FROM tx")
)
def payment_order(spark, d):
    return O.ranked_payments(L.payments_of(spark, d)).select("transaction_id", "rank")


@registered(
    q.query(
        *Q._CANDS,
        select="SELECT candidate_id, row_number() OVER (ORDER BY signal, left_id, right_id, candidate_id)"
        " AS rank FROM cand",
    )
)
def candidate_order(spark, d):
    return O.ranked_candidates(B.block(L.payments_of(spark, d))).select("candidate_id", "rank")


@registered(
    q.query(
        *Q._RULED,
        select="SELECT candidate_id, coalesce(rule, 'none') AS explanation_type,"
        " row_number() OVER (ORDER BY candidate_id) AS rank FROM ruled",
    )
)
def verdict_order(spark, d):
    verdicts = rules_only(L.lines_of(spark, d))
    # What is not shown does not cross the exchange of the order.
    return O.ranked_verdicts(verdicts.select("candidate_id", "explanation_type"))


@registered(
    q.query(
        *Q._RULED,
        Q._DECIDED,
        select="SELECT c.candidate_id, row_number() OVER (ORDER BY c.amount_at_risk DESC, c.candidate_id)"
        f" AS rank {Q._PENDING}",
    )
)
def queue_order(spark, d):
    findings = L.findings_of(spark, d)
    decisions = L.decisions_on(Q._open_findings(findings))
    queue = R.review_queue(findings, decisions).select("candidate_id", "amount_at_risk")
    return O.ranked_queue(queue).select("candidate_id", "rank")


# --- planting --------------------------------------------------------------

_TEXTS = ", ".join(f"coalesce(CAST({f} AS VARCHAR), '')" for f in LINE_FIELDS)
_FILLED = " AND ".join(
    f"trim({f}) <> ''"
    for f in ("transaction_id", "vendor_name_raw", "vendor_id", "invoice_number_raw", "department", "po_number")
)


def _share(percent: int) -> str:
    """A share of ``iso`` cents, halves to even."""
    whole, rest = f"((iso * {percent}) // 100)", f"((iso * {percent}) % 100)"
    return f"({whole} + CASE WHEN {rest} > 50 OR ({rest} = 50 AND {whole} % 2 = 1) THEN 1 ELSE 0 END)"


def _first(percent: int) -> str:
    """The first of two unequal positive parts of ``iso`` cents."""
    part = _share(percent)
    uneven = "(CASE WHEN iso // 2 = iso - iso // 2 THEN iso // 2 - 1 ELSE iso // 2 END)"
    return f"(CASE WHEN {part} <= 0 OR iso <= {part} OR {part} * 2 = iso THEN {uneven} ELSE {part} END)"


def _planted_rows() -> str:
    day = "(DATE '2019-03-04' + CAST(n AS INTEGER))"
    name = "trim(vendor_name_raw)"
    other_name = (
        f"CASE WHEN regexp_matches({name}, '(?i) (INC|LLC|CORP)\\.$') THEN left({name}, length({name}) - 1)"
        f" WHEN regexp_matches({name}, '(?i) (INC|LLC|CORP)$') THEN {name} || '.' ELSE {name} || ' INC.' END"
    )
    other_unit = "CASE WHEN trim(department) = (SELECT min(d) FROM units) THEN (SELECT max(d) FROM units) ELSE (SELECT min(d) FROM units) END"
    order = "'EVALPO' || lpad(CAST(n AS VARCHAR), 5, '0')"
    next_order = "'EVALPO' || left(lpad(CAST(n AS VARCHAR), 5, '0'), 4) || CAST((n % 10 + 1) % 10 AS VARCHAR)"
    extra = f"greatest({_share(10)}, 1)"

    def row(cents="iso", invoice="token", paid=day, **more):
        return {"cents": cents, "invoice": invoice, "paid": paid, **more}

    def said(text, **more):
        return row(**more, description=f"'{text}'")

    def halves(percent):
        return _first(percent), f"(iso - {_first(percent)})"

    s40, s30, s25 = halves(40), halves(30), halves(25)
    cases = {
        "exact_duplicate": ([row(), row()], "iso"),
        "fuzzy_vendor_duplicate": ([row(vendor=name), row(vendor=other_name)], "iso"),
        "invoice_format_variant": ([row(), row(invoice="'INV-' || token")], "iso"),
        "split_payment_duplicate": (
            [row(s40[0]), row(s40[1], paid=f"({day} + 1)")], f"least({s40[0]}, {s40[1]})"),
        "cross_department_duplicate": ([row(), row(unit=other_unit)], "iso"),
        "overpayment_vs_invoice": ([row(), row(extra, paid=f"({day} + 2)")], extra),
        "cancelled": ([said("Billed in full"), said("Payment cancelled before its release")], "iso"),
        "line_split": ([said(f"Cost centre line {i} of 2", cents=s30[i - 1]) for i in (1, 2)], "iso"),
        "progress_payment": (
            [said(f"Draw {k} of 5", invoice=f"token || 'D{k}'", paid=f"({day} + {14 * k})") for k in range(1, 6)],
            "iso"),
        "recurring": (
            [said("Monthly retainer", invoice=f"token || 'M{m}'",
                  paid=f"CAST(DATE '2018-01-15' + INTERVAL {m - 1} MONTH AS DATE)") for m in range(1, 7)],
            "iso"),
        "different_po": ([row(po=order), row(po=next_order)], "iso"),
        "partial_pair": (
            [said("First part, the balance follows", cents=s25[0]),
             said("Second part, pays the balance", cents=s25[1], paid=f"({day} + 30)")],
            "iso"),
    }
    parts = []
    for label, (rows, stake) in cases.items():
        for step, r in enumerate(rows):
            parts.append(
                f"SELECT case_id, kind, label, {stake} AS stake, 'EVAL' || lpad(CAST(first_row + {step} AS VARCHAR), 8, '0')"
                f" AS transaction_id, {r.get('vendor', 'vendor_name_raw')} AS vendor_name_raw, vendor_id,"
                f" {r['invoice']} AS invoice_number_raw, {r['paid']} AS invoice_date, {r['paid']} AS payment_date,"
                f" {r['cents']} AS cents, {r.get('po', 'po_number')} AS po_number,"
                " CASE WHEN trim(coalesce(payment_method, '')) = '' THEN 'EFT' ELSE payment_method END AS payment_method,"
                f" 'PAID' AS payment_status, {r.get('unit', 'department')} AS department,"
                f" {r.get('description', 'description')} AS description FROM based WHERE label = '{label}'"
            )
    return " UNION ALL ".join(parts)


_LISTS = ", ".join(
    f"({k}, '{kind}', '{prefix}', {list(labels)}, {n})"
    for k, (kind, prefix, labels, n) in enumerate(
        [("duplicate", "dup", P.DUPLICATE_TYPES, 40), ("decoy", "decoy", DECOY_REASONS, 60)]
    )
)
_PLANTED = f"""
kinds AS (
  SELECT k, kind, prefix, n, unnest(labels) AS label, generate_subscripts(labels, 1) AS i, len(labels) AS types
  FROM (VALUES {_LISTS}) v(k, kind, prefix, labels, n)),
spread AS (
  SELECT *, unnest(range(1, n // types + CASE WHEN i <= n % types THEN 2 ELSE 1 END)) AS seq FROM kinds),
plan AS (
  SELECT kind, label, prefix || '-' || label || '-' || lpad(CAST(seq AS VARCHAR), 2, '0') AS case_id,
    row_number() OVER (ORDER BY k, i, seq) AS case_index,
    1 + coalesce(sum(CASE label WHEN 'progress_payment' THEN 5 WHEN 'recurring' THEN 6 ELSE 2 END)
      OVER (ORDER BY k, i, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_row
  FROM spread),
drawn AS (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '0', {_TEXTS})), {', '.join(LINE_FIELDS)}) AS case_index
  FROM ledger WHERE upper(trim(payment_status)) = 'PAID' AND amount > 0 AND {_FILLED}),
units AS (
  SELECT DISTINCT trim(department) AS d FROM ledger WHERE trim(department) <> '' ORDER BY 1 LIMIT 2),
based AS (
  SELECT drawn.*, kind, label, case_id, CAST(first_row AS BIGINT) AS first_row, case_index AS n,
    CAST(amount * 100 AS BIGINT) + case_index + 17 AS iso,
    'EVL' || lpad(CAST(case_index AS VARCHAR), 5, '0') AS token
  FROM plan JOIN drawn USING (case_index)),
rows_of_cases AS ({_planted_rows()}),
planted AS (
  SELECT *, CAST(CAST(cents AS DECIMAL(16,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS amount
  FROM rows_of_cases),
cases_of_truth AS (
  SELECT case_id, kind, label, list_sort(list(transaction_id)) AS ids,
    CASE WHEN kind = 'duplicate' THEN CAST(CAST(max(stake) AS DECIMAL(16,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) END AS amount
  FROM planted GROUP BY 1, 2, 3)"""
_PLANTED_FIELDS = (
    "transaction_id, vendor_name_raw, vendor_id, invoice_number_raw, invoice_date, payment_date, amount,"
    " amount AS invoice_amount, po_number, payment_method, payment_status, department, description"
)


@registered(
    q.query(
        q.LEDGER,
        _PLANTED,
        select=f"SELECT {_PLANTED_FIELDS}, row_number() OVER (ORDER BY transaction_id) AS rank FROM planted",
    )
)
def planted_rows(spark, d):
    """Every line of the hundred planted cases, in their order."""
    ledger, _ = P.plant_cases(L.lines_of(spark, d))
    return O.ranked_payments(P.planted_lines(ledger))


_WHY = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P._WHY.items())


@registered(
    q.query(
        q.LEDGER,
        _PLANTED,
        select="SELECT case_id, kind, label, array_to_string(ids, ',') AS ids, amount,"
        f" CASE label {_WHY} END AS why, row_number() OVER (ORDER BY case_id) AS rank FROM cases_of_truth",
    )
)
def planted_truth(spark, d):
    _, truth = P.plant_cases(L.lines_of(spark, d))
    return O.ranked_truth(truth).withColumn("ids", F.array_join("transaction_ids", ",")).drop(
        "transaction_ids"
    )


@registered(
    q.query(
        q.LEDGER,
        _PLANTED,
        f"both_ledgers AS (SELECT * FROM ledger UNION ALL BY NAME SELECT {_PLANTED_FIELDS} FROM planted)",
        select="""
SELECT l.transaction_id, l.vendor_name_raw, l.amount, l.invoice_date, l.description,
  (SELECT string_agg(case_id, ',' ORDER BY case_id) FROM cases_of_truth WHERE list_contains(ids, l.transaction_id))
    AS cases
FROM both_ledgers l""",
    )
)
def labelled_ledger(spark, d):
    """A ledger and its truth, published twice and read back; each line with the case it is of."""
    path = Q._scratch(spark, "labelled")
    ledger, truth = P.plant_cases(L.lines_of(spark, d))
    ledger, truth = stage(ledger, "planted-ledger"), stage(truth, "truth")
    sinks.write_labelled(ledger.limit(5), truth.limit(2), path)
    sinks.write_labelled(ledger, truth, path)
    lines, cases = sinks.read_labelled(spark, path)
    member = cases.select(F.explode("transaction_ids").alias("transaction_id"), "case_id")
    return lines.join(member, "transaction_id", "left").select(
        "transaction_id", "vendor_name_raw", "amount", "invoice_date", "description",
        F.col("case_id").alias("cases"),
    )


Q.ORACLES["planted_cases_score"] = q.query(
    q.LEDGER,
    _PLANTED,
    f"both_ledgers AS (SELECT * FROM ledger UNION ALL BY NAME SELECT {_PLANTED_FIELDS} FROM planted)",
    q.payments("both_ledgers"),
    q.candidates(),
    q.RULED,
    """
flagged AS (
  SELECT left_id, right_id, max(amount_at_risk) AS risk FROM ruled WHERE rule IS NULL GROUP BY 1, 2),
members AS (SELECT case_id, unnest(ids) AS id FROM cases_of_truth),
inside AS (
  SELECT a.case_id, max(f.risk) AS risk FROM flagged f JOIN members a ON a.id = f.left_id
  JOIN members b ON b.id = f.right_id AND a.case_id = b.case_id GROUP BY 1),
scored AS (
  SELECT count(*) FILTER (kind = 'duplicate' AND i.case_id IS NOT NULL) AS tp,
    count(*) FILTER (kind = 'decoy' AND i.case_id IS NOT NULL) AS fp,
    count(*) FILTER (kind = 'duplicate') AS n,
    coalesce(sum(amount) FILTER (kind = 'duplicate' AND i.case_id IS NOT NULL), 0) AS good,
    coalesce(sum(risk) FILTER (kind = 'decoy' AND i.case_id IS NOT NULL), 0) AS bad
  FROM cases_of_truth t LEFT JOIN inside i USING (case_id))""",
    select="""
SELECT tp AS true_positives, fp AS false_positives, n AS true_cases,
  CAST(good AS DECIMAL(28,2)) AS dollars_correct, CAST(bad AS DECIMAL(28,2)) AS dollars_wrong,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS "precision",
  CASE WHEN n = 0 THEN 0.0 ELSE tp::DOUBLE / n END AS recall,
  CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / n) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / n) END AS f1
FROM scored""",
)


@registered(
    q.query(q.LEDGER, select="SELECT DISTINCT trim(department) AS department FROM ledger WHERE trim(department) <> ''")
)
def ledger_departments(spark, d):
    return P.departments_of(L.lines_of(spark, d))


@registered(Q.ORACLES["entity_resolution"])
def entity_resolution_filtered(spark, d):
    """Planted lines and lines without a vendor id do not count."""
    lines = L.lines_of(spark, d)
    number = F.lpad(F.pmod(F.hash("transaction_id"), F.lit(10**8)).cast("string"), 8, "0")
    planted = lines.withColumn("transaction_id", F.concat(F.lit("EVAL"), number)).withColumn(
        "vendor_id", F.lit("other")
    )
    blank = lines.withColumn("vendor_id", F.lit("  "))
    missing = lines.withColumn("vendor_id", F.lit(None).cast("string"))
    score = S.entity_resolution(lines.union(planted).union(blank).union(missing))
    whole = {c: F.col(c).cast("bigint") for c in ("true_pairs", "predicted_pairs", "gold_pairs")}
    return score.withColumns({**whole, **{c: F.round(c, 6) for c in ("precision", "recall", "f1")}})


# --- rules and answers -----------------------------------------------------


@registered(
    q.query(
        *Q._TX,
        """
pairs AS (
  SELECT transaction_id AS l, unnest([transaction_id, 'NONE' || substr(transaction_id, 4), '']) AS r
  FROM tx WHERE transaction_id LIKE 'ORD%' AND CAST(substr(transaction_id, 4) AS BIGINT) % 10 = 0)""",
        select="SELECT 'exact_duplicate:' || l || ':' || r AS candidate_id,"
        " CASE WHEN l = r THEN 'none' END AS explanation_type FROM pairs",
    )
)
def dismissals_of_broken_pairs(spark, d):
    """One id twice is dismissed before all rules; a row that is missing stops them."""
    payments = L.payments_of(spark, d)
    number = F.substring("transaction_id", 4, 9)
    right = F.array(F.col("transaction_id"), F.concat(F.lit("NONE"), number), F.lit(""))
    pairs = (
        payments.filter(F.col("transaction_id").startswith("ORD") & (number.cast("bigint") % 10 == 0))
        .select(F.col("transaction_id").alias("left_id"), F.explode(right).alias("right_id"), "amount")
        .select(
            F.concat_ws(":", F.lit("exact_duplicate"), "left_id", "right_id").alias("candidate_id"),
            "left_id",
            "right_id",
            F.lit("exact_duplicate").alias("signal"),
            F.col("amount").alias("amount_at_risk"),
            F.lit("blocking").alias("stage_generated"),
        )
        .select(*CANDIDATE.fieldNames())
    )
    left, dismissed = dismiss(stage(pairs, "pairs"), payments)
    none = F.lit(None).cast("string").alias("explanation_type")
    return left.select("candidate_id", none).unionByName(
        dismissed.select("candidate_id", "explanation_type")
    )


@registered(
    q.query(
        *Q._RULED,
        Q._JUDGED,
        select="""
SELECT candidate_id, coalesce(a.verdict, 'dismiss') AS verdict,
  coalesce(a.explanation_type, r.rule) AS explanation_type, coalesce(a.confidence, 1.0) AS confidence,
  coalesce(a.model_used, 'deterministic') AS model_used
FROM ruled r LEFT JOIN answered a USING (candidate_id)""",
    )
)
def full_run_verdicts(spark, d):
    """The whole pipeline: one verdict for each candidate, dismissed or judged."""
    lines = L.lines_of(spark, d)
    run = rules_only_run(lines)
    requests = A.build_requests(run.residual, run.payments, L.CONFIG)
    known = stage(
        L.recordings_for(requests.join(run.residual.select("candidate_id", "left_id"), "candidate_id")),
        "recordings",
    )
    return full_run(lines, known, L.CONFIG).verdicts.select(
        "candidate_id", "verdict", "explanation_type", "confidence", "model_used"
    )


@registered(
    q.query(
        *Q._RULED,
        Q._JUDGED,
        select="SELECT count(*) FILTER (model_used = 'careful-model') AS model_escalations FROM answered",
    )
)
def escalated_to_model(spark, d):
    return A.model_escalations(Q._adjudicated(spark, d)[0], L.CONFIG)


@registered(
    q.query(
        *Q._RULED,
        Q._JUDGED,
        """
stored AS (
  SELECT a.*, CAST(substr(r.left_id, 12, 1) AS INTEGER) AS m FROM answered a JOIN ruled r USING (candidate_id)
  WHERE a.k <= 4)""",
        select="""
SELECT candidate_id, CASE WHEN m IN (0, 1) THEN 'errored' ELSE verdict END AS verdict,
  CASE m WHEN 0 THEN 'the recorded request is another than the one its key names' WHEN 1 THEN 'conflict' END AS fault,
  (SELECT count(*) + count(*) FILTER (m = 1) FROM stored) AS recordings
FROM stored""",
    )
)
def recording_store(spark, d):
    """A store that was written twice, with changed requests and conflicting answers."""
    payments = L.payments_of(spark, d)
    left = stage(dismiss(rule_candidates(payments), payments)[0], "residual")
    left = left.filter(L.digit("left_id", 10) <= 4)
    requests = stage(
        A.build_requests(left, payments, L.CONFIG).join(
            left.select("candidate_id", "left_id"), "candidate_id"
        ),
        "requests",
    )
    text = A.request_text(F.col("payload"), L.CONFIG.model_fast, L.CONFIG)
    m = L.digit("left_id", 12)
    texts = requests.select(F.sha2(text, 256).alias("request_key"), text.alias("request_json"), m.alias("m"))
    answers = L.recordings_for(requests).join(texts, "request_key")
    changed = F.when(F.col("m") == 0, F.concat("request_json", F.lit(" "))).otherwise(F.col("request_json"))
    names = ["request_key", "model", "response_json", "request_json"]
    rows = answers.withColumn("request_json", changed).select(*names, "m")
    second = rows.filter("m = 1").withColumn("response_json", F.concat("response_json", F.lit(" ")))
    path = Q._scratch(spark, "store")
    for part in (rows, second, rows.unionByName(second)):
        sinks.append_recordings(part.select(*names), path)
    store = sinks.read_recordings(spark, path)
    n = store.count()
    judged = A.adjudicate_requests(requests.drop("left_id"), store, L.CONFIG)
    fault = F.when(F.col("reasoning").contains("differ"), "conflict").when(
        F.col("reasoning").startswith("the recorded request"), F.col("reasoning")
    )
    return judged.select(
        "candidate_id", "verdict", fault.alias("fault"), F.lit(n).alias("recordings")
    )


_NOTE = 'São "P"\n𝄞 '
_EXACT = ("amount", "invoice_amount", "invoice_date", "payment_date")


def _member(field: str) -> str:
    if field == "distinct_line_amounts":
        value = """'["' || array_to_string(amounts, '","') || '"]'"""
    elif field == "line_count":
        value = "CAST(line_count AS VARCHAR)"
    elif field in _EXACT:
        value = f"""coalesce('"' || CAST({field} AS VARCHAR) || '"', 'null')"""
    else:
        value = f"coalesce(CAST(to_json({field}) AS VARCHAR), 'null')"
    return f"""'"{field}":' || {value}"""


_RECORD = "'{' || " + " || ',' || ".join(_member(f) for f in A.RECORD_FIELDS) + " || '}'"
_REQUESTS = f"""
records AS MATERIALIZED (SELECT transaction_id, vk, ik, {_RECORD} AS record FROM tx),
open_pairs AS (SELECT * FROM ruled WHERE rule IS NULL),
near AS (
  SELECT candidate_id, t.transaction_id, t.record,
         row_number() OVER (PARTITION BY candidate_id ORDER BY t.transaction_id) - 1 AS place,
         count(*) OVER (PARTITION BY candidate_id) AS "of"
  FROM open_pairs c JOIN records l ON c.left_id = l.transaction_id
  JOIN records t ON t.vk = l.vk AND t.ik = l.ik AND t.transaction_id NOT IN (c.left_id, c.right_id))"""


def _near(spark, d):
    """Open candidates, the other payments of the left one's bill, and the payments."""
    payments = L.payments_of(spark, d)
    left = stage(dismiss(rule_candidates(payments), payments)[0], "residual")
    vendor = F.coalesce("vendor_canonical", F.expr("nullif(trim(vendor_name_raw), '')")).alias("vk")
    bill = F.coalesce("invoice_canonical", F.expr("nullif(trim(invoice_number_raw), '')")).alias("ik")
    keys = payments.select("transaction_id", vendor, bill)
    of_left = left.join(keys.withColumnRenamed("transaction_id", "left_id"), "left_id")
    near = of_left.join(keys, ["vk", "ik"]).filter("transaction_id NOT IN (left_id, right_id)")
    return left, near.select("candidate_id", "transaction_id"), payments


@registered(
    q.query(
        *Q._RULED,
        _REQUESTS,
        select='SELECT candidate_id, transaction_id, place, "of", sha256(record) AS record_sha256 FROM near',
    )
)
def related_records(spark, d):
    """One row per payment related to an open candidate, in order, with its canonical text."""
    _, near, payments = _near(spark, d)
    rows = A.related_rows(near.unionByName(near), payments)
    return rows.select(
        "candidate_id", "transaction_id", "place", "of", F.sha2("record", 256).alias("record_sha256")
    )


_HEAD = json.dumps({"content": L.CONFIG.instructions, "role": "system"}, separators=(",", ":"))
_NOTED = f"""CASE WHEN CAST(substr(left_id, 12, 1) AS INTEGER) < 5
    THEN '"context":{json.dumps(_NOTE)[:-1]}' || left_id || '",' ELSE '' END"""


@registered(
    q.query(
        *Q._RULED,
        _REQUESTS,
        f"""
lists AS (
  SELECT candidate_id, max("of") AS n, string_agg(record, ',' ORDER BY place) FILTER (place < 2) AS related
  FROM near GROUP BY candidate_id),
payloads AS (
  SELECT c.candidate_id, coalesce(n, 0) AS n_related,
    '{{"candidate":{{"amount_at_risk":"' || CAST(amount_at_risk AS VARCHAR) || '","candidate_id":"'
    || c.candidate_id || '","signal":"' || signal || '","stage_generated":"blocking","transaction_ids":["'
    || left_id || '","' || right_id || '"]}},' || {_NOTED}
    || '"related":[' || coalesce(related, '') || '],"transactions":[' || l.record || ',' || r.record || ']}}' AS payload
  FROM open_pairs c JOIN records l ON left_id = l.transaction_id JOIN records r ON right_id = r.transaction_id
  LEFT JOIN lists g ON g.candidate_id = c.candidate_id)""",
        select=f"""
SELECT candidate_id, n_related, TRUE AS complete, sha256(payload) AS payload_sha256,
  sha256('{{"messages":[{_HEAD},{{"content":"'
    || replace(replace(payload, chr(92), chr(92) || chr(92)), '"', chr(92) || '"')
    || '","role":"user"}}],"model":"fast-model","response_format":{{"type":"json_object"}}}}') AS request_key
FROM payloads""",
    )
)
def request_keys(spark, d):
    """Whole requests with related payments and context, and the hashes that find answers."""
    left, near, payments = _near(spark, d)
    noted = left.filter(L.digit("left_id", 12) < 5)
    context = noted.select(
        "candidate_id", F.concat(F.lit(_NOTE), F.col("left_id")).alias("context")
    )
    requests = A.build_requests(left, payments, L.CONFIG, near, context, related_limit=2)
    return requests.select(
        "candidate_id",
        "n_related",
        "complete",
        F.sha2("payload", 256).alias("payload_sha256"),
        A.request_key(F.col("payload"), L.CONFIG.model_fast, L.CONFIG).alias("request_key"),
    )


@registered(
    q.query(
        *Q._RULED,
        Q._JUDGED,
        select="""
SELECT candidate_id, CASE WHEN k = 9 THEN 'escalate' ELSE verdict END AS verdict,
  CASE WHEN k = 9 THEN 0.8 ELSE confidence END AS confidence,
  (SELECT count(*) FROM answered WHERE k = 9) AS asked, CAST(0 AS BIGINT) AS asked_again
FROM answered""",
    )
)
def live_answers(spark, d):
    """What has no recorded answer is asked, kept in the store and judged with the rest."""
    payments = L.payments_of(spark, d)
    left = stage(dismiss(rule_candidates(payments), payments)[0], "residual")
    requests = stage(A.build_requests(left, payments, L.CONFIG), "requests")
    store = Q._scratch(spark, "live-store")
    known = L.recordings_for(requests.join(left.select("candidate_id", "left_id"), "candidate_id"))
    sinks.append_recordings(known, store)

    def ask(texts):
        def answer(text):
            payload = json.loads(json.loads(text)["messages"][1]["content"])
            content = {
                "candidate_id": payload["candidate"]["candidate_id"], "verdict": "escalate",
                "explanation_type": "none", "reasoning": "asked", "evidence": [], "confidence": 0.8,
            }
            message = {"content": json.dumps(content)}
            return json.dumps({"choices": [{"finish_reason": "stop", "message": message}]})

        return texts.map(answer)

    asked, again = (
        ask_into_store(requests, store, L.CONFIG.model_fast, L.CONFIG, ask) for _ in range(2)
    )
    judged = A.adjudicate_requests(requests, sinks.read_recordings(spark, store), L.CONFIG)
    return judged.select(
        "candidate_id", "verdict", "confidence",
        F.lit(asked).alias("asked"), F.lit(again).alias("asked_again"),
    )


# --- review and packets ----------------------------------------------------

_PERSON = "(CAST(substr(c.left_id, 12, 1) AS INTEGER) % 3 = 0)"
_MASKED = "'Individual · M. S.'"
_VENDORS = (
    f"CASE WHEN {_PERSON} THEN {_MASKED} WHEN l.vendor_name_raw = r.vendor_name_raw THEN l.vendor_name_raw"
    " ELSE l.vendor_name_raw || ' / ' || r.vendor_name_raw END"
)
_STAKE = q.money_label("c.amount_at_risk")


def _with_people(findings):
    """Findings whose payments of every third pair go to a person."""
    person = L.digit("left_id", 12) % 3 == 0
    for side in ("l", "r"):
        named = F.col(side).withField("vendor_name_raw", F.lit("Mary Smith")).withField(
            "vendor_canonical", F.lit(None).cast("string")
        )
        findings = findings.withColumn(side, F.when(person, named).otherwise(F.col(side)))
    told = F.concat(F.lit("MARY SMITH and a | sign: "), F.col("verdict.reasoning"))
    return findings.withColumn(
        "verdict",
        F.when(person, F.col("verdict").withField("reasoning", told)).otherwise(F.col("verdict")),
    )


_REASON = (
    "'No fixed rule (cancelled, same transaction, line split) explains the pair; rules cannot weigh it"
    " further, so it is reported.'"
)
_TOLD = f"CASE WHEN {_PERSON} THEN {_MASKED} || ' and a | sign: ' ELSE '' END || {_REASON}"


def _line(side: str) -> str:
    return (
        f"'- ' || {Q._REF.format(side)} || ', dated ' || strftime({side}.payment_date, '%B %-d, %Y')"
        f" || ', amount ' || {q.money_label(side + '.amount')}"
    )


_NL = "chr(10)"
_BOTH = f"{_line('l')} || {_NL} || {_line('r')}"
_STAMP = "'2024-06-01 12:00:00 UTC'"
_AUDIT_ROWS = {
    "aggregate": "'Distribution lines were summed per payment for ' || c.left_id || ' and ' || c.right_id || '.'",
    "normalize": f"'Vendor key ' || CASE WHEN {_PERSON} THEN {_MASKED} ELSE l.vendor_canonical END"
    " || '; invoice key ' || l.invoice_canonical || '.'",
    "blocking": f"'Candidate ' || c.candidate_id || ' raised by blocking on signal ' || c.signal || ', amount at risk ' || {_STAKE} || '.'",
    "dismiss": "'No deterministic rule dismissed the pair; it stayed for adjudication.'",
    "adjudicate": f"'Verdict escalate (none), confidence not given. ' || replace({_TOLD}, '|', chr(92) || '|')",
    "review": "'Confirmed by R. Viewer. Reason: checked the file. Becomes rule: '"
    " || CASE WHEN d.becomes_rule THEN 'yes' ELSE 'no' END || '.'",
}
_AUDIT = f" || {_NL} || ".join(
    f"'| ' || {_STAMP} || ' | {stage_} | ' || {text} || ' |'" for stage_, text in _AUDIT_ROWS.items()
)
_CONFIRMED = (
    "FROM ruled c JOIN decided d ON c.candidate_id = d.candidate_id AND d.decision = 'confirmed'"
    " JOIN tx l ON c.left_id = l.transaction_id JOIN tx r ON c.right_id = r.transaction_id"
)


@registered(
    q.query(
        *Q._RULED,
        Q._DECIDED,
        select=f"""
SELECT c.candidate_id AS packet_id,
  'Subject: Please review payments ' || {Q._REF.format('l')} || ' and ' || {Q._REF.format('r')} || {_NL} || {_NL}
    || 'June 1, 2024' || {_NL} || {_NL} || 'To: ' || {_VENDORS} || {_NL} || {_NL}
    || 'Two payments in our ledger may settle the same obligation:' || {_NL} || {_NL} || {_BOTH} || {_NL} || {_NL}
    || 'This is a question, not a claim. If both were due, a short note closes it; if one was made in error, please confirm it so that '
    || {_STAKE} || ' can be recovered.' || {_NL} || {_NL} || 'Reference: ' || c.candidate_id || {_NL} || {_NL}
    || 'Accounts Payable' AS letter,
  '# Journal entry' || {_NL} || {_NL} || 'Packet: ' || c.candidate_id || {_NL} || 'Date: June 1, 2024' || {_NL}
    || 'Signal: ' || replace(c.signal, '_', ' ') || {_NL} || {_NL} || '| Side | Account | Amount |' || {_NL}
    || '| --- | --- | --- |' || {_NL} || '| Debit | Due from supplier — ' || {_VENDORS} || ' | ' || {_STAKE} || ' |' || {_NL}
    || '| Credit | Expenditure recovery | ' || {_STAKE} || ' |' || {_NL} || {_NL} || 'Source payments:' || {_NL} || {_NL}
    || {_BOTH} AS journal,
  '# Audit trail' || {_NL} || {_NL} || 'Finding ' || c.candidate_id || ', packet issued ' || {_STAMP} || '.' || {_NL} || {_NL}
    || '| When | Stage | Conclusion |' || {_NL} || '| --- | --- | --- |' || {_NL} || {_AUDIT} || {_NL} || {_NL}
    || 'Trail ends at R. Viewer, who confirmed this finding.' AS audit_trail
{_CONFIRMED}""",
    )
)
def whole_packets(spark, d):
    """All three texts of each packet, some of them about persons."""
    findings = stage(L.findings_of(spark, d), "findings")
    issued = F.to_timestamp(F.lit("2024-06-01 12:00:00"))
    decisions = L.decisions_on(Q._open_findings(findings))
    return K.build_packets(_with_people(findings), decisions, issued)


@registered(
    q.query(
        *Q._RULED,
        select=f"""
SELECT c.candidate_id, c.amount_at_risk, c.signal, {q.approver('l.department')} AS approver,
  {q.title('l.department')} AS department, l.transaction_id AS left_id, r.transaction_id AS right_id,
  CASE WHEN {_PERSON} THEN {_MASKED} ELSE l.vendor_name_raw END AS left_vendor,
  CASE WHEN {_PERSON} THEN {_MASKED} ELSE r.vendor_name_raw END AS right_vendor,
  {_TOLD} AS reasoning, 'escalate' AS verdict
{Q._PAIRED} WHERE c.rule IS NULL""",
    )
)
def finding_views(spark, d):
    """Open findings in full, persons masked in names and in the reasoning."""
    findings = Q._open_findings(L.findings_of(spark, d))
    return R.finding_view(_with_people(findings)).select(
        "candidate_id",
        "amount_at_risk",
        "signal",
        "approver",
        "department",
        F.col("left.transaction_id").alias("left_id"),
        F.col("right.transaction_id").alias("right_id"),
        F.col("left.vendor_name_raw").alias("left_vendor"),
        F.col("right.vendor_name_raw").alias("right_vendor"),
        "reasoning",
        "verdict",
    )

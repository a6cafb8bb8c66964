"""Blocking against a brute-force reading of the same definition."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal
from itertools import combinations

import pytest

from payrecheck.operators import blocking
from payrecheck.operators.blocking import block, blocking_stats, key_groups, uncompared
from payrecheck.schema import Capabilities


def brute_force(rows, caps, cap):
    """Candidates as ``{(signal, left, right): risk}`` and (max bucket, pairs)."""

    def clean(v):
        return (v or "").strip() or None

    def key(row, parts):
        values = {
            "v": clean(row.vendor_canonical or row.vendor_name_raw),
            "i": clean(row.invoice_canonical) or clean(row.invoice_number_raw),
            "d": row.invoice_date and row.invoice_date.isoformat(),
            "a": row.amount,
        }
        got = tuple(values[p] for p in parts)
        return None if None in got else got

    def differs(parts):
        return lambda x, y: key(x, parts) != key(y, parts)

    def excess(x, y):
        known = [r.invoice_amount for r in (x, y) if r.invoice_amount is not None]
        over = x.amount + y.amount - min(known) if known else Decimal(0)
        return over if over > 0 else None

    def least(x, y):
        return min(x.amount, y.amount)

    always = lambda x, y: True
    bill = "i" if caps.has_invoice_number else "d"
    specs = [("fuzzy_vendor", bill + "a", differs("v"), least)]
    specs += [("split_payment", "v" + bill, always, least)]
    specs += [("cross_department", "v" + bill + "a", lambda x, y: x.department != y.department, least)]
    if caps.has_invoice_number:
        specs += [("exact_duplicate", "via", always, least), ("invoice_variant", "va", differs("i"), least)]
    if caps.has_invoice_amount:
        specs += [("overpayment_vs_invoice", "v" + bill, lambda x, y: excess(x, y) is not None, excess)]
    found, largest, compared = {}, 0, 0
    for name, parts, accept, risk in specs:
        groups = defaultdict(list)
        for row in rows:
            if key(row, parts) is not None:
                groups[key(row, parts)].append(row)
        for members in groups.values():
            buckets = [members]
            if len(members) > cap:
                days = defaultdict(list)
                for row in members:
                    days[row.invoice_date and row.invoice_date.isoformat() or ""].append(row)
                buckets = []
                for group in days.values():
                    group.sort(key=lambda r: r.transaction_id)
                    step = cap if len(group) > cap else len(group)
                    buckets += [group[i : i + step] for i in range(0, len(group), step)]
            for bucket in buckets:
                largest = max(largest, len(bucket))
                compared += len(bucket) * (len(bucket) - 1) // 2
                for x, y in combinations(sorted(bucket, key=lambda r: r.transaction_id), 2):
                    if accept(x, y):
                        found[(name, x.transaction_id, y.transaction_id)] = risk(x, y)
    return found, largest, compared


def random_rows(seed, n, hot=0.34):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot_row = rng.random() < hot
        rows.append(
            {
                "tid": f"T{rng.randrange(10**6):06d}-{i}",
                "vendor_name_raw": "Hot Inc" if hot_row else rng.choice(["Ab Inc", "AB", "Cd LLC", " ", "Ef"]),
                "invoice_number_raw": "INV-1" if hot_row else rng.choice(["1", "INV-2", "02", None, "x3"]),
                "invoice_date": dt.date(2024, 1, 1)
                if hot_row
                else rng.choice([None, dt.date(2024, 1, 1), dt.date(2024, 1, 2)]),
                "amount": "10.00" if hot_row else rng.choice(["10.00", "20.50", "-3.00"]),
                "invoice_amount": rng.choice([None, "15.00", "100.00"]),
                "department": rng.choice([None, "FIRE", "POLICE"]),
            }
        )
    return rows


def found(df):
    rows = df.collect()
    got = {(r.signal, r.left_id, r.right_id): r.amount_at_risk for r in rows}
    assert len(got) == len(rows), "a candidate came out twice"
    assert all(r.candidate_id == f"{r.signal}:{r.left_id}:{r.right_id}" for r in rows)
    return got


@pytest.mark.parametrize(
    "cap, invoices, partitions", [(200, True, 7), (3, True, 7), (3, False, 1), (1, True, 3)]
)
def test_matches_brute_force(spark, make_payments, cap, invoices, partitions):
    caps = Capabilities(has_invoice_number=invoices, has_invoice_amount=invoices)
    payments = make_payments(random_rows(cap, 120)).cache()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        want, largest, compared = brute_force(payments.collect(), caps, cap)
        assert found(block(payments.repartition(5), caps, cap)) == want
        stats = blocking_stats(payments, caps, cap).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert (stats.rows_in, stats.max_bucket, stats.pair_comparisons) == (120, largest, compared)


def test_heavy_keys_and_keys_joined_by_shuffle(monkeypatch, make_payments):
    # Half of the keys are heavy under this share, half are joined by shuffle.
    monkeypatch.setattr(blocking, "HEAVY_SHARE", 0.05)
    payments = make_payments(random_rows(5, 120)).cache()
    want, _, _ = brute_force(payments.collect(), Capabilities(), 3)
    assert found(block(payments, cap=3)) == want


def test_one_hot_key_is_chunked_by_id(spark, make_payments):
    rows = [{"tid": f"T{i:04d}"} for i in range(500)]
    random.Random(1).shuffle(rows)
    got = found(block(make_payments(rows), cap=20))
    exact = [k for k in got if k[0] == "exact_duplicate"]
    assert len(exact) == 25 * 190
    degree = defaultdict(int)
    for _, left, right in exact:
        assert int(left[1:]) // 20 == int(right[1:]) // 20
        degree[left] += 1
        degree[right] += 1
    assert max(degree.values()) == 19


@pytest.mark.parametrize("tile", [7, 50, 1000])
def test_without_a_cap_every_pair_of_a_key_is_compared(monkeypatch, make_payments, tile):
    monkeypatch.setattr(blocking, "TILE", tile)
    payments = make_payments(random_rows(3, 120)).cache()
    want, largest, compared = brute_force(payments.collect(), Capabilities(), 10**6)
    assert found(block(payments)) == want
    stats = blocking_stats(payments).first()
    assert (stats.max_bucket, stats.pair_comparisons) == (largest, compared)
    assert uncompared(payments, 10**6).count() == 0


def test_no_group_holds_a_hot_key(spark, make_payments):
    """300 payments of one key: pairs are complete, and groups stay near two slices."""
    payments = make_payments([{"tid": f"T{i:04d}"} for i in range(300)])
    keys = blocking.explode_keys(payments, blocking.default_signals(Capabilities()))
    exact = keys.filter("family = 'exact'") if "exact" in {
        r.family for r in keys.select("family").distinct().collect()
    } else keys
    spark_tile, blocking.TILE = blocking.TILE, 30
    try:
        _, large = blocking._divided(exact, 30)
        sizes = blocking._tiles(large).groupBy("family", "key", "chunk").count().collect()
        got = found(block(payments))
    finally:
        blocking.TILE = spark_tile
    assert max(r["count"] for r in sizes) < 120
    assert len([k for k in got if k[0] == "exact_duplicate"]) == 300 * 299 // 2


def test_uncompared_tells_what_a_cap_left_out(make_payments):
    payments = make_payments([{"tid": f"T{i:04d}"} for i in range(50)])
    per_key = {r.pairs_not_compared for r in uncompared(payments, 20).collect()}
    # Runs of 20, 20 and 10 are compared within.
    assert per_key == {50 * 49 // 2 - 2 * 190 - 45}
    full, capped = found(block(payments)), found(block(payments, cap=20))
    assert len(full) > len(capped) and set(capped) <= set(full)
    members = key_groups(payments).groupBy("family", "key").count().collect()
    assert {r["count"] for r in members} == {50}


def test_hot_key_is_split_by_date_first(make_payments):
    rows = [
        {"tid": f"T{i:04d}", "invoice_date": dt.date(2024, 1, 1 + i % 2)} for i in range(250)
    ]
    got = found(block(make_payments(rows), cap=200))
    assert len([k for k in got if k[0] == "exact_duplicate"]) == 2 * 7750


def test_equal_hashes_do_not_mix_keys(monkeypatch, make_payments):
    from pyspark.sql import functions as F

    from payrecheck.operators import signals

    payments = make_payments(random_rows(9, 60)).cache()
    want, _, _ = brute_force(payments.collect(), Capabilities(), 3)
    plain = signals.explode_keys

    def colliding(p, s):
        return plain(p, s).withColumn("key_hash", F.lit(1).cast("bigint"))

    monkeypatch.setattr(blocking, "explode_keys", colliding)
    assert found(block(payments, cap=3)) == want


def test_cap_must_be_positive_and_empty_input_is_fine(make_payments):
    with pytest.raises(ValueError):
        block(make_payments([{"tid": "a"}]), cap=0)
    assert found(block(make_payments([{"tid": "a"}]).limit(0))) == {}


def test_overpayment_needs_a_known_invoice(make_payments):
    rows = [
        {"tid": "a", "amount": "40.00", "invoice_amount": "50.00"},
        {"tid": "b", "amount": "30.00", "invoice_amount": None},
    ]
    got = found(block(make_payments(rows)))
    assert got[("overpayment_vs_invoice", "a", "b")] == Decimal("20.00")


def test_hot_rows_are_spread_over_slices(spark, make_payments):
    """No window may hold a whole hot key: the plan partitions by slice."""
    rows = [{"tid": f"T{i:04d}"} for i in range(300)]
    plan = block(make_payments(rows), cap=10)._jdf.queryExecution().toString()
    assert "slice" in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan

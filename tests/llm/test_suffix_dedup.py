"""Removed bytes against a dictionary of all windows, and the suffix order against sorting."""

import random

import numpy as np

from payrecheck.llm.suffix_dedup import RepeatRule, remove_repeats, repeated_starts


def brute(texts, length):
    met = {}
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            met.setdefault(t[p : p + length], []).append((d, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in met.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p : p + length] = True
    return gone


def corpus(seed, length):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    hot, other = text(length * 2), text(length - 3)
    out = ["", None, "short", "a" * (length * 4), "ab" * (length * 2), "a" * (length + 1), text(length)]
    for _ in range(30):
        t = text(rng.randint(0, length * 4))
        if rng.random() < 0.5:
            p = rng.randint(0, len(t))
            t = t[:p] + rng.choice([hot, other, hot[5:]]) + t[p:]
        out += [t] * rng.choice([1, 1, 1, 3])
        if rng.random() < 0.3:
            p = rng.randint(0, len(t))
            out.append(t[:p] + "x" + t[p:])
    rng.shuffle(out)
    return out


def spans(mask):
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(int), [0]))))
    return [tuple(e) for e in edge.reshape(-1, 2).tolist()]


def check(spark, texts, rule):
    rows = [(k, t, "h1", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string, size int").repartition(3)
    got = {r.doc_id: r for r in remove_repeats(docs, rule).collect()}
    assert len(got) == len(texts)
    bodies = [(t or "").encode() for t in texts]
    for k, gone in enumerate(brute(bodies, rule.length)):
        assert [(s.start, s.end) for s in got[k].removed] == spans(gone), k
        assert bytes(got[k].kept) == bytes(np.frombuffer(bodies[k], np.uint8)[~gone])


def test_removed_bytes_equal_a_dictionary_of_windows(spark):
    check(spark, corpus(1, 60), RepeatRule(length=60, anchor=16))


def test_groups_too_large_to_sort(spark):
    check(spark, corpus(2, 100), RepeatRule(length=100, anchor=32, group=3, block_bytes=2000))


def test_production_length(spark):
    check(spark, corpus(3, 400)[:30], RepeatRule())


def test_repeats_within_segments():
    rng = random.Random(5)
    for length in (33, 40, 100):
        base = bytes(rng.choice(b"abc\xff") for _ in range(300))
        segments = [base[rng.randint(0, 100) : rng.randint(150, 300)] for _ in range(9)]
        segments += [bytes([rng.choice(b"abc")]) * 150, b"", b"\xff" * 60]
        n = np.arange(len(segments))
        got = repeated_starts(segments, n, np.zeros(len(n), int), np.zeros(len(n), bool), length)
        for g, gone in zip(got, brute_starts(segments, length), strict=True):
            assert g.tolist() == gone


def brute_starts(segments, length):
    met = {}
    for d, t in enumerate(segments):
        for p in range(len(t) - length + 1):
            met.setdefault(t[p : p + length], []).append((d, p))
    twice = {x for v in met.values() if len(v) > 1 for x in v}
    return [[p for p in range(len(t)) if (d, p) in twice] for d, t in enumerate(segments)]


def test_no_rows(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []

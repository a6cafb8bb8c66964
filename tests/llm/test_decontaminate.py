"""Windows against a plain scan of all windows of all items."""

import random
import re
from collections import Counter

import numpy as np

from payrecheck.llm.decontaminate import (
    RADIUS,
    LeakRule,
    _Items,
    drop_contaminated,
    find_items,
)


def brute(text, item, k=5):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    w, v = cut(text), cut(item)
    if not v:
        return None
    size, best = min(k, len(v)), None
    for p in range(len(w) - len(v) + 1):
        a, b = grams(w[p : p + len(v)], size), grams(v, size)
        like = (a & b).total() / (a | b).total()
        if like >= 0.8 and (best is None or like > best[0]):
            best = (like, p)
    return best


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("lmnr")
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 60)))) for k in range(20)]
    items += [(20, None), (21, "  "), (22, "Two words")]
    docs = [(0, None), (1, ""), (2, "two WORDS")]
    for d in range(3, 60):
        w = [word() for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.6:
            v = rng.choice(items[:20])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                v[rng.randrange(len(v))] = word()
            w[len(w) // 2 : len(w) // 2] = v[rng.choice([0, 0, 2]) :]
        docs.append((d, "\n".join([" ".join(w[:50]), " ".join(w[50:]).upper()])))
    return docs, items


def test_items_equal_a_plain_scan(spark):
    docs, items = corpus(1)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for a, t in docs:
        for b, v in items:
            if best := brute(t, v):
                want[a, b] = best
    assert len(want) > 15
    for rule in (LeakRule(), LeakRule(block_items=7)):
        got = find_items(d, i, rule).collect()
        assert {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in got} == want
    kept = {r.doc_id for r in drop_contaminated(d, i).collect()}
    assert kept == {a for a, _ in docs} - {a for a, _ in want}


def test_index_misses_no_fingerprint_within_the_radius():
    items = _Items([0, 1], ["a b c d e f g", "h i j k l m n"], LeakRule())
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(0, RADIUS)
        flipped = int(items.prints[0])
        for b in rng.sample(range(64), n):
            flipped ^= 1 << b
        assert (0, 0) in set(items.candidates(np.array([flipped], np.uint64)))


def test_extra_columns_repeats_and_no_rows(spark):
    kind = "doc_id long, text string, item_id int, c0 string"
    text = "one two three four five six seven"
    d = spark.createDataFrame([(1, "x " + text, 9, "k"), (1, "x " + text, 9, "k"), (None, text, 1, None), (2, "clean", 0, "")], kind)
    i = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id, r.first_word) for r in find_items(d, i).collect()) == [(0, 7, 0), (1, 7, 1), (1, 7, 1)]
    assert [tuple(r) for r in drop_contaminated(d, i).collect()] == [(2, "clean", 0, "")]
    none = spark.createDataFrame([], kind)
    assert find_items(none, i).collect() == [] and drop_contaminated(none, i).collect() == []
    assert drop_contaminated(d, i.limit(0)).count() == 4


def whole(text, item, k=5):
    """As ``brute``, with a document shorter than the item as its one window."""
    n, m = len((text or "").split()), len((item or "").split())
    if n >= m:
        return brute(text, item, k)
    cut = lambda t: Counter(tuple(w[i : i + k]) for w in [t.lower().split()] for i in range(len(w) - k + 1))
    a, b = cut(text or ""), cut(item)
    like = (a & b).total() / max((a | b).total(), 1)
    return (like, 0) if like >= 0.8 else None


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(5)
    words = lambda n: [rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("lmnr") for _ in range(n)]
    texts = [words(n) for n in (4, 5, 15, 30, 38, 60, 61)]
    items = [(k, " ".join(w)) for k, w in enumerate(texts)]
    docs = [(0, None), (1, "")]
    for w in texts:
        for n in (1, 2, 5, 12, 14):
            docs += [(len(docs) + k, " ".join(v)) for k, v in enumerate((w[n:], w[:-n], w[: len(w) // 2] + w[len(w) // 2 + n :]))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    want = {(a, b): (*best, min(len(t.split()), len(v.split()))) for a, t in docs for b, v in items if (best := whole(t, v))}
    assert len(want) > 15
    got = find_items(d, i).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in got} == want
    kept = {r.doc_id for r in drop_contaminated(d, i).collect()}
    assert kept == {a for a, _ in docs} - {a for a, _ in want}


def test_changed_ends_within_the_similarity(spark):
    """Passages whose end words are others, which moves SimHash further than words within."""
    rng = random.Random(7)
    words = lambda n: [rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("lmnr") for _ in range(n)]
    texts = [words(n) for n in (1, 3, 9, 9, 15, 15, 24, 30, 40, 40, 50, 60, 60, 90, 200)] + [["again"] * 30]
    items = [(k, " ".join(w)) for k, w in enumerate(texts)] + [(99, " ".join(texts[9]))]
    docs = []
    for w in texts:
        changed = [w[n:] for n in range(1, 3)] + [w[:-n] for n in range(1, 3)]
        most = len(w) // 9
        for n in range(1, most + 1):
            changed += [words(n) + w[n:], w[:-n] + words(n), words(n // 2) + w[n // 2 : len(w) - n + n // 2] + words(n - n // 2)]
        for v in changed:
            docs.append((len(docs), " ".join(v)))
            docs.append((len(docs), " ".join(words(20) + v + words(30))))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    want = {(a, b): best for a, t in docs for b, v in items if (best := whole(t, v))}
    assert len(want) > 100
    for rule in (LeakRule(), LeakRule(block_items=4)):
        got = find_items(d, i, rule).collect()
        assert {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in got} == want
    kept = {r.doc_id for r in drop_contaminated(d, i).collect()}
    assert kept == {a for a, _ in docs} - {a for a, _ in want}


def test_exact_adds_what_lies_beyond_the_radius(spark, monkeypatch):
    """With a radius of nought the index finds unchanged windows only; ``exact`` finds all."""
    from payrecheck.llm import decontaminate as D

    rng = random.Random(11)
    words = lambda n: [rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("lmnr") for _ in range(n)]
    texts = [words(60) for _ in range(6)]
    items = [(k, " ".join(w)) for k, w in enumerate(texts)]
    docs = [(k, " ".join(words(9) + w + words(9))) for k, w in enumerate(texts)]
    docs += [(10 + k, " ".join(words(3) + w[3:])) for k, w in enumerate(texts)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert D.recall(d, i) == (12, 12)
    held = _Items([k for k, _ in items], [t for _, t in items], LeakRule())
    assert not held.rare and _Items([0], ["a b"], LeakRule(exact=True)).rare
    monkeypatch.setattr(D, "RADIUS", 0)
    near = _Items([k for k, _ in items], [t for _, t in items], LeakRule())
    assert all(set(near.candidates(near.prints)) == {(k, k) for k in range(6)} for _ in range(1))

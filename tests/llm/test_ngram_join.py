"""The join against all pairs, and its components against a plain union-find."""

import random
import re

import pytest

from payrecheck.llm.components import components
from payrecheck.llm.ngram_join import JoinRule, link_documents


def grams(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def roots(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(rows, k, percent):
    sets = [grams(t, k) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    top = roots(len(rows), links)
    return {rows[i][0]: (len(sets[i]), rows[top[i]][0]) for i in range(len(rows))}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrst")
    hot = [word() for _ in range(40)]
    texts = ["", "  \n ", "one", "One", "one two", "a b c", "A  b\tC", None]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(5, 120))]
        if rng.random() < 0.5:
            base[2:2] = hot
        for _ in range(rng.choice([1, 1, 3, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (2, 5, 80), (3, 1, 60)])
def test_classes_equal_all_pairs(spark, seed, k, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = link_documents(docs, JoinRule(words=k, percent=percent, ranked=64)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, percent)
    assert len(got) == len(rows)


def test_group_of_near_copies_is_linked_without_all_pairs(spark):
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(60):
        w = list(base)
        w[k * 2] = f"x{k}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in link_documents(docs).collect()} == {0}


def test_nulls_repeats_extra_columns_and_no_rows(spark):
    kind = "doc_id long, text string, node string, n int, a int"
    same = "the same words again and again in here"
    rows = [(5, same, "x", 1, 1), (5, same, "x", 1, 1), (None, same, "y", 2, 2), (7, same, None, 0, 0)]
    got = link_documents(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (5, 5), (5, 5), (7, 5)]
    assert link_documents(spark.createDataFrame([], kind)).collect() == []


def test_components_of_chains_and_rings(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(40)] + [(50 + k, 50 + (k + 1) % 9) for k in range(9)]
    rng.shuffle(links)
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {(r.node, r.component) for r in got} == {(k, 0) for k in range(1, 41)} | {
        (k, 50) for k in range(51, 59)
    }


def test_unfinished_components_are_an_error(spark, monkeypatch):
    from payrecheck.llm import components as C

    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")
    whole = {(r.node, r.component) for r in C.components(chain).collect()}
    assert whole == {(k, 0) for k in range(1, 41)}
    monkeypatch.setattr(C, "ROUNDS", 1, raising=False)
    with pytest.raises(RuntimeError, match="not complete"):
        C.components(chain)

"""Held-out accuracy of the language model, and its defined cases."""

import random

from payrecheck.llm.langid import LanguageRule, held_out, identify, train

SYLLABLES = {
    "en": "the th ing er on ed ly wh sh".split(),
    "de": "sch ung lich der ein ß ö ge tz".split(),
    "fr": "eau eux tion é è ou ç que aux".split(),
}
KIND = "doc_id long, text string, lang string, score int"


def corpus(seed, n=400):
    rng = random.Random(seed)
    out = []
    for d in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))]
        out.append((d, " ".join(words).capitalize() + ".", lang, d))
    return out


RULE = LanguageRule(bits=12, sample=100)


def test_held_out_documents_are_recognised(spark):
    frame = spark.createDataFrame(corpus(1), KIND).repartition(3)
    unlabelled = held_out(frame["doc_id"])
    model = train(frame.filter(~unlabelled), RULE)
    got = identify(frame, model, RULE).join(frame.select("doc_id", "lang", unlabelled.alias("h")), "doc_id").collect()
    tests = [r for r in got if r.h]
    assert len(got) == 400 and 60 < len(tests) < 140
    assert sum(r.lang_pred == r.lang for r in tests) / len(tests) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    # Sure ones are right more often than not: the scores are calibrated.
    assert abs(sum(r.score for r in tests) / len(tests) - 1) < 0.1


def test_labels_and_sources_are_no_input(spark):
    rows = corpus(2, 120)
    frame = spark.createDataFrame(rows, KIND)
    model = train(frame, RULE)
    swapped = spark.createDataFrame([(d, t, "xx", 0) for d, t, _, _ in rows], KIND)
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in identify(df, model, RULE).collect())
    assert key(frame) == key(swapped)


def test_defined_cases(spark):
    model = train(spark.createDataFrame(corpus(3, 90), KIND), RULE)
    rows = [(1, None, None, 0), (2, "", "", 0), (3, "123 !?", "en", 0), (None, "the thing", None, 0), (5, "é", None, 0), (6, "the thing " * 30_000, None, 0), (6, "the thing " * 30_000, None, 0)]
    got = {(r.doc_id, r.lang_pred) for r in identify(spark.createDataFrame(rows, KIND), model, RULE).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (6, "en")} <= got and len(got) == 6
    none = spark.createDataFrame([], KIND)
    assert identify(none, model, RULE).collect() == []
    unlearnt = train(none, RULE)
    assert {r.lang_pred for r in identify(spark.createDataFrame(rows, KIND), unlearnt, RULE).collect()} == {"und"}

"""Notices planted in plain text are found with their family; nothing else is."""

import random

import pytest

from payrecheck.llm.licences import LicenceRule, scan_licences, train

NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache": "licensed under the  Apache License, Version 2.0 (the License); you may not use it",
    "GPL": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, "
    "are permitted provided that the following conditions are met",
}


def corpus():
    rng = random.Random(6)
    words = "the of and to in is it that was for on are with as be this from by at or an work use".split()
    line = lambda: " ".join(rng.choice(words) + rng.choice(["", "", "en", "ly"]) for _ in range(rng.randint(1, 30)))
    docs, planted = [], {}
    for d in range(120):
        lines = [line() for _ in range(rng.randint(1, 8))]
        if d % 4 == 0:
            family = rng.choice(sorted(NOTICES))
            at = rng.randint(0, len(lines))
            lines.insert(at, NOTICES[family])
            planted[d, at] = family
        docs.append((d, "\n".join(lines), "x"))
    return docs, planted


@pytest.fixture(scope="module")
def model(spark):
    docs, _ = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, family string")
    return train(frame, LicenceRule(variants=12, unknown=300))


def test_notices_are_found_with_their_family(spark, model):
    docs, planted = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, family string").repartition(3)
    got = scan_licences(frame, model).collect()
    assert {(r.doc_id, r.paragraph): r.family for r in got} == planted
    assert all(0.5 <= r.probability <= 1 and 0.5 <= r.similarity <= 1 for r in got)


def test_words_of_licences_alone_are_no_notice(spark, model):
    texts = [
        "the license of this work",
        "free of charge to any person",
        "we were granted permission to use the software in the general public interest",
        "",
        None,
        "license",
        "word " * 50_000,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert scan_licences(frame, model).collect() == []


def test_repeats_nulls_and_no_rows(spark, model):
    kind = "doc_id long, text string, grams int, p string"
    row = (None, "a\n\nReleased under the MIT License.", 1, "p")
    got = scan_licences(spark.createDataFrame([row, row], kind), model).collect()
    assert [(r.doc_id, r.paragraph, r.family) for r in got] == [(None, 2, "MIT")] * 2
    assert scan_licences(spark.createDataFrame([], kind), model).collect() == []

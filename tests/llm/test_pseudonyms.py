"""Formats, validity, linkage and exact round trips of the pseudonyms."""

import datetime as dt
import random
import re

from payrecheck.llm.pseudonyms import (
    Feistel,
    iban_digits,
    luhn_digit,
    pseudonymise,
    replace_values,
)

KEY = b"test key"
TEXT = (
    "Mail und.34@mail7.example.com, card 4417123456789113 or 4417 1234 5678 9113, "
    "IBAN DE89 3704 0044 0532 0130 00, call +1 (017) 555-7713 or 415-555-2671; SSN 123-45-6789. "
    "Host 97.51.17.173. Born 1984-02-29, 29.02.1984 and 02/29/1984."
)


def test_every_kind_is_found_and_keeps_its_format():
    new, found = replace_values(TEXT, KEY)
    assert [k for k, _, _ in found] == [
        "email", "card", "card", "iban", "phone", "phone", "ssn", "ip", "date", "date", "date",
    ]
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+", "9", t)))
    assert shape(new) == shape(TEXT)
    for _, a, b in found:
        assert TEXT[a:b] not in new
    cards = re.findall(r"card (\d+) or ([\d ]+),", new)[0]
    assert cards[0] == cards[1].replace(" ", "") and luhn_digit(cards[0][:-1]) == cards[0][-1]
    iban = re.search(r"IBAN ([A-Z0-9 ]+),", new)[1].replace(" ", "")
    assert iban_digits(iban[:2], iban[4:]) == iban[2:4]
    iso, dotted, us = re.search(r"Born (\S+), (\S+) and (\S+)\.$", new).groups()
    day = dt.date.fromisoformat(iso)
    assert dotted == day.strftime("%d.%m.%Y") and us == day.strftime("%m/%d/%Y")


def test_round_trip_and_keys():
    new, _ = replace_values(TEXT, KEY)
    assert replace_values(new, KEY, back=True)[0] == TEXT
    assert replace_values(TEXT, b"other")[0] != new


def test_permutations_are_one_to_one():
    f = Feistel(KEY)
    assert sorted(f.within(k, 1000, b"t") for k in range(1000)) == list(range(1000))
    assert len({f.text(f"{k:03d}", "t") for k in range(1000)}) == 1000
    rng = random.Random(1)
    for _ in range(200):
        n, size = rng.randrange(500), 777
        assert f.within(f.within(n, size, b"u"), size, b"u", back=True) == n


def test_what_is_not_valid_stays():
    text = "4417123456789112 300.1.2.3 1999-02-30 000-12-3456 04dbebab91ab85687d33eeaaf9ac699e1188f962 DE89370400440532013001 v1.2.3.4.5"
    assert replace_values(text, KEY) == (text, [])


def test_rows(spark):
    kind = "doc_id long, text string, found string, c1 int"
    rows = [(1, TEXT, "a", 1), (2, TEXT, "a", 1), (2, TEXT, "a", 1), (None, None, None, None), (3, "", "", 0), (4, "no value " * 20_000, "", 0)]
    got = pseudonymise(spark.createDataFrame(rows, kind), KEY).toDF("doc_id", "text", "f", "c1", "found").collect()
    assert len(got) == 6 and len({r.text for r in got if r.doc_id in (1, 2)}) == 1
    assert [(r.text, r.found) for r in got if r.doc_id is None] == [(None, [])]
    assert [r.text for r in got if r.doc_id == 4] == ["no value " * 20_000]
    assert pseudonymise(spark.createDataFrame([], kind), KEY).collect() == []

"""The queue of merges against the public library, on hard and on random texts."""

import os
import random
from array import array

import pytest

from payrecheck.llm import bpe

public = pytest.importorskip("public_tokenizers")

TEXTS = [
    None,
    "",
    " ",
    "Hello  World\n\nit's they'LL 12345 3.14",
    "ΑΣ Σίσυφος İstanbul ﬁne ſtraße é Å 日本語 한국어 ไทย",
    "a<|endoftext|>b<|startoftext|><|endoftext|> <|endoftext",
    "🙂🙂 ñ ß \x85 \xa0   \x1c",
    "x" * 5000,
    "ab" * 3000 + "!" * 400,
    "Thndinha theeronbleou ofthstthor Ètion çément $$$ ***",
    "internationalization's straightforward_representatives",
    "Ɤ ՘ Ᲊ \U0002ebf0",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary()


def _ids(code, text):
    return array("i", code.encode(text)).tolist()


def test_tables_of_texts(spark, vocabulary, library):
    rows = [(k, t, "mine", k) for k, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, Ids string, made int")
    got = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    assert got.columns == ["doc_id", "text", "made", "ids", "decoded"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want, r.text
        assert r.decoded == library.decode(want, skip_special_tokens=False)
        assert r.made == r.doc_id


def test_random_texts(vocabulary, library):
    code = bpe.Coder(vocabulary.source)
    rng = random.Random(5)
    kinds = ["abcdeinrst '", "ÀÉßçñ aB1.,", "".join(map(chr, range(32, 0x370)))]
    for k in range(600):
        letters = kinds[k % 3]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        assert _ids(code, text) == library.encode(text, add_special_tokens=False).ids, text


def test_every_character(vocabulary, library):
    code = bpe.Coder(vocabulary.source)
    for start in range(0, 0x3000, 8):
        text = "".join("a" + chr(c) + "1 " + chr(c) for c in range(start, start + 8))
        assert _ids(code, text) == library.encode(text, add_special_tokens=False).ids


def test_a_small_cache_changes_nothing(vocabulary, monkeypatch):
    text = " ".join(f"word{k % 40} other{k % 7}" for k in range(500))
    want = bpe.Coder(vocabulary.source).encode(text)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    assert bpe.Coder(vocabulary.source).encode(text) == want


def test_rows_are_handed_on_in_parts(spark, vocabulary, library, monkeypatch):
    docs = spark.createDataFrame([(k, f"number {k} " * 30) for k in range(50)], "id int, text string")
    monkeypatch.setattr(bpe, "FLUSH", 100)
    for r in bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids


def test_no_rows_null_ids_and_unknown_ids(spark, vocabulary):
    empty = spark.createDataFrame([], "text string")
    assert bpe.decode(bpe.encode(empty, vocabulary), vocabulary).collect() == []
    rows = [(None,), ([],), ([3306, None, 10**6, -1, 49407],)]
    got = bpe.decode(spark.createDataFrame(rows, "ids array<int>"), vocabulary).collect()
    assert [r.decoded for r in got] == ["", "", "hello</w> <|endoftext|>"]


def test_only_its_kind_of_file(tmp_path):
    with pytest.raises(ValueError):
        bpe.load_vocabulary(public.path("byte_bpe_50k.json"))
    assert os.listdir(tmp_path) == []

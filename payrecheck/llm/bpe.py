"""BPE encoding and decoding by a priority queue of merges.

A text is cut into words by the vocabulary file's own rules (normal form, lower case,
split pattern, bytes as characters).  A word is a doubly linked list of symbols; a heap
holds the ranks of the merges of neighbours, and an entry whose symbols have changed since
is stale and skipped.  Decoding concatenates the vocabulary's strings, with a blank between
two, as the file names no decoder.  Special tokens are recognised in the raw text first,
as the file says.

Each task reads its rows once and needs no shuffle.  Words that were merged are kept in
two tables of at most ``CACHE_WORDS`` each a worker, so frequent ones are merged once; a word of
any length is merged in n log n.

Defined results: a null or empty text has an empty array, and null or empty ids an
empty text; ids outside the vocabulary are passed over; repeated rows are encoded each;
merges of one rank go leftmost first; an empty table gives no rows.  All other columns are carried
through, and one that has the output's name is replaced, as by ``withColumn``.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Entries kept by a worker; changes the time only.
CACHE_WORDS = 1 << 18
#: Longer words are merged each time.
CACHE_CHARS = 40
#: Ids or characters after which a worker hands on what it has.
FLUSH = 1 << 22
_END = "</w>"
#: Characters of plain texts, and those that their lower case can be.
_PLAIN, _LOWERED = 0x230, 0x300


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file of the ``tokenizers`` library, as text; the driver reads it."""

    source: str

    def __post_init__(self) -> None:
        content = json.loads(self.source)
        model = content["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END or content["decoder"]:
            raise ValueError("only BPE vocabularies with word ends and no decoder are known here")


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary at ``path``; by default the public one of 49k words."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return Vocabulary(file.read())


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class _Kept(dict):
    """Words and their ids, as bytes; a missing word is merged.

    Two generations: when the young one is full it becomes the old one, from which words that
    are met again come back, so frequent words stay.
    """

    def __init__(self, merge) -> None:
        super().__init__()
        self.merge, self.old = merge, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word) or self.merge(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class Coder:
    """The tables of a vocabulary, ready to encode and decode."""

    def __init__(self, source: str) -> None:
        from tokenizers import Tokenizer

        content = json.loads(source)
        ids: dict[str, int] = content["model"]["vocab"]
        merges = content["model"]["merges"]
        #: The rank of two neighbours, and the id that each rank makes.
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.special = {t: array("i", [k]).tobytes() for t, k in special.items()}
        longest_first = sorted(special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        known = ids | special
        self.texts = [""] * (max(known.values()) + 1)
        for word, k in known.items():
            self.texts[k] = word
        self.known = set(known.values())
        characters = _byte_characters()
        self.inner = [ids[c] for c in characters]
        self.last = [ids[c + _END] for c in characters]
        self.byte_of = {c: b for b, c in enumerate(characters)}
        # Below this normal form, lower case (also its result) and classes are as in every Unicode
        # version, so words are cut in one pass; other texts take the library's rules.
        self.plain = re.compile(f"[\0-{chr(_PLAIN - 1)}]*")
        rules = content["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            members = [chr(c) for c in range(_LOWERED) if regex.match(name, chr(c))]
            rules = rules.replace(name, "".join(map(re.escape, members)))
        self.words = re.compile(rules)
        cutter = Tokenizer.from_str(source)
        self.normal, self.cut = cutter.normalizer, cutter.pre_tokenizer
        self.kept = _Kept(lambda word: self.merge(word.encode()))

    def merge(self, word: bytes) -> bytes:
        """The ids of one word, as bytes of 32-bit integers."""
        inner, rank_of, made = self.inner, self.ranks.get, self.made
        symbols = [inner[c] for c in word]
        symbols[-1] = self.last[word[-1]]
        n = len(symbols)
        if n == 1:
            return array("i", symbols).tobytes()
        # An entry is its rank and its place in one number.
        queue = [
            rank << 32 | at
            for at in range(n - 1)
            if (rank := rank_of(symbols[at] << 32 | symbols[at + 1])) is not None
        ]
        if not queue:
            return array("i", symbols).tobytes()
        heapify(queue)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while queue:
            entry = heappop(queue)
            at = entry & 0xFFFFFFFF
            right = after[at]
            # Stale: one of the two symbols was taken by another merge.
            if right < 0 or symbols[at] < 0:
                continue
            if rank_of(symbols[at] << 32 | symbols[right]) != entry >> 32:
                continue
            symbols[at] = merged = made[entry >> 32]
            symbols[right] = -1
            after[at] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = at
                if (rank := rank_of(merged << 32 | symbols[beyond])) is not None:
                    heappush(queue, rank << 32 | at)
            left = before[at]
            if left >= 0 and (rank := rank_of(symbols[left] << 32 | merged)) is not None:
                heappush(queue, rank << 32 | left)
        return array("i", [s for s in symbols if s >= 0]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as bytes of 32-bit integers."""
        out = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif self.plain.fullmatch(part):
                words = self.words.findall(part.lower())
                out.append(b"".join(map(self.kept.__getitem__, words)))
            else:
                for word, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(part)):
                    out.append(self.merge(bytes([self.byte_of[c] for c in word])))
        return b"".join(out)

    def decode(self, ids: list[int | None]) -> str:
        texts, known = self.texts, self.known
        return " ".join([texts[k] for k in ids if k in known])


@lru_cache(maxsize=2)
def coder(source: str) -> Coder:
    """One for each worker process, whatever the number of its tasks."""
    return Coder(source)


def _with_column(docs: DataFrame, name: str, kind: str, source: str, work) -> DataFrame:
    """``docs`` with a column that ``work`` makes of an Arrow array, by pieces.

    Columns travel by position, so names that clash do no harm.
    """
    names = docs.columns
    at = names.index(source)
    keep = [k for k, n in enumerate(names) if n.lower() != name.lower()]
    held = docs.toDF(*[f"c{k}" for k in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for made in work(batch.column(at)):
                part = batch.slice(done, len(made))
                done += len(made)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), made], [*(f"c{k}" for k in keep), "made"]
                )

    fields = [f"c{k} {docs.dtypes[k][1]}" for k in keep]
    out = held.mapInArrow(run, ", ".join([*fields, f"made {kind}"]))
    return out.toDF(*(names[k] for k in keep), name)


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """``docs`` with the array of ids of each whole text."""
    source = vocabulary.source

    def work(column: pa.Array) -> Iterator[pa.Array]:
        code = coder(source)
        parts, ends = [], [0]
        for value in column:
            parts.append(code.encode(value.as_py() or ""))
            ends.append(ends[-1] + len(parts[-1]) // 4)
            if ends[-1] >= FLUSH:
                yield _lists(parts, ends)
                parts, ends = [], [0]
        if parts:
            yield _lists(parts, ends)

    return _with_column(docs, ids, "array<int>", text, work)


def _lists(parts: list[bytes], ends: list[int]) -> pa.Array:
    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def decode(
    docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded"
) -> DataFrame:
    """``docs`` with the text of each array of ids."""
    source = vocabulary.source

    def work(column: pa.Array) -> Iterator[pa.Array]:
        code = coder(source)
        texts, size = [], 0
        for value in column:
            texts.append(code.decode(value.values.to_pylist()) if value.is_valid else "")
            size += len(texts[-1])
            if size >= FLUSH:
                yield pa.array(texts, pa.string())
                texts, size = [], 0
        if texts:
            yield pa.array(texts, pa.string())

    return _with_column(docs, out, "string", ids, work)

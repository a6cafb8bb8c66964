"""Words and shingles of Arrow text columns as 64-bit hashes, whole batches at a time.

A word is a run of bytes other than space, tab, and line feed to carriage return,
with A-Z in lower case.  Word hashes are polynomials over random byte values,
computed from running sums, so no text is touched byte by byte in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at once, if one document does not have more.
CHUNK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(int(_RNG.integers(1, 2**62)) * 2 + 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
# Upper-case letters share the value of the lower-case ones.
_BYTE[65:91] = _BYTE[97:123]
_powers: dict[str, np.ndarray] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``limit`` bytes with the row they start at; nulls become empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary array and the offset of each row, and of the end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[
        texts.offset : texts.offset + len(texts) + 1
    ]
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word; for each row the first of its words, and the end."""
    inner = ~_SPACE[data]
    before = np.empty_like(inner)
    before[:1] = False
    before[1:] = inner[:-1]
    edges = offsets[offsets < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inner & ~before)
    after = np.empty_like(inner)
    after[-1:] = False
    after[:-1] = inner[1:]
    after[offsets[(offsets > 0)] - 1] = False
    ends = np.flatnonzero(inner & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word; for each row the first of its words, and the end."""
    data, offsets = raw(texts)
    starts, ends, rows = word_spans(data, offsets)
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths), rows


def shingle_sets(words: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each row.

    A row with fewer words than ``size`` has its whole sequence as one shingle; a row
    without words has none.
    """
    at = np.zeros(len(words), np.uint64)
    n = len(words) - size + 1
    if n > 0:
        at[:n] = words[:n]
        for k in range(1, size):
            at[:n] = mix(at[:n]) + words[k : k + n]
        at = mix(at)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(at[a : b - size + 1])
            new = np.empty(len(s), bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            out.append(s[new])
        elif b > a:
            # Arrays wrap around without a warning; numbers do not.
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = mix(h) + words[k : k + 1]
            out.append(mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of one batch are worked on in runs of about so many bytes; one long text may exceed it.
RUN_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


@dataclass
class Texts:
    """A run of texts: their bytes, where each begins, and which rows of the batch they are."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Byte spans of words; ``at[i]:at[i + 1]`` are the words of text i."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray


def runs(column: pa.Array, most: int = RUN_BYTES) -> Iterator[Texts]:
    """The texts of a string or binary column without nulls, in order, run by run."""
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(ends, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        part = offsets[row : last + 1]
        yield Texts(raw[part[0] : part[-1]], part - part[0], row)
        row = last


def filled(column: pa.Array) -> pa.Array:
    """A string or binary column with its nulls as empty values."""
    if not column.null_count:
        return column
    return pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) else "", column.type))


def lowered(texts: Texts) -> Texts:
    """A-Z as a-z; all other bytes stay."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return Texts(table[texts.data], texts.offsets, texts.first)


def _spans(inside: np.ndarray, offsets: np.ndarray) -> Words:
    """Longest runs of set bytes that do not cross from one text to the next."""
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64))
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def words(texts: Texts) -> Words:
    """Words are runs of bytes other than 0x20 and 0x09-0x0D."""
    return _spans(~_SPACE[texts.data], texts.offsets)


_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(texts: Texts) -> Words:
    """Terms are runs of ASCII letters and digits and of all characters beyond ASCII."""
    return _spans(_TERM[texts.data], texts.offsets)


#: UTF-8 of white space beyond ASCII (Unicode property White_Space), a fixed list.
WIDE_SPACES = [
    b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80\x80", b"\xe2\x80\x81", b"\xe2\x80\x82",
    b"\xe2\x80\x83", b"\xe2\x80\x84", b"\xe2\x80\x85", b"\xe2\x80\x86", b"\xe2\x80\x87",
    b"\xe2\x80\x88", b"\xe2\x80\x89", b"\xe2\x80\x8a", b"\xe2\x80\xa8", b"\xe2\x80\xa9",
    b"\xe2\x80\xaf", b"\xe2\x81\x9f", b"\xe3\x80\x80",
]


def chunks(texts: Texts) -> Words:
    """Cut each text before white space that follows a word; the pieces make up the text.

    A cut lies between a character that is no white space and an ASCII white-space byte.
    """
    data, offsets = texts.data, texts.offsets
    n = len(data)
    if n == 0:
        return _spans(np.zeros(0, bool), offsets)
    space = _SPACE[data]
    blocked = space.copy()
    if (data >= 0xC2).any():
        for mark in WIDE_SPACES:
            m = np.frombuffer(mark, np.uint8)
            hit = data[: n - len(m) + 1] == m[0]
            for k in range(1, len(m)):
                hit = hit & (data[k : n - len(m) + 1 + k] == m[k])
            blocked[np.flatnonzero(hit) + len(m) - 1] = True
    cut = np.zeros(n, dtype=bool)
    cut[1:] = space[1:] & ~blocked[:-1]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(cut)
    return Words(start, np.append(start[1:], n), np.searchsorted(start, offsets))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64-bit result."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = _powers[base] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same in every process."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers_of(_BASE, n), out=total[1:])
    return mixed((total[end] - total[start]) * _powers_of(_INVERSE, n + 1)[start])


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + length[0] - 1, start[1] .., one after the other."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total, dtype=np.int64)


def distinct(data: np.ndarray, spans: Words) -> tuple[np.ndarray, np.ndarray]:
    """(code of each span, a span for each code): spans have one code exactly if their bytes are equal."""
    start, end = spans.start, spans.end
    codes, found = pd.factorize(hashes(data, start, end))
    first = np.zeros(len(found), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    # Equal hashes are not proof: compare all bytes with those of the first span.
    length = end - start
    same = np.array_equal(length, length[first][codes])
    if same:
        own = data if len(data) == int(length.sum()) else data[ragged(start, length)]
        same = np.array_equal(own, data[ragged(start[first][codes], length)])
    if not same:
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
        numbers: dict[bytes, int] = {}
        codes = np.array([numbers.setdefault(t, len(numbers)) for t in texts], dtype=np.int64)
        first = np.zeros(len(numbers), dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i + 1]] for each i, empty ranges included."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]

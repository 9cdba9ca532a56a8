"""Vectorised word tools over the UTF-8 bytes of Arrow string columns.

One pass over the bytes of many texts finds words and gives each a 64-bit hash;
a second prefix sum gives hashes of runs of words. Both are polynomial sums in
arithmetic modulo 2**64, taken apart by differences and finished by a mixing
function, so no step loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes, or words, that are hashed at once.
CHUNK = 1 << 18
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and the inverses of these, modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got[0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.empty(size, U), np.empty(size, U)
        up[0] = down[0] = 1
        up[1:], down[1:] = U(base), U(pow(base, -1, 1 << 64))
        got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 1 << 21:  # only span_hash of a very long text asks for so many
            return got
        _powers[base] = got
    return got


def byte_table(separators: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and each byte's hash; lower: A-Z count as a-z."""
    word = np.ones(256, bool)
    word[np.frombuffer(separators, np.uint8)] = False
    codes = _BYTES.copy()
    if lower:
        codes[65:91] = _BYTES[97:123]
    return word, codes


BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
PLAIN = byte_table(BLANKS)


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    hash: np.ndarray  # of each word
    first: np.ndarray  # for each text, and one more: the number of its first word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def word_hash(word: str, lower: bool = False) -> int:
    table = byte_table(BLANKS, lower)
    return int(split(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]), table).hash[0])


def split(data: np.ndarray, offsets: np.ndarray, table=PLAIN) -> Words:
    """Words of the texts data[offsets[i]:offsets[i+1]].

    The bytes are walked in chunks, and a word that goes on in the next chunk carries its sum along, so what a
    text takes beyond its words' places and hashes does not grow with its length.
    """
    is_word, codes = table
    n, found = len(data), [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, U),)]
    begun, so_far = -1, 0  # start and sum of the word that is open at a chunk's begin
    for a in range(0, n, CHUNK):
        part = data[a : a + CHUNK]
        inside, size = is_word[part], len(part)
        edge = np.zeros(size + 1, bool)
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + size, "right")] - a] = True
        before, after = np.r_[begun >= 0, inside[:-1]], np.r_[inside[1:], True]
        start = np.flatnonzero(inside & (edge[:-1] | ~before))
        end = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
        up, down = _power(_BASE, size)
        sums = np.empty(size + 1, U)
        sums[0] = 0
        np.cumsum(codes[part] * up[:size], out=sums[1:])
        if begun >= 0:
            on = 0 if edge[0] or not inside[0] else int(end[0]) if len(end) else size
            so_far = (so_far + int(sums[on]) * pow(_BASE, a - begun, 1 << 64)) % (1 << 64)
            if on == size and not edge[size]:
                continue
            found.append((np.array([begun]), np.array([a + on]), mix(np.array([(so_far + a + on - begun) % (1 << 64)], U))))
            begun, end = -1, end[on > 0 :]
        s, e = start[: len(end)], end
        found.append((a + s, a + e, mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))))
        if len(start) > len(end):
            s = int(start[-1])
            begun, so_far = a + s, (int(sums[size]) - int(sums[s])) * int(down[s]) % (1 << 64)
    start, end, value = (np.concatenate(x) for x in zip(*found))
    return Words(data, start, end, value, np.searchsorted(start, offsets))


def runs(words: Words, n: int, short: bool = False, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and the number of each run's first word.

    short: a text with 1 to n-1 words gives one run of all its words.
    """
    total, found = len(words.hash), [(np.zeros(0, U), np.zeros(0, np.int64))]
    for a in range(0, total, CHUNK):
        at = np.arange(a, min(a + CHUNK, total))
        h = words.hash[a : a + CHUNK + n - 1]
        if salt:
            h = mix(h ^ U(salt))
        up, down = _power(_STEP, len(h))
        sums = np.empty(len(h) + 1, U)
        sums[0] = 0
        np.cumsum(h * up[: len(h)], out=sums[1:])
        text = np.searchsorted(words.first, at, "right") - 1
        last = words.first[text + 1]
        full = at + n <= last
        if short:
            full |= (at == words.first[text]) & (last - at < n)
        at, stop = at[full], np.minimum(at + n, last)[full]
        found.append((mix((sums[stop - a] - sums[at - a]) * down[at - a]), at))
    value, at = (np.concatenate(x) for x in zip(*found))
    return value, at


def pieces(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of whole texts of about `most` bytes: rows, bytes, offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
        yield slice(row, stop), data[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def span_hash(words: Words, start: np.ndarray, stop: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of the runs of words start:stop, of any lengths."""
    h = words.hash if not salt else mix(words.hash ^ U(salt))
    up, down = _power(_STEP, len(h))
    sums = np.empty(len(h) + 1, U)
    sums[0] = 0
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start])

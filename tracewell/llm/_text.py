"""Vectorised words, word hashes and shingles over the UTF-8 bytes of Arrow string columns.

All separators are ASCII, so bytes from 0x80 always belong to words and no text has to be
decoded. A word's hash is a polynomial over its (lower-cased) bytes modulo 2**64, taken from
one running sum over the whole buffer, and then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def _mix_int(x: int) -> int:
    x &= (1 << 64) - 1
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & ((1 << 64) - 1)
    x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & ((1 << 64) - 1)
    return x ^ (x >> 33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


#: A 64-bit value for each byte, upper-case letters like their lower-case ones.
_VALUE = np.array([_mix_int(ord(chr(b).lower()) + 1 if 65 <= b <= 90 else b + 1) for b in range(256)], dtype=U64)


def _separators(kind: str) -> np.ndarray:
    within = np.zeros(256, dtype=bool)
    if kind == "space":  # words [^\x20\x09-\x0D]+
        within[:] = True
        within[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    else:  # "alnum": words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
        within[0x80:] = True
        for low, high in (("0", "9"), ("a", "z"), ("A", "Z")):
            within[ord(low) : ord(high) + 1] = True
    return within


WITHIN = {"space": _separators("space"), "alnum": _separators("alnum")}

_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the step and of its inverse, kept between calls."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 20)
        for k, base in enumerate((_STEP, _BACK)):
            out = np.full(m, base, dtype=U64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of a batch of texts: hash, first byte and end of each, and where each text's words begin."""

    __slots__ = ("hashes", "starts", "ends", "bounds", "buffer")

    def __init__(self, hashes, starts, ends, bounds, buffer):
        self.hashes, self.starts, self.ends, self.bounds, self.buffer = hashes, starts, ends, bounds, buffer

    def text(self, k: int) -> str:
        return self.buffer[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[where[0] : where[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, where - where[0]


def words(column: pa.Array, kind: str = "space") -> Words:
    """Words of every text of the column; hashes are those of the words with A-Z lower-cased."""
    raw, offsets = bytes_of(column)
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=U64), none, none, np.zeros(len(offsets), dtype=np.int64), raw)
    inside = WITHIN[kind][raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]  # texts adjoin in the buffer: words end there too
    edges = edges[(edges > 0) & (edges < len(raw))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(starts), dtype=U64)
    step = 1 << 20
    # The running sum restarts every MB, at a word's start, which keeps the table of powers small.
    at = 0
    while at < len(starts):
        begin = starts[at]
        to = np.searchsorted(starts, begin + step)
        stop = ends[to - 1]
        up, down = _power(int(stop - begin))
        total = np.empty(int(stop - begin) + 1, dtype=U64)
        total[0] = 0
        np.cumsum(_VALUE[raw[begin:stop]] * up, out=total[1:])
        s, e = starts[at:to] - begin, ends[at:to] - begin
        hashes[at:to] = (total[e] - total[s]) * down[s]
        at = to
    return Words(mix(hashes ^ (ends - starts).astype(U64)), starts, ends, np.searchsorted(starts, offsets), raw)


def word_hash(word: str) -> int:
    """The hash that ``words`` gives a single word."""
    return int(words(pa.array([word]), "space").hashes[0])


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words, and n + 1 bounds by text.

    A text of fewer words than k, but not none, gives its whole sequence as one shingle.
    """
    h, bounds = w.hashes, w.bounds
    counts = np.diff(bounds)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    n = len(h)
    out = np.zeros(out_bounds[-1], dtype=U64)
    if not n:
        return out, out_bounds
    rolled = np.zeros(max(n - k + 1, 0), dtype=U64)
    for j in range(k):
        rolled += mix(h[j : n - k + 1 + j] + U64(j + 1)) if n >= k else U64(0)
        rolled *= U64(_STEP)
    long_text = counts >= k
    if n >= k:
        ok = np.zeros(n + 1, dtype=np.int32)
        np.add.at(ok, bounds[:-1][long_text], 1)
        np.add.at(ok, bounds[1:][long_text] - k + 1, -1)
        ok = np.cumsum(ok)[:n] > 0
        where = np.flatnonzero(ok)
        target = np.zeros(len(out), dtype=bool)
        mark = np.zeros(len(out) + 1, dtype=np.int32)
        np.add.at(mark, out_bounds[:-1][long_text], 1)
        np.add.at(mark, out_bounds[1:][long_text], -1)
        target = np.cumsum(mark)[: len(out)] > 0
        out[target] = mix(rolled[where])
    for t in np.flatnonzero((counts > 0) & (counts < k)):
        x = int(counts[t])
        for v in h[bounds[t] : bounds[t + 1]]:
            x = _mix_int(x * _STEP + int(v))
        out[out_bounds[t]] = x
    return out, out_bounds


def slices(batch: pa.RecordBatch, column: int, most: int = 2_000_000):
    """The batch cut into runs of rows with at most so many bytes in a string column (a longer text comes alone)."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values, across the ends of texts too."""
    if k == 1:
        return hashes
    n = max(len(hashes) - k + 1, 0)
    out = np.zeros(n, dtype=U64)
    for j in range(k):
        out += mix(hashes[j : n + j] + U64(j + 1))
        out *= U64(_STEP)
    return mix(out)


SIEVE_BITS = 20


def sieve(keys: np.ndarray) -> np.ndarray:
    """Which low bits occur among some hashes: a test that most other hashes fail."""
    out = np.zeros(1 << SIEVE_BITS, dtype=bool)
    out[keys & U64((1 << SIEVE_BITS) - 1)] = True
    return out


def lookup(hashes: np.ndarray, keys: np.ndarray, sieved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the hashes that are among the sorted keys, and the place of each one's key."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(sieved[hashes & U64((1 << SIEVE_BITS) - 1)])
    key = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
    same = keys[key] == hashes[at]
    return at[same], key[same]


def spread(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions in some ranges, one range after the other."""
    n = ends - begins
    return np.repeat(begins - np.cumsum(n, dtype=np.int64) + n, n) + np.arange(int(n.sum()))


def text_of(w: Words) -> np.ndarray:
    """The number of the text that each word is in."""
    return np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))


def stems(w: Words, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length in bytes: which words are longer, and hashes of their beginnings."""
    out, size, total = [], w.ends - w.starts, np.zeros(len(w.starts), dtype=U64)
    for j in range(max(lengths)):
        here = np.minimum(w.starts + j, max(len(w.buffer) - 1, 0))
        if len(here):
            total += _VALUE[w.buffer[here]] * U64(pow(_STEP, j, 1 << 64))
        if j + 1 in lengths:
            longer = np.flatnonzero(size > j + 1)
            out.append((longer, mix(total[longer] ^ U64((j + 1) << 32))))
    return out

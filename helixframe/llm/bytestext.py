"""Columns of texts as flat UTF-8 byte arrays: spans of words and their hashes, by numpy over whole batches.

Memory is bounded by the chunk size, or by the one text that is longer than it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20
_WINDOW = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PRIME, _PRIME_BASE = np.uint64((1 << 31) - 1), 0x2545F491

#: Lower-cases A-Z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true inside the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words that hold digits, lower-case letters and everything beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes that aren't ASCII white space.
SOLID = ~byte_class((0x09, 0x0D), (0x20, 0x20))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _prime_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, int(_PRIME)))
        out[have : 2 * have] = out[: min(have, n - have)] * step % _PRIME
        have *= 2
    return out


_UP, _DOWN = _powers(_BASE, _WINDOW + 1), _powers(_UNBASE, _WINDOW + 1)
_PRIME_UP, _PRIME_DOWN = (_prime_powers(b, _WINDOW + 1) for b in (_PRIME_BASE, pow(_PRIME_BASE, -1, int(_PRIME))))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit moves every output bit."""
    x = x + np.uint64(seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them), each of about limit bytes. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, where, data = texts.buffers()
    at = np.frombuffer(where, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, end, flat[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def spans(flat: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes inside each row, and each row's first index among them."""
    if not len(flat):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = word[flat]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(flat))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hasher(flat: np.ndarray):
    """A function from starts and ends to hashes of the bytes between, the same for equal bytes wherever they stand.

    A polynomial modulo 2^64; some regular strings of over a thousand bytes have equal ones, so callers compare the bytes.
    """
    up, down = (_UP, _DOWN) if len(flat) <= _WINDOW else (_powers(_BASE, len(flat) + 1), _powers(_UNBASE, len(flat) + 1))
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
    return lambda a, b: mix((sums[b] - sums[a]) * down[a] ^ (b - a).astype(np.uint64) * _UNBASE)


def _prime_hasher(flat: np.ndarray):
    """Like span_hasher, of a polynomial modulo a prime of 31 bits, which the regular strings above don't defeat."""
    long = len(flat) > _WINDOW
    up, down = (_prime_powers(b, len(flat) + 1) for b in (_PRIME_BASE, pow(_PRIME_BASE, -1, int(_PRIME)))) if long else (_PRIME_UP, _PRIME_DOWN)
    terms = (flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)]  # 39 bits each, so that a window's sum stays under 2^58
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(terms % _PRIME if long else terms, out=sums[1:])
    return lambda a, b: (sums[b] - sums[a]) % _PRIME * down[a] % _PRIME


def hash_spans(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes, by both polynomials. starts and ends ascend."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + _WINDOW, side="right")))
        part, a, b = flat[low : int(ends[j - 1])], starts[i:j] - low, ends[i:j] - low
        out[i:j] = span_hasher(part)(a, b) + mix(_prime_hasher(part)(a, b), 3)
        i = j
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i to i + k - 1 at each i at which k words are left in the array."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = total * _BASE + words[j : j + n]
    return mix(total, k)


def gram_rows(row_words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the grams that stay inside their row, and how many each row has, from the rows' first word indices."""
    counts = np.maximum(np.diff(row_words) - k + 1, 0)
    return ragged(row_words[:-1], counts), counts


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return shift + np.arange(total)


def bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))

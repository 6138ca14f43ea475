"""Words of texts and hashes of their windows, whole Arrow batches at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Words are hashed by a polynomial over random 64-bit values of
their bytes modulo 2**64, windows by a Rabin-Karp polynomial over the mixed hashes of their words; all come from
prefix sums, so the cost of a window doesn't depend on its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240917)
_BYTES = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
#: Bytes that are hashed in one piece, unless one text is longer.
PIECE_BYTES = 1 << 21

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and their inverses."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 2**64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        have = _tables[base] = (made[0], made[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit (the finalizer of splitmix64)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and the offsets of each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A mixed hash per word of the texts, and the offsets of each text's words among them."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        piece, bounds = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        n = len(piece)
        if n:
            solid = ~_SPACE[piece]
            opens = solid.copy()
            opens[1:] &= ~solid[:-1]
            edges = bounds[:-1][bounds[:-1] < n]
            opens[edges] = solid[edges]
            closes = solid.copy()
            closes[:-1] &= ~solid[1:]
            edges = bounds[1:][bounds[1:] > 0] - 1
            closes[edges] = solid[edges]
            starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            up, down = _powers(_BASES[0], n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[piece] * up, out=sums[1:])
            hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
            at = np.searchsorted(starts, bounds)
            counts[first:last] = np.diff(at)
        first = last
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), out


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A mixed Rabin-Karp hash of every width consecutive words (over text bounds too: the caller leaves those out)."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(_BASES[1 + salt % 2], n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((mix(words, salt) if salt else words) * up, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1], salt + 1)


def window_starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every window that lies in one text, and the text's index."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(len(text)) - before[text] + offsets[:-1][text], text

"""Word and shingle hashes of Arrow text columns, computed on whole buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D, as in the
regular expression ``[^\\x20\\x09-\\x0D]+`` over UTF-8 text.  A word's hash
takes its bytes in lanes of eight, each mixed into the state by steps that no
other lane can undo; words of more than ``LONG`` bytes are hashed by BLAKE2b.
Hashes of different seeds are independent.  Shingles are sums of word hashes
times odd factors, mixed.  So a block costs a few passes of numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

LONG = 64  # bytes of a word that are hashed in lanes
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 (public domain), a bijection of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: By the bytes left of a word: which bits of a lane are its own.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
_STEP = _U(0x9DDFEA08EB382D69)


def _constants(seed: int) -> tuple[int, np.ndarray]:
    """First state of word hashes, and factors of shingle positions."""
    if seed not in _known:
        rng = np.random.default_rng(seed)
        start = int(rng.integers(1, 2**62))
        _known[seed] = start, rng.integers(1, 2**62, 64, dtype=np.int64).view(_U) * _U(2) + _U(1)
    return _known[seed]


_known: dict[int, tuple[int, np.ndarray]] = {}


def factor(seed: int, k: int) -> np.uint64:
    return _constants(seed)[1][k]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in ``raw``, and for each text the index of its first word."""
    solid = ~_SPACE[raw]
    before = np.empty_like(solid)
    before[1:] = solid[:-1]
    before[:1] = False
    cuts = at[(at > 0) & (at < len(raw))]
    before[cuts] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[:-1] = solid[1:]
    after[-1:] = False
    after[cuts - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool, seed: int = 1) -> np.ndarray:
    """64-bit hash of each word, in order of their starts; with ``fold`` A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, _U)
    low, high = int(starts[0]), int(ends.max())
    part = np.zeros(high - low + 8, np.uint8)
    part[:-8] = _FOLD[raw[low:high]] if fold else raw[low:high]
    lanes = np.ndarray((high - low + 1,), "<u8", buffer=part, strides=(1,))
    at, size = starts - low, ends - starts
    first = _constants(seed)[0]
    out = size.astype(_U) * _STEP ^ _U(first)
    out ^= lanes[at] & _LANE[np.minimum(size, 8)]
    out *= _STEP
    out ^= out >> _U(32)
    more = np.flatnonzero(size > 8)
    for k in range(8, LONG, 8):
        more = more[size[more] > k]
        if not len(more):
            break
        x = out[more] ^ (lanes[at[more] + k] & _LANE[np.minimum(size[more] - k, 8)])
        x *= _STEP
        x ^= x >> _U(32)
        out[more] = x
    out = mix(out)
    key = first.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(blake2b(part[at[i] : at[i] + size[i]].data, digest_size=8, key=key).digest(), "little")
    return out


def shingle_hashes(words: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``width`` words; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    factors = _constants(seed)[1]
    total = words[:n] * factors[0]
    for k in range(1, width):
        total += words[k : k + n] * factors[k]
    return mix(total)


def run_hashes(runs: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hash of each row of word hashes, the same as shingle_hashes gives such a run."""
    return mix((runs * _constants(seed)[1][: runs.shape[1]]).sum(axis=1, dtype=_U))


def sequence_hash(words: np.ndarray, seed: int = 1) -> int:
    """Hash of one whole word sequence, apart from those of shingles."""
    h = 0x9E3779B97F4A7C15 ^ len(words)
    for w in mix(words ^ _U(0xD6E8FEB86659FD93)).tolist():
        h = (h * 0x100000001B3 + w) % 2**64
    return h


def text_blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts of about ``limit`` bytes: first row, bytes, offsets.  One long text is a block."""
    raw, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1))
        yield i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def shingle_sets(column: pa.Array, width: int, fold: bool) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer words than ``width`` their
    whole sequence is the one shingle; without words the set is empty."""
    for _, raw, at in text_blocks(column):
        starts, ends, first = word_spans(raw, at)
        words = word_hashes(raw, starts, ends, fold)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                yield np.unique(shingle_hashes(words[a:b], width))
            elif b > a:
                yield np.array([sequence_hash(words[a:b])], _U)
            else:
                yield np.zeros(0, _U)

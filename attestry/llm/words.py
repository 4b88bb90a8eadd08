"""Words of an Arrow text column as arrays: keyed names, positions and document bounds, without a Python loop per word.

A name is a keyed hash whose key is drawn when a job is planned, after its input was written, so no text can be made to
give two words, shingles or windows one name: two different words share a name with a probability of 2**-64, two
different rows of words a `rolling` name with about 2**-59.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import secrets
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Bytes of a word that the multipliers reach; longer words are named by BLAKE2.
REACH = 64
#: Multipliers of one level of `rolling`.
SPAN = 8
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on after its task, beside those of other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A function for mapInArrow that gives memory back when it ends."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return both


def fresh_key() -> int:
    return secrets.randbits(128)


class Key:
    """The multipliers of one job, the same in all its tasks."""

    def __init__(self, key: int):
        rng = np.random.Generator(np.random.Philox(key=key))
        draw = lambda *shape: rng.integers(0, 1 << 64, shape, np.uint64)
        self.secret = key.to_bytes(16, "little")
        self.word = draw(2, 2 + REACH // 4)
        self.roll = draw(2, 8, SPAN) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about `most` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts after each other, and where each begins (one more for the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def word_hashes(texts: pa.Array, key: Key, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name per word in order, and the index of each document's first word (one more for the end).

    Multilinear hashing over the word's length and its 4-byte parts, 32 bits from each of two sums.
    """
    raw, bounds = text_bytes(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    space = _SPACE[raw]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    before |= edge[:-1]
    after |= edge[1:]
    first = np.flatnonzero(~space & before)
    size = np.flatnonzero(~space & after) - first + 1
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[raw] if lower else raw
    eight = np.ndarray(n, "<u8", padded.data, strides=(1,))
    sums = [k[0] + k[1] * size.astype(np.uint64) for k in key.word]
    own: np.ndarray | slice = slice(None)
    for at in range(0, min(REACH, size.max(initial=0)), 8):
        if at:
            own = np.flatnonzero(size > at)
        part = eight[first[own] + at] & _MASK[np.minimum(size[own] - at, 8)]
        low, high = part & _LOW, part >> _HALF
        for total, k in zip(sums, key.word, strict=True):
            total[own] += low * k[2 + at // 4] + high * k[3 + at // 4]
    names = (sums[0] & ~_LOW) | (sums[1] >> _HALF)
    for k in np.flatnonzero(size > REACH).tolist():
        word = padded[first[k] : first[k] + size[k]].tobytes()
        names[k] = int.from_bytes(blake2b(word, digest_size=8, key=key.secret).digest(), "little")
    return names, np.searchsorted(first, bounds)


def rolling(words: np.ndarray, width: int, key: Key, lane: int = 0) -> np.ndarray:
    """A name per run of `width` consecutive words (over document bounds too; callers mask those); lanes are independent."""

    def over(x: np.ndarray, width: int, level: int) -> np.ndarray:
        kept, step = len(x) - width + 1, 1
        if width > SPAN:  # of names of shorter runs, the last of which is drawn back to the end
            step = -(-width // SPAN)
            x = over(x, step, level + 1)
        places = sorted({min(k, width - step) for k in range(0, width, step)})
        total = np.zeros(kept, np.uint64)
        for k, at in zip(key.roll[lane, level], places, strict=False):
            total += k * x[at : at + kept]
        return mix(total)

    if len(words) < width:
        return np.zeros(0, np.uint64)
    return over(words, width, 0)

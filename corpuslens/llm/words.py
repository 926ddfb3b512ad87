"""64-bit hashes of words and of word shingles, computed on Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once; bounds the memory of a task.
BLOCK = 1 << 20
#: Bytes of text of the rows that a task works on at once.
PART = 1 << 22
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_G = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93  # odd, so that its powers can be divided by


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64; ``x`` is left as it is."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def draws(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(_G))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_AS_IS = draws(11, 256)


def _folded() -> np.ndarray:
    table = _AS_IS.copy()
    table[65:91] = _AS_IS[97:123]
    return table


_FOLDED = _folded()


def _hash_block(
    data: np.ndarray, breaks: np.ndarray, letters: np.ndarray, gaps: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of the words of a block; ``breaks`` are places where a text begins."""
    gap = gaps[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    firsts = breaks[breaks < len(data)]
    begins[firsts] = ~gap[firsts]
    ends = ~gap
    ends[:-1] &= gap[1:]
    last = firsts[firsts > 0] - 1
    ends[last] = ~gap[last]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(1 << max(20, int(len(data)).bit_length()))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(letters[data] * up[: len(data)], out=total[1:])
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)), a, b


def _endings(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each word's last three bytes, A to Z lowered, with one closing mark apart."""
    mark = MARKS[data[b - 1]] & (b - a > 1)
    out = np.where(mark, _FOLDED[data[b - 1]], np.uint64(0))
    for k in range(1, 4):
        at = b - mark - k
        out = out * np.uint64(_BASE) + np.where(at >= a, _FOLDED[data[np.maximum(at, 0)]], np.uint64(1))
    return mix(out)


def hashed_words(
    texts: pa.Array, fold: bool = False, gaps: np.ndarray = SPACE, endings: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text's words begin (n + 1 places).

    Words are runs of bytes that are no ``gaps``; ``fold`` lowers A to Z. Nulls
    count as empty; ``endings`` takes arrays of hashes of how the words end. Long texts are cut between words, so memory stays bounded by the
    block and eight bytes a word.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.empty(0, np.uint8)
    letters = _FOLDED if fold else _AS_IS
    hashes, starts, at, stop = [], [], int(offsets[0]), int(offsets[-1])
    while at < stop:
        upto = min(stop, at + BLOCK)
        if upto < stop:
            edge = int(offsets[np.searchsorted(offsets, upto, side="right") - 1])
            if edge > at:
                upto = edge
            else:  # one long text: cut at its last gap in the block, or where it ends
                spaces = np.flatnonzero(gaps[data[at:upto]])
                end = int(offsets[np.searchsorted(offsets, at, side="right")])
                if len(spaces):
                    upto = at + int(spaces[-1]) + 1
                else:
                    while upto < end and not gaps[data[upto]]:
                        upto = min(end, upto + BLOCK)
                        more = np.flatnonzero(gaps[data[at:upto]])
                        if len(more):
                            upto = at + int(more[0]) + 1
                            break
        lo, hi = np.searchsorted(offsets, (at, upto), side="left")
        h, a, b = _hash_block(data[at:upto], (offsets[lo:hi] - at).astype(np.int64), letters, gaps)
        hashes.append(h)
        if endings is not None:
            endings.append(_endings(data[at:upto], a, b))
        starts.append(a + at)
        at = upto
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    places = np.searchsorted(np.concatenate(starts), offsets, side="left")
    return np.concatenate(hashes), places.astype(np.int64)


def shingles(words: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and the text of each.

    A text of fewer than n words, but not none, has one shingle of all its words.
    """
    counts = np.diff(places)
    doc = np.repeat(np.arange(len(counts)), counts)
    room = places[1:][doc] - np.arange(len(words))  # words from here to the end of the text
    factors = draws(29, n) | np.uint64(1)
    out = words * factors[0]
    for k in range(1, n):
        shifted = np.zeros_like(words)
        shifted[: len(words) - k] = words[k:] if k < len(words) else 0
        shifted[room <= k] = 0
        out += shifted * factors[k]
    full = room >= n
    short = (counts[doc] < n) & (room == counts[doc])
    chosen = full | short
    return mix(out[chosen]), doc[chosen]


def slices(places: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``most`` words each."""
    n, at = len(places) - 1, 0
    while at < n:
        to = int(np.searchsorted(places, places[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def parts(batches: Iterable[pa.RecordBatch], *texts: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts of about ``PART`` bytes in the columns ``texts``.

    A batch has thousands of rows, however long; what is computed from a part is bounded
    by it or by one long text.
    """
    for batch in batches:
        ends = np.zeros(len(batch) + 1, np.int64)
        for at in texts:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            ends[1:] += np.cumsum(sizes, dtype=np.int64)
        for lo, hi in slices(ends, PART):
            yield batch.slice(lo, hi - lo)

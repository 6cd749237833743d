"""Vectorised byte, word and shingle hashing shared by the text operators.

Texts are worked on as UTF-8 bytes in chunks of about ``CHUNK`` bytes, so memory stays bounded however many rows an Arrow
batch has. All hashes are 64-bit and depend on content alone, so any task computes the same value for the same string.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

CHUNK = 1 << 19
_U = np.uint64
#: Longest span that is hashed in 8-byte steps beside all others; longer ones are hashed one by one.
_STEPPED = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The low n bytes of a word.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``buf`` on (zeros behind the end) as a little-endian number."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``buf[start:end]``, the same wherever the span stands.

    Eight bytes at a time go through ``mix``, which keeps two strings apart from their first difference on but for chance: no
    sum or product over all bytes is taken, so no family of texts collides.
    """
    size = end - start
    h = mix(size.astype(_U) + _U(0xA24BAED4963EE407))
    word = eights(buf)
    active = np.flatnonzero(size <= _STEPPED)
    at, left, state = start[active], size[active], h[active]
    while len(active):
        go = left > 0
        if not go.all():
            h[active[~go]] = state[~go]
            active, at, left, state = active[go], at[go], left[go], state[go]
        state = mix(state ^ (word[at] & LOW[np.minimum(left, 8)])) + _U(0x9E3779B97F4A7C15)
        at, left = at + 8, left - 8
    long = np.flatnonzero(size > _STEPPED)
    if len(long):
        view = memoryview(np.ascontiguousarray(buf))
        h[long] = mix(np.array([xxh3_64_intdigest(view[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)], _U))
    return h


def classes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each span, equal for equal spans and for no others: found by hash, then compared byte by byte."""
    if not len(start):
        return np.zeros(0, np.int64)
    _, first, which = np.unique(span_hash(buf, start, end), return_index=True, return_inverse=True)
    if not same_as(buf, start, end, first[which]):
        known: dict[bytes, int] = {}
        raw = buf.tobytes()
        return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
    return which


def same_as(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether every span k equals span ``other[k]``."""
    size = end - start
    if (size != size[other]).any():
        return False
    differs = np.flatnonzero(other != np.arange(len(other)))
    size, begin = size[differs], start[differs]
    flat = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return bool((buf[flat] == buf[flat + np.repeat(start[other[differs]] - begin, size)]).all())


class Texts:
    """An Arrow string column as bytes, null as empty, made into Python objects a slice at a time."""

    def __init__(self, column: pa.Array):
        self.column = column
        self.lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()

    def __len__(self) -> int:
        return len(self.lengths)

    def __getitem__(self, part: slice) -> list[bytes]:
        kind = pa.large_binary() if pa.types.is_large_string(self.column.type) else pa.binary()
        return [x or b"" for x in self.column[part].cast(kind).to_pylist()]


def chunks(texts: Texts | list[bytes], limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with at most ``limit`` bytes in all (``CHUNK`` if none is given); a longer text is a run of its own."""
    limit = CHUNK if limit is None else limit
    lengths = texts.lengths if isinstance(texts, Texts) else map(len, texts)
    i = size = 0
    for j, n in enumerate(lengths):
        if j > i and size + n > limit:
            yield i, j
            i, size = j, 0
        size += n + 1
    if i < len(texts):
        yield i, len(texts)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and then freed memory goes back to the system: an idle worker stays beside those of later steps."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by a line feed, and where each begins (one more at the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buf, starts


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs without ASCII white space; ``buf`` ends with white space."""
    solid = ~SPACE[buf]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(solid) and solid[0]:
        edge = np.concatenate(([0], edge))
    return edge[::2], edge[1::2]


def words_of(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts, in order, and the offsets at which each text's words begin (one more at the end).

    A text longer than ``CHUNK`` is cut at white space, so the working memory is that of one chunk (or of one word).
    """
    if len(texts) == 1 and len(texts[0]) > 2 * CHUNK:
        parts, at, text = [], 0, np.frombuffer(texts[0], np.uint8)
        while at < len(text):
            end = min(len(text), at + CHUNK)
            while end < len(text) and not SPACE[text[end]]:
                end += 1
            parts.append(words_of([text[at:end].tobytes()], lower)[0])
            at = end
        h = np.concatenate(parts)
        return h, np.array([0, len(h)])
    buf, starts = joined(texts)
    s, e = word_spans(buf)
    return span_hash(LOWER[buf] if lower else buf, s, e), np.searchsorted(s, starts)


_STEP = mix(np.arange(1, 65, dtype=_U)) | _U(1)


def shingles_of(h: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of ``width`` words, or all words where there are fewer."""
    n = len(h) - width + 1
    run = np.zeros(max(n, 0), _U)
    for j in range(width if n > 0 else 0):
        run += h[j : j + n] * _STEP[j]
    run = mix(run)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.sum(h[a:b] * _STEP[: b - a], dtype=_U, keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out

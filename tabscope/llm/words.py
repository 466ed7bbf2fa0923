"""Words and word shingles of many texts at once, as 64-bit codes in numpy.

A word is a run of bytes other than space and the control characters 9 to 13.
Equal words have equal codes; two different words share a code with a chance
of about 2**-60.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
_WRAP = 1 << 64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit codes one to one, so that all bits depend on all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    same_as = np.arange(256, dtype=np.uint64)
    if lower:
        same_as[0x41:0x5B] += np.uint64(32)
    return mix((same_as + np.uint64(1)) * np.uint64(BASE))


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, grown as needed."""
    if not _powers or len(_powers[0]) < size:
        size = max(size, CHUNK_BYTES + 1)
        _powers[:] = [
            np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, factor % _WRAP, dtype=np.uint64)]))
            for factor in (BASE, pow(BASE, -1, _WRAP))
        ]
    return _powers


def word_codes(texts: list[bytes], lower: bool, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words in order, and where each text's words begin (one more entry than texts).

    ``gaps`` marks the bytes that part words; the end of a line is always one.
    """
    raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    space = gaps[raw]
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(space & ~before)
    power, inverse = _power_tables(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[lower][raw] * power[: len(raw)], out=total[1:])
    codes = (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    places = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return mix(codes), np.searchsorted(starts, places)


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """A code for each run of ``width`` words, by the place of its first word."""
    if len(codes) < width:
        return codes[:0]
    total = np.zeros(len(codes) - width + 1, dtype=np.uint64)
    for place in range(width):
        total = total * np.uint64(BASE) + codes[place : place + len(total)]
    return mix(total + np.uint64(width))


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text, A-Z lower-cased.

    A text with fewer words than ``width`` has its whole sequence as its only
    shingle; one without words has none.
    """
    codes, first = word_codes(texts, lower=True)
    runs = windows(codes, width)
    for start, end in zip(first[:-1], first[1:], strict=True):
        if end - start >= width:
            yield np.unique(runs[start : end - width + 1])
        else:
            yield windows(codes[start:end], int(end - start)) if end > start else codes[:0]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about CHUNK_BYTES together, each with the place of its first."""
    start, size = 0, 0
    for place, text in enumerate(texts):
        size += len(text) + 1
        if size >= CHUNK_BYTES:
            yield start, texts[start : place + 1]
            start, size = place + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def as_bytes(column: pa.Array) -> list[bytes]:
    """Values of a string column in UTF-8; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


_kept: dict[str, object] = {}


def kept(name: str, build: Callable[[str], object]) -> object:
    """What ``build`` makes of ``name``, made once and kept by this Python worker for its next tasks that keep it."""
    if name not in _kept:
        _kept[name] = build(name)
    return _kept[name]


def let_go(keep: str | None = None) -> None:
    """Drop what this Python worker keeps for other work than ``keep``: it lives on from step to step."""
    others = [name for name in _kept if name != keep]
    for name in others:
        del _kept[name]
    if others:
        give_back()


def record_batches(batches: Iterable[pa.RecordBatch], rows: int, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut large batches, so that what is computed from one stays small.

    What earlier tasks kept, but under ``keep``, goes first. What a task freed
    goes back to the system when its last batch is done: the worker lives on,
    and the next task may run in another.
    """
    let_go(keep)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        del batch
    give_back()


def give_back() -> None:
    """Hand free memory of Arrow and of the C library back to the system, where these can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)

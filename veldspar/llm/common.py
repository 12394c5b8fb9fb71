"""What the operators of this subpackage share: vectorised word hashing, and the engine's tables and size-checked joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veldspar.tables import BROADCAST_ROWS, drop_tables, fits, materialise, recorded, shared_dir, sized, table  # noqa: F401

#: Text bytes that one vectorised step holds at a time (a single longer text is taken alone, whole).
STEP_BYTES = 1 << 20

#: What workers of one operator keep between tasks; let go as soon as the worker turns to another operator's rows.
_kept: dict[str, Callable[[], None]] = {}


def let_go(but: str = "") -> None:
    for name in [n for n in _kept if n != but]:
        _kept.pop(name)()


def keep(name: str, release: Callable[[], None]) -> None:
    let_go(name)
    _kept[name] = release


def let(expr, body):
    """body(x) with x bound to expr once: stops the optimiser from inlining expr into a lambda."""
    return F.transform(F.array(expr), body)[0]


# --- vectorised words -------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [
                np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)]).cumprod(dtype=np.uint64)
                for p in (_BASE & (2**64 - 1), pow(_BASE, -1, 2**64))
            ]
    return _powers[0], _powers[1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (bijective); salt selects one of a family."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets of rows in them) over a string column, whole texts, about step bytes at a time; null is empty."""
    let_go()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and len(column) else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, "right")) - 1)
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ([^\\x20\\x09-\\x0D]+), and where each row's words begin (rows + 1 entries)."""
    word = ~_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    cuts = offsets[1:-1][offsets[1:-1] < len(data)]
    begin[cuts] = word[cuts]
    end = word.copy()
    end[:-1] &= ~word[1:]
    cuts = cuts[cuts > 0] - 1
    end[cuts] = word[cuts]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased if asked."""
    power, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64, out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts], 7) + (ends - starts).astype(np.uint64)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of width words, at the run's first word; runs that cross a row's end are the caller's to leave out."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mix(out, k + 11) + hashes[k : k + n] * np.uint64((_BASE * (2 * k + 3)) & (2**64 - 1))
    return mix(out, 3)

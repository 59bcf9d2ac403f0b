"""Numpy kernels over the UTF-8 bytes of Arrow string columns: slices, words and 64-bit hashes of spans."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 18
U64 = np.uint64
_SEED = np.random.Generator(np.random.PCG64(20240607))
#: One random odd number for each byte, and the base of the rolling hash with its inverse modulo 2**64.
BYTE_VALUE = _SEED.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = int(_SEED.integers(0, 1 << 61)) * 8 + 5
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Space and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _powers(base: int) -> np.ndarray:
    out = np.empty(SLICE_BYTES + 1, U64)
    out[0], done = 1, 1
    while done < len(out):
        step = min(done, len(out) - done)
        out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
        done += step
    return out


#: BASE**i and BASE**-i inside a block of SLICE_BYTES.
UP, DOWN = _powers(BASE), _powers(BASE_INVERSE)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that are in order and don't overlap: equal spans have equal hashes.

    The bytes are read in blocks, so that what is held besides the spans has a bound however long the text is.
    """
    out = np.zeros(len(starts), U64)
    for a in range(0, len(data), SLICE_BYTES):
        block = data[a : a + SLICE_BYTES]
        first, last = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, a + len(block)))
        if first >= last:
            continue
        prefix = np.zeros(len(block) + 1, U64)
        np.cumsum(BYTE_VALUE[block] * UP[: len(block)], out=prefix[1:])
        begin, end = np.maximum(starts[first:last] - a, 0), np.minimum(ends[first:last] - a, len(block))
        part = (prefix[end] - prefix[begin]) * DOWN[begin]
        before = a - int(starts[first])
        if before > 0:  # begun in an earlier block
            part[:1] *= U64(pow(BASE, before, 1 << 64))
        out[first:last] += part
    return mix(out)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about limit bytes (one row at least).

    Yields first row, last row + 1, the bytes of these rows one after the other, and each row's offsets in
    them (one more than rows). Nulls count as empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of other bytes than `between` (a table), and of each row its first word (one more than rows)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~between[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all items of the runs (starts, lengths), run after run."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    upto = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (upto - lengths), lengths)


def row_of(firsts: np.ndarray) -> np.ndarray:
    """The row of each item, of the rows' first items (one more than rows)."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


#: Arrow batches between the JVM and Python hold at most so many rows and bytes (one row at least).
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to BATCH_ROWS and BATCH_BYTES: both sides hold a batch and its copy in each task."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(conf.get(key, None)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def give_back() -> None:
    """Return freed memory to the system: at the end of a task, as workers are used again and an executor has several, and on the driver after a fit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def kernel(fields: str, make: Callable[[], Callable], *columns: Column, limit: int = SLICE_BYTES) -> Column:
    """A struct column of the DDL fields, computed by make()'s function over slices of a string column.

    make() runs once in a task and gives a function of (bytes, offsets) of a slice of rows that returns the fields'
    arrays, one item for each row; it also gets these rows of the further columns. Only the columns named go to
    Python and only the fields come back; the rest of a row waits in the JVM.
    """
    kind = T._parse_datatype_string(fields)
    names = kind.names

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        work = make()
        for text, *more in batches:
            parts = [work(data, offsets, *(c.slice(a, b - a) for c in more)) for a, b, data, offsets in slices(text, limit)]
            yield pa.StructArray.from_arrays([pa.chunked_array([pa.array(x) for x in column]).combine_chunks() for column in zip(*parts)], names=names)
            del text, more, parts
        give_back()

    def single(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run((b,) for b in batches)

    # Marked so that no plan evaluates it twice or moves a filter on its result below it.
    return F.arrow_udf(run if len(columns) > 1 else single, kind).asNondeterministic()(*columns)


def append_columns(df: DataFrame, text: str, fields: str, make: Callable[[], Callable], beside: str | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """df with the fields of kernel(fields, make, text, beside) as columns; columns of df with the same names are replaced."""
    names = T._parse_datatype_string(fields).names
    kept = small_batches(df).drop(*names)
    own = [F.col(f"`{c}`") for c in kept.columns]
    wide = kept.select(*own, kernel(fields, make, *(F.col(c) for c in (text, beside) if c), limit=limit).alias("__kernel"))
    return wide.select(*own, *(F.col(f"__kernel.{n}").alias(n) for n in names))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the slice, and the rows' offsets in them; broken bytes count as U+FFFD each."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        points = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        return points, np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=upto[1:])
    return points, upto[offsets]


class Letters:
    """Lower case of letters, 0 for all else, by code point; built once in a process from Python's Unicode tables."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            out = np.zeros(0x110000, np.uint32)
            for c in range(0x110000):
                s = chr(c)
                if s.isalpha():
                    low = s.lower()
                    out[c] = ord(low) if len(low) == 1 else c
            cls.table = out
        return cls.table


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows' items, 0 for rows without."""
    if len(offsets) == 2:  # a long text stands alone
        return np.array([values.sum(dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    upto = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=upto[1:])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def repeats(keys: np.ndarray) -> np.ndarray:
    """Which items equal one that is elsewhere in the array, all but one of each kind."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = ordered[1:] == ordered[:-1]
    return out

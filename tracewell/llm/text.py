"""Flat numpy views of Arrow text columns, shared by the operators of this package.

Inside a task a batch of texts is one UTF-8 buffer; words, their codes and their hashes are arrays over that buffer,
so no Python object exists per word.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: White space of the word pattern [^\x20\x09-\x0D]+ (fixed values).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)



def byte_table(codes: Iterable[int]) -> np.ndarray:
    """Truth of each byte: whether it is one of codes."""
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


_IS_SEPARATOR = byte_table(SEPARATORS)
#: What is no term: all of ASCII but digits and letters.
NO_TERM = byte_table(b for b in range(128) if not chr(b).isalnum())


def once(key: str, make: Callable[[], object]) -> object:
    """make(), kept for the life of this process: tasks that share a Python worker share what is costly to load."""
    held = sys.__dict__.setdefault("_tracewell_once", {})
    if key not in held:
        held[key] = make()
    return held[key]


def plain(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text column with null as the empty text."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def _sizes(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.diff(offsets_of(batch.column(batch.schema.get_field_index(name))))


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if len(texts) == 0 or texts.buffers()[1] is None:
        return np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets from 0) of a text or binary array."""
    offsets = offsets_of(texts)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


#: glibc's number for the size from which memory is mapped by itself, and so goes back when freed (fixed value); and that size.
_M_MMAP_THRESHOLD, _MAPPED = -3, 512 << 10


def tidy() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and several wait side by side on an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_large_arrays() -> None:
    """For the rest of this worker's life large arrays go back to the system when they are freed, which costs time and saves up to a quarter of its memory."""
    once("mapped", lambda: getattr(ctypes.CDLL(None), "mallopt", lambda *_: 0)(_M_MMAP_THRESHOLD, _MAPPED))


def pieces(batches: Iterator[pa.RecordBatch], name: str, most: int = 4 << 20, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about `most` bytes of text (a longer text is a piece by itself) and `rows` rows at most."""
    tidy()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(_sizes(batch, name))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(at, to - at)
            at = to
        del batch
        tidy()


class Words:
    """The words of a text array.

    flat: every word followed by one space; begin: byte offset of each word in flat (one more at the end);
    of: index of each text's first word (one more at the end); codes and unique: dictionary of the words.
    separators: which bytes are between words (the space must be one of them); breaks: which of those end a piece as well, so that
    broken[i] tells whether word i begins a piece or a text.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, separators: np.ndarray = _IS_SEPARATOR, breaks: np.ndarray | None = None):
        texts = pc.binary_join_element_wise(texts, pa.scalar("", texts.type), pa.scalar(" ", texts.type))
        data, offsets = bytes_of(texts)
        apart = separators[data]
        before = np.empty_like(apart)
        before[1:] = apart[:-1]
        before[:1] = True
        begins = ~apart & before
        kept = ~apart
        kept[1:] |= apart[1:] & ~apart[:-1]
        flat = data[kept]
        if lower:
            capital = (flat >= 65) & (flat <= 90)
            flat = np.where(capital, flat + 32, flat).astype(np.uint8)
        ends = np.flatnonzero(separators[flat])
        flat[ends] = 0x20
        self.flat = flat
        self.begin = np.concatenate(([0], ends + 1)).astype(np.int64)
        starts = np.flatnonzero(begins)
        self.of = np.searchsorted(starts, offsets).astype(np.int64)
        if breaks is not None:
            self.broken = np.diff(np.cumsum(breaks[data])[starts], prepend=-1) > 0
            self.broken[self.of[:-1][self.of[:-1] < len(starts)]] = True
        self._codes: np.ndarray | None = None
        self._unique: pa.Array | None = None

    def __len__(self) -> int:
        return len(self.begin) - 1

    def _encode(self) -> None:
        spaced = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.begin), pa.py_buffer(self.flat)])
        coded = spaced.dictionary_encode()
        self._codes, self._unique = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    @property
    def codes(self) -> np.ndarray:
        if self._codes is None:
            self._encode()
        return self._codes

    @property
    def unique(self) -> pa.Array:
        """The distinct words, each with its closing space."""
        if self._unique is None:
            self._encode()
        return self._unique

    def runs(self, first: np.ndarray, words: int | np.ndarray) -> pa.Array:
        """Each run of so many words from word first on, joined by one space."""
        lo, hi = self.begin[first], self.begin[first + words] - 1
        data = self.flat[spans(lo, hi - lo)]
        ends = np.concatenate(([0], np.cumsum(hi - lo))).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        own = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in self.unique.to_pylist()), np.uint64, len(self.unique))
        return own[self.codes] if len(self) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (two multiply and xor-shift rounds)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hash(h: np.ndarray, width: int) -> np.ndarray:
    """out[i]: an order-dependent hash of h[i : i + width]; as long as h, its last width - 1 values have no meaning."""
    base = 0x9E3779B97F4A7C15
    out, done, have, bits = np.zeros_like(h), 0, h.copy(), width
    span = 1
    while bits:
        if bits & 1:
            out = out * np.uint64(pow(base, span, 2**64)) + _ahead(have, done)
            done += span
        bits >>= 1
        if bits:
            have = have * np.uint64(pow(base, span, 2**64)) + _ahead(have, span)
            span *= 2
    return out


def _ahead(x: np.ndarray, by: int, fill: int = 0) -> np.ndarray:
    if by == 0:
        return x
    out = np.full_like(x, fill)
    if by < len(x):
        out[:-by] = x[by:]
    return out


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """out[i]: least of x[i : i + width]; its last width - 1 values have no meaning."""
    most = int(np.iinfo(x.dtype).max) if x.dtype.kind in "iu" else np.inf
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out, _ahead(out, span, most))
        span *= 2
    return np.minimum(out, _ahead(out, width - span, most)) if span < width else out


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of range(f, f + c) over all (f, c)."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total, dtype=np.int64) + np.repeat(first - (ends - count), count)


def _recoded(df: DataFrame, name: str, kind: T.DataType, recode: Callable[[], Callable[[bytes], bytes]], arrow: pa.DataType) -> DataFrame:
    at = df.columns.index(name)
    columns = [f"c{i}" for i in range(len(df.columns))]
    schema = T.StructType([T.StructField(columns[i], kind if i == at else f.dataType) for i, f in enumerate(df.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = recode()
        for batch in pieces(batches, columns[at], 2 << 20):
            own = pa.array([None if x is None else change(x) for x in batch.column(at).cast(pa.binary()).to_pylist()], pa.binary()).cast(arrow)
            yield pa.RecordBatch.from_arrays([own if i == at else c for i, c in enumerate(batch.columns)], columns)

    return df.toDF(*columns).mapInArrow(run, schema).toDF(*df.columns)


def squeezed(df: DataFrame, name: str) -> DataFrame:
    """df with a text column compressed, for a shuffle that carries whole texts; NULL stays NULL."""
    return _recoded(df, name, T.BinaryType(), lambda: zstandard.ZstdCompressor(level=3).compress, pa.binary())


def unsqueezed(df: DataFrame, name: str) -> DataFrame:
    return _recoded(df, name, T.StringType(), lambda: zstandard.ZstdDecompressor().decompress, pa.string())

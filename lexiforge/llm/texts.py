"""Whole texts of Arrow batches as byte arrays; words by byte class, numbered by an Arrow dictionary."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker takes up at a time; a longer text is taken alone.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: All but the space and the five control characters from tab to carriage return.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offs - offs[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def released() -> None:
    """Give freed memory back to the system, so that a reused worker doesn't keep its largest size."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about limit bytes of text each, so that memory follows the limit and not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
            released()


@dataclass
class Words:
    """Words of some rows: codes into words, where each starts and ends in the bytes, and each row's first word."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    words: pa.Array


def split_words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes of a kind, none across two rows. data may be changed to lower case in a copy."""
    n = len(data)
    is_word = kind[data]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    edge = offs[:-1][offs[:-1] < n]
    first[edge] = is_word[edge]
    edge = offs[1:][offs[1:] > offs[:-1]] - 1
    last[edge] = is_word[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    body = data[is_word]
    if lower:
        body = LOWER[body]
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(body)])
    coded = words.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), starts, ends, np.searchsorted(starts, offs), coded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits (the splitmix64 finaliser; its constants are fixed)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array."""
    words = words.cast(pa.large_binary())
    _, offs, data = words.buffers()
    offs = np.frombuffer(offs, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of byte strings, eight bytes at a time for all of them."""
    body, offs = flat(words)
    padded = np.zeros(len(body) + 8, np.uint8)
    padded[: len(body)] = body
    loads = np.ndarray((len(body) + 1,), "<u8", padded, 0, (1,))
    lens = np.diff(offs)
    out = mix(lens.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(lens)), 0
    while len(live := live[lens[live] > at]):
        left = np.minimum(lens[live] - at, 8).astype(np.uint64)
        block = loads[offs[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        out[live] = mix(out[live] * np.uint64(0x9E3779B97F4A7C15) + mix(block + np.uint64(at)))
        at += 8
    return out


def summed(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sum of their weights (or their count)."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    if weights is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(weights, at)

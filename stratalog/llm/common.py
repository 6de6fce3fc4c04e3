"""Helpers that the operators share: written tables, task-side hashing, packed columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import shared_folder

#: Bytes of text that one numpy pass handles; temporaries take about 60 times as much.
SLICE_BYTES = 2_000_000


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, reread: it cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column of at most so many bytes (one row at least): (first row, end row,
    their UTF-8 bytes, row offsets into these). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if column.null_count:
        # a null slot may span bytes: copy the rows that count
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        yield from text_slices(column, most)
        return
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, most: int = 2 * SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of every row, A-Z lowered, and each row's first word (with an end). Longer
    data is worked off in pieces that end between words, so temporaries follow `most` and the longest word; what stays is a number per word."""
    n = len(data)
    if n > most:
        hashes, first, at = [], np.zeros(len(offsets), np.int64), 0
        while at < n:
            end = at + most
            while end < n and not (blank := np.flatnonzero((data[end : end + most] == 32) | ((data[end : end + most] >= 9) & (data[end : end + most] <= 13)))[:1]).size:
                end += most
            end = min(n, end + int(blank[0]) if end < n else n)
            h, own = word_hashes(data[at:end], np.clip(offsets - at, 0, end - at), lower, n)
            hashes.append(h)
            first += own
            at = end
        return np.concatenate(hashes), first
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        data = data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)
    word = (data != 32) & ((data < 9) | (data > 13))
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    starts[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    run = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), dtype=np.uint64)
    h = run[e]
    h[s > 0] -= run[s[s > 0] - 1]
    h *= powers(BASE_INVERSE, n)[s]
    return mix(h + (e - s).astype(np.uint64)), np.searchsorted(s, offsets)


def joined_words(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, drop: np.ndarray | None = None) -> pa.Array:
    """Per row its words (first: each row's first word, with an end) that are not dropped, joined by one space."""
    n = len(data)
    word = (data != 32) & ((data < 9) | (data > 13))
    lead = word.copy()
    lead[1:] &= ~word[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    lead[inner] = word[inner]  # a row's first byte starts a word whatever comes before
    keep = word
    kept = np.arange(first[-1])
    if drop is not None and drop.any():
        keep = word & ~drop[np.maximum(np.cumsum(lead) - 1, 0)]
        kept = np.flatnonzero(~drop)
    rows = np.searchsorted(first, kept, "right") - 1
    tail = np.flatnonzero(word & np.r_[~word[1:] | lead[1:], True]) if n else kept
    space = tail[kept[:-1][rows[1:] == rows[:-1]]] + 1  # after a word that another kept one follows in the row
    out = data.copy()
    out[space] = 32
    keep[space] = True
    to = np.r_[0, np.cumsum(keep)][offsets].astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(to.tobytes()), pa.py_buffer(out[keep].tobytes()))


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per run of rows: (first row, end row, sorted distinct k-word shingle hashes of all rows, row offsets).

    A row of fewer words has its whole sequence as one shingle; one without words has none."""
    for at, end, data, offsets in text_slices(column):
        h, first = word_hashes(data, offsets)
        words = np.diff(first)
        rows = np.repeat(np.arange(end - at), words)
        acc = np.zeros(len(h), np.uint64)
        room = np.repeat(first[1:], words) - np.arange(len(h))  # words from here to the row's end
        for i in range(k):
            m = powers(0xA0761D6478BD642F, k + 2)[i + 1]
            if i < len(h):
                part = h[i:] * m
                acc[: len(part)] += np.where(room[: len(part)] > i, part, np.uint64(0))
        whole = (words[rows] < k) if len(h) else np.zeros(0, bool)
        head = np.zeros(len(h), bool)
        head[first[:-1][words > 0]] = True
        keep = (room >= k) | (whole & head)
        acc = mix(acc + np.where(whole, words[rows], k).astype(np.uint64)) if len(h) else acc
        acc, rows = acc[keep], rows[keep]
        edges = np.searchsorted(rows, np.arange(end - at + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            acc[a:b].sort()
        fresh = np.ones(len(acc), bool)
        if len(acc) > 1:
            fresh[1:] = (acc[1:] != acc[:-1]) | (rows[1:] != rows[:-1])
        acc, rows = acc[fresh], rows[fresh]
        yield at, end, acc, np.searchsorted(rows, np.arange(end - at + 1))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over the runs between offsets; empty runs give 0 (wrapping for unsigned)."""
    run = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=run[1:], dtype=values.dtype)
    return run[offsets[1:]] - run[offsets[:-1]]


def planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers as their low `width` bytes, all first bytes, then all second ones ..., compressed."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(values).to_bytes(4, "little") + bytes([width]) + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unplanes(packed: bytes) -> np.ndarray:
    n, width = int.from_bytes(packed[:4], "little"), packed[4]
    raw = np.frombuffer(pa.decompress(packed[5:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as compressed gaps."""
    gaps = np.diff(values, prepend=np.uint64(0))
    most = int(gaps.max()) if len(gaps) else 0
    return planes(gaps, max(1, (most.bit_length() + 7) // 8))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unplanes(packed), dtype=np.uint64)


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())

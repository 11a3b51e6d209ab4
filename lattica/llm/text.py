"""Vectorised text plumbing that the text operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 4 << 20
U64 = np.uint64


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that each holds ``limit`` bytes of text at most, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The texts, null as empty."""
    return pc.fill_null(batch.column(name).cast(pa.string()), "")


class Words:
    """Words of a piece: ``ids`` into ``vocab`` (UTF-8 bytes), document i having ids[offsets[i]:offsets[i + 1]]."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts) if lower else texts)
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        lens = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        if empty.any():
            flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
            lens = np.where(empty, 0, lens)
        coded = flat.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.strings: pa.Array = coded.dictionary
        self.vocab: list[bytes] = self.strings.cast(pa.binary()).to_pylist()
        self.offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """XXH3 (64 bits) of each word of the vocabulary."""
        return hash_words(self.vocab)


def hash_words(words: Iterable[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def sum_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]]; empty ranges give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    if values.dtype.kind != "f":
        return total[offsets[1:]] - total[offsets[:-1]]
    out = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)

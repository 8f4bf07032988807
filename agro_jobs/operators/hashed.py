"""Counts of hashed words and letters of many texts at a time, the same as Spark ML's HashingTF gives.

Texts come as Arrow buffers and are worked on with numpy, a MB at a time, so no gram becomes a string.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

LETTERS = b" 0123456789:abcdefghijklmnopqrstuvwxyz"  # what clean_text leaves
N = len(LETTERS)
CODE = np.zeros(256, np.int32)
CODE[list(LETTERS)] = np.arange(N)
PLAIN = np.full(256, 32, np.uint8)
PLAIN[list(LETTERS)] = list(LETTERS)
CHUNK_BYTES, CHUNK_BINS, PIECE = 1 << 20, 1 << 20, 1 << 20
SEED = np.uint32(42)  # fixed value: HashingTF's


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _mixed(k: np.ndarray) -> np.ndarray:
    return _rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def _joined(h: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    return _rotated(h ^ mixed, 13) * np.uint32(5) + np.uint32(0xE6546B64)


def _finished(h: np.ndarray, size: np.ndarray, features: int) -> np.ndarray:
    h = h ^ size
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32) % np.int32(features)


@cache
def _tables(features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all runs of three and of four letters, and the hash of the latter before it is finished."""
    x = np.frombuffer(LETTERS, np.uint8).astype(np.uint32)
    three = (x[:, None, None] | x[:, None] << np.uint32(8) | x << np.uint32(16)).ravel()
    four = _joined(np.full(N**4, SEED), _mixed((three[:, None] | x << np.uint32(24)).ravel()))
    return _finished(SEED ^ _mixed(three), np.uint32(3), features), _finished(four, np.uint32(4), features), four


def _letters(data: np.ndarray, row: np.ndarray, features: int) -> Iterator[np.ndarray]:
    """Bins (row * features + bucket) of three to five letters: blanks are only first or last, as each word has one on either side."""
    b3, b4, h4 = _tables(features)
    for a in range(0, max(len(data) - 2, 0), PIECE):
        x, r = data[a : a + PIECE + 4], row[a : a + PIECE].astype(np.int64) * features
        code, letter = CODE[x], x != 32
        i3 = (code[:-2] * N + code[1:-1]) * N + code[2:]
        i4 = i3[:-1] * N + code[3:]
        ok3 = letter[1:-1]
        ok4 = ok3[:-1] & ok3[1:]
        ok5 = ok4[:-1] & ok3[2:]
        for i, ok, bucket in ((i3, ok3, b3.__getitem__), (i4, ok4, b4.__getitem__)):
            at = np.flatnonzero(ok[:PIECE])
            yield r[at] + bucket(i[at])
        at = np.flatnonzero(ok5[:PIECE])
        yield r[at] + _finished(h4[i4[at]] ^ _mixed(x[at + 4].astype(np.uint32)), np.uint32(5), features)


def _words(data: np.ndarray, row: np.ndarray, features: int) -> Iterator[np.ndarray]:
    """Bins of all words and pairs of neighbours."""
    blank = np.flatnonzero(data == 32)
    whole = np.flatnonzero(np.diff(blank) > 1)
    first, after = blank[whole] + 1, blank[whole + 1]
    byte = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    four = byte[:-3] | byte[1:-2] << np.uint32(8) | byte[2:-1] << np.uint32(16) | byte[3:] << np.uint32(24)
    mixed = _mixed(four)
    beside = np.flatnonzero(first[1:] == after[:-1] + 1)  # texts are two blanks apart at least
    for begin, end in ((first, after), (first[beside], after[beside + 1])):
        for a in range(0, len(begin), PIECE):
            at, size = begin[a : a + PIECE], end[a : a + PIECE] - begin[a : a + PIECE]
            longest = np.argsort(-(size >> 2), kind="stable")
            at, size = at[longest], size[longest]
            many, h = np.bincount(size >> 2), np.full(len(at), SEED)
            left = len(at) - np.cumsum(many)  # how many have a further block of four
            for j, n in enumerate(left[:-1]):
                h[:n] = _joined(h[:n], mixed[at[:n] + 4 * j])
            rest = four[at + (size & ~3)] & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], np.uint32)[size & 3]
            yield row[at].astype(np.int64) * features + _finished(h ^ _mixed(rest), size.astype(np.uint32), features)


def _vectors(counts: np.ndarray) -> pa.StructArray:
    """Rows of counts as Spark ML keeps vectors (VectorUDT), each in its shorter form, as it would choose."""
    n, features = counts.shape
    there = counts > 0
    dense = 1.5 * (there.sum(1) + 1.0) >= features
    kept = there | dense[:, None]
    sparse = there & ~dense[:, None]

    def lists(mask: np.ndarray, values: np.ndarray, kind: pa.DataType, null: np.ndarray) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum(mask.sum(1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind), mask=pa.array(null))

    indices = lists(sparse, np.nonzero(sparse)[1].astype(np.int32), pa.int32(), dense)
    values = lists(kept, counts[kept].astype(np.float64), pa.float64(), np.zeros(n, bool))
    size = pa.array(np.full(n, features, np.int32), mask=dense)
    return pa.StructArray.from_arrays([pa.array(dense.astype(np.int8)), size, indices, values], ["type", "size", "indices", "values"])


def _chunks(offsets: np.ndarray, features: int) -> Iterator[tuple[int, int]]:
    """Texts of about a MB together; one text is the smallest unit."""
    a, rows = 0, max(1, CHUNK_BINS // features)
    while a < len(offsets) - 1:
        b = min(max(int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1, a + 1), a + rows, len(offsets) - 1)
        yield a, b
        a = b


def gram_counts(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[pa.RecordBatch]:
    """The batches with n_words, n_chars, tf_words and tf_chars for `_said`: texts in lower case with a blank before and after, cleaned here as clean_text does."""
    for batch in batches:
        said = batch.column("_said").cast(pa.large_string())
        _, at, held = said.buffers()
        at = np.frombuffer(at, np.int64)[said.offset : said.offset + len(said) + 1] if len(said) else np.zeros(1, np.int64)
        held = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
        for a, b in _chunks(at, features):
            data, bins = PLAIN[held[at[a] : at[b]]], (b - a) * features
            before = np.roll(data, 1)
            before[at[a:b] - at[a]] = 0
            kept = (data != 32) | (before != 32)  # one blank of each run
            data, row = data[kept], np.repeat(np.arange(b - a, dtype=np.int32), np.diff(at[a : b + 1]))[kept]
            made = []
            for found in (_words, _letters):
                counts = np.zeros(bins, np.int64)
                for x in found(data, row, features):
                    counts += np.bincount(x, minlength=bins)
                made.append(counts.reshape(b - a, features))
            made[0][np.bincount(row, minlength=b - a) == 1, _finished(np.full(1, SEED), np.uint32(0), features)[0]] += 1  # the one word of an empty text is empty
            part = batch.slice(a, b - a).drop_columns(["_said"])
            totals = [pa.array(x.sum(1).astype(np.int32)) for x in made]
            yield pa.RecordBatch.from_arrays([*part.columns, *totals, *map(_vectors, made)], [*part.schema.names, "n_words", "n_chars", "tf_words", "tf_chars"])

"""Words of UTF-8 texts and their 64-bit hashes, vectorised over a batch of texts.

Used inside tasks on Arrow batches. A batch is worked off in pieces of about
``PIECE_BYTES``, so memory follows the piece (or the longest single text), not
the batch. Hashes are the same on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
# White space of the word pattern [^\x20\x09-\x0D]+.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
# Lower-cases A to Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scramble 64-bit values; different salts give independent results."""
    x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 1)


def pieces(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of the batches in pieces: the rows, the bytes of their texts, and the
    offsets of the texts in them. A null text has no bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffers[2] or b"", np.uint8)
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            low, high = offsets[begin], offsets[end]
            yield batch.slice(begin, end - begin), data[low:high], offsets[begin : end + 1] - low
            begin = end


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``data``, and the number of the text it is in."""
    gap = separators[data]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.empty(len(gap), bool)
    before[1:] = gap[:-1]
    before[filled] = True
    starts = np.flatnonzero(before & ~gap)
    after = np.empty(len(gap), bool)
    after[:-1] = gap[1:]
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    ends = np.flatnonzero(after & ~gap) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER
) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, after ``fold``. Spans are in order
    and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + 4 * PIECE_BYTES, "right")))
        low = starts[begin]
        lengths = (ends[begin:end] - starts[begin:end]).astype(np.int64)
        first = np.cumsum(lengths) - lengths
        place = np.arange(lengths.sum()) - np.repeat(first, lengths)
        values = _BYTE[fold[data[low + place + np.repeat(starts[begin:end] - low, lengths)]]]
        powers = np.multiply.accumulate(
            np.concatenate([[np.uint64(1)], np.full(int(lengths.max()) - 1, _ODD)])
        )
        out[begin:end] = mix(np.add.reduceat(values * powers[place], first), 2)
        begin = end
    return out


def shingles(hashes: np.ndarray, texts: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and their texts. A text of fewer words,
    but not none, gives its whole sequence as one shingle."""
    counts = np.bincount(texts, minlength=n_texts)
    first = np.cumsum(counts) - counts
    total = len(hashes)
    inside = np.arange(total) + size <= np.repeat(first + counts, counts)
    at = np.flatnonzero(inside)
    joined = np.zeros(len(at), np.uint64)
    for i in range(size):
        joined = mix(joined + hashes[at + i], 3)
    owners = texts[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            more = counts[short] > i
            whole[more] = mix(whole[more] + hashes[first[short[more]] + i], 3)
        whole = mix(whole, 4) + counts[short].astype(np.uint64)
        joined, owners = np.concatenate([joined, whole]), np.concatenate([owners, short])
    return joined, owners


def distinct_per_text(values: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once per text, ordered by text and value."""
    order = np.lexsort((values, texts))
    values, texts = values[order], texts[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
    return values[keep], texts[keep]


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of ``counts`` values each."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

"""Texts of an Arrow batch as distinct words, so that what is costly is done once a word, and the rest on whole arrays.

Nothing is remembered from one slice of a batch to the next, so memory is bounded by the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at a time; a longer text is taken by itself.
SLICE_BYTES = 8 * 2**20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut to slices of about SLICE_BYTES of ``column``, nulls in it as empty texts."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        batch = batch.set_column(batch.schema.get_field_index(column), column, texts)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(at, stop - at)
            at = stop
        if not batch.num_rows:
            yield batch


def distinct(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each list begins and the last ends, the number of each value among the distinct ones, and those."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    return offsets - offsets[0], values.indices.to_numpy(), values.dictionary


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``distinct`` of the runs of anything but ASCII white space; one word may be the empty one, which is none."""
    return distinct(pc.ascii_split_whitespace(texts))


def stops_of(sizes: np.ndarray) -> np.ndarray:
    """0 and the running sum: where lists of these sizes begin and end, end to end."""
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))


def gather(flat: np.ndarray, stops: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists that ``index`` names, end to end, and where each stops; list i is flat[stops[i]:stops[i + 1]]."""
    sizes = np.diff(stops)[index]
    ends = stops_of(sizes)
    return flat[np.arange(ends[-1]) + np.repeat(stops[:-1][index] - ends[:-1], sizes)], ends

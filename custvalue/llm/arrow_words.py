"""Words of whole texts by Arrow's own kernels: flat words, and a dictionary of the distinct ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20  # text taken apart at once; a longer text is a piece alone
# Everything in ASCII but digits and small letters parts words (after A-Z are lower-cased).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch``, which has a column ``text``, of about ``limit`` bytes of text each."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and the bounds of each text's words. A null has none."""
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    parts = pc.split_pattern_regex(low, pattern=BETWEEN)
    owner = pc.list_parent_indices(parts)
    words = pc.list_flatten(parts)
    solid = pc.not_equal(pc.binary_length(words), 0)  # texts that begin or end between words
    words, owner = words.filter(solid), owner.filter(solid)
    counts = np.bincount(owner.to_numpy(zero_copy_only=False), minlength=len(texts))
    return words, np.concatenate([[0], np.cumsum(counts)])


def encoded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, each word's place among them, and the bounds of each text's words."""
    words, bounds = flat_words(texts)
    coded = pc.dictionary_encode(words)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds

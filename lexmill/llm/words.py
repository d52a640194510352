"""Words of a column of texts as numbers into a list of distinct words (Arrow and numpy)."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_texts(texts: pa.Array) -> pa.Array:
    """Texts with 64-bit offsets and empty texts for nulls, copied so that the offsets begin at 0:
    Arrow's ascii_lower misreads a slice that was cast."""
    return pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])


def numbered_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word in turn, the distinct words, the number of words of each text).

    Words are what ASCII white space parts; a null text has none."""
    texts = whole_texts(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.not_equal(words, "")
    if not pc.all(filled, min_count=0).as_py():
        text_of = np.repeat(np.arange(len(counts)), counts)[filled.to_numpy(zero_copy_only=False)]
        words, counts = words.filter(filled), np.bincount(text_of, minlength=len(counts))
    encoded = words.dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary, counts


def slices_of(texts: pa.Array, max_bytes: int = 8_000_000):
    """(first, last) of runs of texts of about ``max_bytes``, so that memory stays bounded."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > max_bytes:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def give_back() -> None:
    """Return memory that a batch has freed to the system: Python workers outlive their task, and what they
    keep adds up with what the JVM needs in a later stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass

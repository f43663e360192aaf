"""Texts as lists of chunks, split and numbered in Arrow.

A chunk is what stands between two single spaces.  Tokenizers that never join a
character other than a space with the space after it give each chunk the same
ids wherever it stands, so a batch needs one encoding for each distinct chunk;
ids of whole texts are then gathered by number.  Texts that the caller calls
special (runs of spaces, for instance) bring chunk lists of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text handled at once; a longer text is handled alone
SLICE_BYTES = 2 << 20
#: chunks of more characters are never remembered
LONGEST_KEPT = 200


class Memo(dict):
    """A dictionary that is emptied when its entries hold too many bytes."""

    def __init__(self, most_bytes: int):
        super().__init__()
        self.most, self.held = most_bytes, 0

    def keep(self, key: str, value, n_bytes: int) -> None:
        """Remember ``value`` unless ``key`` is long; ``n_bytes`` is its own size."""
        if len(key) > LONGEST_KEPT:
            return
        self[key] = value
        self.held += n_bytes + 2 * len(key) + 150

    def make_room(self) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of neighbouring rows that hold about ``SLICE_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, n, held = 0, 0, 0
    for size in sizes.tolist():
        if n and held + size > SLICE_BYTES:
            yield at, n
            at, n, held = at + n, 0, 0
        n, held = n + 1, held + size
    if n:
        yield at, n


def numbered(
    texts: pa.Array, special: np.ndarray, split_special: Callable[[str], list[str]]
) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Chunks of each text: offsets by text, a number for each chunk, and the
    distinct chunks by number.  ``texts`` holds no null."""
    plain = pc.split_pattern(texts.filter(pa.array(~special)), " ")
    own = [split_special(t) for t in texts.filter(pa.array(special)).to_pylist()]
    counts = np.zeros(len(texts), np.int64)
    counts[~special] = pc.list_value_length(plain).to_numpy(zero_copy_only=False)
    counts[special] = list(map(len, own))
    flat = pa.concat_arrays([plain.flatten(), pa.array([c for o in own for c in o], pa.string())])
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    if special.any():
        # chunks of plain texts stand first: bring them into the order of the rows
        first = np.zeros(len(texts), np.int64)
        n_plain = int(counts[~special].sum())
        first[~special] = np.cumsum(counts[~special]) - counts[~special]
        first[special] = n_plain + np.cumsum(counts[special]) - counts[special]
        codes = codes[gather(first, counts)]
    return offsets, codes, coded.dictionary.to_pylist()


def gather(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions first[k], first[k] + 1, … (counts[k] of them), for each k in turn."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first - (ends - counts), counts)


def joined(offsets: np.ndarray, codes: np.ndarray, parts: list[str], separator: str) -> pa.Array:
    """For each text the strings of its chunks, joined."""
    rows = pa.LargeListArray.from_arrays(
        pa.array(offsets, pa.int64()), pa.array(parts, pa.large_string()).take(pa.array(codes))
    )
    return pc.binary_join(rows, pa.scalar(separator, pa.large_string()))


def byte_views(strings: pa.Array) -> Iterator[memoryview]:
    """The bytes of each string, without a copy."""
    kind = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, kind)[strings.offset : strings.offset + len(strings) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    for a, b in zip(ends, ends[1:], strict=False):
        yield view[a:b]

"""Word-shingle sets of whole texts as 64-bit hashes, for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_RNG = np.random.default_rng(20240229)
#: A random odd number for each byte value, for each place in a word (by turns) and for each place in a shingle.
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = 1 << 16
_AT = _RNG.integers(0, 2**63, _TURN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Texts are worked on together up to this many bytes; a longer text alone.
_TOGETHER = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hashes(data: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data, and where each text's words begin and end among them; cuts are the texts' offsets."""
    if lower:
        data = _LOWER[data]
    inside = _IN_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]  # a word also ends where its text does
    begins[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(cuts), dtype=np.int64)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    terms = _BYTE[data[inside]] * _AT[place & (_TURN - 1)]
    if int(lengths.max()) > _TURN:
        terms = terms * (np.uint64(2) * (place // _TURN).astype(np.uint64) + np.uint64(1))
    return mixed(np.add.reduceat(terms, first) + lengths.astype(np.uint64)), np.searchsorted(starts, cuts)


def windows(words: np.ndarray, width: int = 5) -> np.ndarray:
    """A hash for each run of `width` words, in order; for fewer words one hash of them all; none without words."""
    n = len(words)
    if n == 0:
        return words
    w = min(width, n)
    acc = np.full(n - w + 1, w, dtype=np.uint64)
    for k in range(w):
        acc += words[k : n - w + 1 + k] * _PLACE[k % len(_PLACE)]
    return mixed(acc)


def word_windows(column: pa.Array | pa.ChunkedArray, width: int = 5, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(words, window hashes in order) of each UTF-8 text of a binary column; words end at ASCII white space.

    lower takes A-Z as a-z. A null text has no words. Words and windows stand for themselves by 64-bit hashes.
    """
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.fill_null(b"") if chunk.null_count else chunk
        kind = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
        offsets = np.frombuffer(chunk.buffers()[1], dtype=kind)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64) if len(chunk) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(chunk.buffers()[2], dtype=np.uint8) if len(chunk) and chunk.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
        lo = 0
        while lo < len(chunk):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _TOGETHER, side="right")) - 1)
            cuts = offsets[lo : hi + 1] - offsets[lo]
            words, at = _word_hashes(data[offsets[lo] : offsets[hi]], cuts, lower)
            all_ = windows(words, width) if len(words) >= width else None
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield b - a, all_[a : b - width + 1] if b - a >= width else windows(words[a:b], width)
            lo = hi


def shingle_sets(column: pa.Array | pa.ChunkedArray, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, h in word_windows(column, width):
        yield np.unique(h)


def set_name(shingles: np.ndarray) -> int:
    """A signed 64-bit name for a whole set; equal sets have equal names."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63

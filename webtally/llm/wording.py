"""Words of texts as 64-bit hashes, worked out on the bytes of many texts at once.

A word is a run of anything but the blanks space and x09 to x0D, with A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

# Odd multipliers of a polynomial over bytes and of a finalising mix.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BLOCK = 1 << 18

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
# Blanks and ASCII punctuation: leaves letters, digits and everything beyond ASCII.
NOT_LETTERS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits, every bit of which depends on all."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""
    global _known_powers
    if len(_known_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        up, down = (np.cumprod(np.full(n, b, np.uint64)) for b in (BASE, inverse))
        _known_powers = (up, down)
    return _known_powers


# First and last characters of scripts that are written without blanks between words
# (Thai and Lao, Burmese, Khmer, kana, Han with its extensions).
WITHOUT_BLANKS = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF),
)


_known_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _around_lone_characters(data: np.ndarray) -> np.ndarray:
    """Marks the bytes before which a character of a script without blanks begins or has ended; one more than the bytes."""
    marks = np.zeros(len(data) + 1, bool)
    for size, lead in ((3, 0xE0), (4, 0xF0)):
        first = np.flatnonzero((data >= lead) & (data < lead + (16 if size == 3 else 8)))
        first = first[first + size <= len(data)]
        code = data[first].astype(np.int64) - lead
        for i in range(1, size):
            code = code << 6 | data[first + i] & 0x3F
        lone = np.zeros(len(first), bool)
        for low, high in WITHOUT_BLANKS:
            lone |= (code >= low) & (code <= high)
        marks[first[lone]] = marks[first[lone] + size] = True
    return marks


def _block_words(
    data: np.ndarray, starts_text: np.ndarray, blank: np.ndarray, stems: Sequence[int], characters: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the words in a block of bytes; ``starts_text`` marks the first byte of each text.

    Longer words are followed by their beginnings of so many bytes as ``stems`` says, as if they were words too.
    """
    inside = ~blank[data]
    before = np.empty_like(inside)
    before[0] = False
    np.logical_and(inside[:-1], ~starts_text[1:], out=before[1:])
    after = np.empty_like(inside)
    after[-1] = False
    np.logical_and(inside[1:], ~starts_text[1:], out=after[:-1])
    if characters:
        marks = _around_lone_characters(data)
        before &= ~marks[:-1]
        after &= ~marks[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * down[start])
    if not stems:
        return hashes, start, end
    parts = [(hashes, start, end)]
    for size in stems:
        longer = start[end - start > size]
        stem = mixed((sums[longer + size] - sums[longer]) * down[longer] + np.uint64(size))
        parts.append((stem, longer, longer + size))
    hashes, start, end = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(start, kind="stable")
    return hashes[order], start[order], end[order]


def words_of(
    texts: pa.Array, blank: np.ndarray = BLANK, stems: Sequence[int] = (), characters: bool = False
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a string column: first row, number of rows, and per word its hash, its row in
    the block and its first byte in the text. NULL counts as empty. Every text is whole in one block.
    ``blank`` says which of the 256 bytes are between words; with ``stems`` the beginnings of longer
    words of so many bytes are given as well. With ``characters``, those of scripts that are written without
    blanks are words of their own."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        bounds = offsets[at : to + 1] - offsets[at]
        size = int(bounds[-1])
        if size == 0:
            empty = np.empty(0, np.int64)
            yield at, to - at, empty.astype(np.uint64), empty, empty
        else:
            block = data[offsets[at] : offsets[to]]
            marks = np.zeros(size + 1, bool)
            marks[bounds[:-1]] = True
            hashes, start, _ = _block_words(block, marks[:-1], blank, stems, characters)
            rows = np.searchsorted(bounds, start, side="right") - 1
            yield at, to - at, hashes, rows, start - bounds[rows]
        at = to


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the runs of each row number 0 to n - 1 in an ascending array."""
    return np.searchsorted(rows, np.arange(n + 1))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, or of all words where there are fewer."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = out * BASE + words[i : len(words) - n + 1 + i]
    return mixed(out)

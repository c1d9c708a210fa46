"""Hashes of the words of whole texts, vectorised over bytes.

A word's hash is a polynomial of its bytes modulo 2^64, finished by a mixing function. A batch is worked through in
blocks of about BLOCK bytes that end between words, so memory does not depend on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_CODE = np.random.default_rng(20240).integers(1, 2**63, 256, dtype=np.uint64)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)
#: ASCII white space, and everything but ASCII letters, digits and non-ASCII bytes.
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, *range(9, 14)]] = True
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, BLOCK + 4096)
        steps = np.full(size, _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps[1:] = pow(_BASE, -1, 2**64)
        _inverse = np.multiply.accumulate(steps)
    return _powers, _inverse


def _block_hashes(data: bytes, separator: np.ndarray, breaks: np.ndarray | None = None, prefixes: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words in lower-cased data, where they begin, and the breaks up to each byte (none: zeros)."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    powers, inverse = _tables(len(raw))
    inside = np.empty(len(raw) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~separator[raw]
    edge = np.diff(inside)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_CODE[raw] * powers[: len(raw)], out=total[1:])
    hashes = mixed((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
    if prefixes:  # a row for each word: the word, and its prefixes or 0
        rows = np.zeros((len(hashes), 1 + len(prefixes)), dtype=np.uint64)
        rows[:, 0] = hashes
        for i, k in enumerate(prefixes, 1):
            longer = stop - start > k
            at = start[longer]
            rows[longer, i] = mixed((total[at + k] - total[at]) * inverse[at] + _U(k << 40))
        hashes, start = rows.ravel(), np.repeat(start, rows.shape[1])
    broken = np.zeros(len(raw) + 1, dtype=np.int64)
    if breaks is not None:
        np.cumsum(breaks[raw], out=broken[1:])
    return hashes, start, broken


def _blocks(data: bytes, separator: np.ndarray) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):  # up to the next separator
            while end < len(data):
                gap = np.flatnonzero(separator[np.frombuffer(data, dtype=np.uint8, count=min(4096, len(data) - end), offset=end)])
                if len(gap):
                    end += int(gap[0])
                    break
                end += 4096
            end = min(end, len(data))
        yield data[at:end]
        at = end


def prefix_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the polynomial's base up to n, and their inverses: run hashes come from sums of products with them."""
    powers, inverse = _tables(n + 1)
    return powers, inverse


def word_spans(data: bytes, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words in data as they are, where they begin and where they end."""
    hashes, starts, at = [], [], 0
    for block in _blocks(data, separator) if len(data) > BLOCK else (data,):
        h, s, _ = _block_hashes(block, separator)
        hashes.append(h)
        starts.append(s + at)
        at += len(block)
    start = np.concatenate(starts)
    gap = np.flatnonzero(np.append(separator[np.frombuffer(data, dtype=np.uint8)], True))
    return np.concatenate(hashes), start, gap[np.searchsorted(gap, start)]


def text_word_hashes(texts: list[str | None], separator: np.ndarray = WHITE) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words after A-Z are lower-cased; an empty array for null."""
    for hashes, _ in text_sentences(texts, separator, None):
        yield hashes


def text_sentences(texts: list[str | None], separator: np.ndarray, breaks: np.ndarray | None, prefixes: Sequence[int] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same, with the number of break bytes that precede each word (its sentence); breaks must be separators.

    With prefixes, each word is followed by the hashes of its first bytes, so many as prefixes says; 0 where the word is no longer.
    """
    group: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode().lower()
        if group and size + len(data) > BLOCK:
            yield from _group_hashes(group, separator, breaks, prefixes)
            group, size = [], 0
        if len(data) > BLOCK:
            parts, before = [], 0
            for block in _blocks(data, separator):
                hashes, start, broken = _block_hashes(block, separator, breaks, prefixes)
                parts.append((hashes, broken[start] + before))
                before += int(broken[-1])
            yield np.concatenate([h for h, _ in parts]), np.concatenate([s for _, s in parts])
        else:
            group.append(data)
            size += len(data) + 1
    if group:
        yield from _group_hashes(group, separator, breaks, prefixes)


def _group_hashes(group: list[bytes], separator: np.ndarray, breaks: np.ndarray | None, prefixes: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    hashes, start, broken = _block_hashes(b" ".join(group), separator, breaks, prefixes)
    begins = np.cumsum([0, *(len(g) + 1 for g in group)])[:-1]
    ends = np.searchsorted(start, begins[1:])
    for own, at, begin in zip(np.split(hashes, ends), np.split(start, ends), begins, strict=True):
        yield own, broken[at] - broken[begin]


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; with fewer words, of the whole sequence."""
    n = min(size, len(words))
    if not n:
        return words
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = mixed(h * _U(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i])
    return np.unique(h)

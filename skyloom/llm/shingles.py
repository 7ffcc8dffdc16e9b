"""Word shingles of whole texts as 64-bit hashes, computed for a batch of texts at a time."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


#: Bytes of text that are hashed at once; longer texts go in segments.
SEGMENT = 1 << 17
_UP, _DOWN = powers(_MUL, SEGMENT + 1), powers(_INV, SEGMENT + 1)


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for n bytes; more than a segment (a few words of that size) are computed and not kept."""
    return (_UP, _DOWN) if n <= len(_UP) else (powers(_MUL, n), powers(_INV, n))


def segments(data: bytes, size: int):
    """A text of words joined by single blanks in overlapping segments, so that each run of `size` words is in one of them."""
    a = 0
    while len(data) - a > SEGMENT:
        width = SEGMENT
        while True:
            end = data.rfind(b" ", a, a + width)
            start = end
            for _ in range(size - 1):  # the next segment begins with the last words of this one
                start = data.rfind(b" ", a, start) if start > a else -1
            if start > a or a + width >= len(data):
                break
            width *= 2  # words longer than that
        if start <= a:
            break
        yield data[a:end]
        a = start + 1
    yield data[a:]


def words_of(text: str | None) -> str:
    """Lower-cased words joined by single blanks; a word is a run of characters that are not white space."""
    return " ".join(text.lower().split()) if text else ""


def shingle_hashes(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of `size` words; a text of 1 to size-1 words is one shingle.

    texts come from words_of(). The hash of bytes i..j is a difference of prefix sums, so all cost is linear in bytes; it
    does not depend on where the bytes stand, so long texts are hashed segment by segment.
    """
    data = [t.encode("utf-8", "replace") for t in texts]
    if sum(map(len, data)) + len(data) > SEGMENT:
        parts = [(i, s) for i, d in enumerate(data) for s in segments(d, size)]
        if len(parts) > 1:
            out, a = [], 0
            while a < len(parts):
                b, total = a, 0
                while b < len(parts) and (b == a or total + len(parts[b][1]) < SEGMENT):
                    total += len(parts[b][1]) + 1
                    b += 1
                doc, h = _hashes([s for _, s in parts[a:b]], size)
                out.append((np.array([i for i, _ in parts[a:b]], np.int64)[doc], h))
                a = b
            return np.concatenate([d for d, _ in out]), np.concatenate([h for _, h in out])
    return _hashes(data, size)


def _hashes(data: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    blob = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    if len(blob) <= 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = tables(len(blob) + 1)
    sums = np.zeros(len(blob) + 1, np.uint64)
    np.cumsum(BYTE[blob] * up[: len(blob)], out=sums[1:])
    lengths = np.array([len(d) for d in data], np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1
    ends = np.flatnonzero(blob == 32)  # the end of each word, or of an empty text
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc = np.searchsorted(first, starts, "right") - 1
    real = ends > starts
    ends, starts, doc = ends[real], starts[real], doc[real]
    n = np.bincount(doc, minlength=len(data))
    offset = np.cumsum(n) - n
    place = np.arange(len(doc)) - offset[doc]
    head = np.flatnonzero((place + size <= n[doc]) | (place == 0) & (n[doc] < size))
    last = np.minimum(head + size, (offset + n)[doc[head]]) - 1
    a, b = starts[head], ends[last]
    return doc[head], mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def multisets(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text index, hash, count), in order of both."""
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    order = np.lexsort((h, doc)) if n > 4096 else np.argsort((doc.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


#: Bytes of words; all other ASCII becomes a blank, so punctuation neither joins nor splits words differently.
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """Lower-cased text with blanks for all ASCII that is neither letter nor digit."""
    return text.lower().encode("utf-8", "replace").translate(PLAIN) if text else b""


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each word of texts from plain(), in order."""
    if sum(map(len, data)) + len(data) <= SEGMENT:
        return _word_hashes(data)
    parts, out, a = [(i, s) for i, d in enumerate(data) for s in segments(d, 1)], [], 0
    while a < len(parts):
        b, total = a, 0
        while b < len(parts) and (b == a or total + len(parts[b][1]) < SEGMENT):
            total += len(parts[b][1]) + 1
            b += 1
        doc, h = _word_hashes([s for _, s in parts[a:b]])
        out.append((np.array([i for i, _ in parts[a:b]], np.int64)[doc], h))
        a = b
    return np.concatenate([d for d, _ in out]), np.concatenate([h for _, h in out])


def _word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    blob = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    up, down = tables(len(blob) + 1)
    sums = np.zeros(len(blob) + 1, np.uint64)
    np.cumsum(BYTE[blob] * up[: len(blob)], out=sums[1:])
    ends = np.flatnonzero(blob == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    real = ends > starts
    a, b = starts[real], ends[real]
    lengths = np.array([len(d) for d in data], np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1
    return np.searchsorted(first, a, "right") - 1, mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))

"""Words and five-word shingles of many texts at once, in numpy; used inside tasks only."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SHINGLE = 5
# White_Space code points.
_SPACES = np.array([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((int(_ODD), pow(int(_ODD), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    starts: np.ndarray  # code point offsets within the concatenation
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # per text: its first word; one more entry ends the last
    offset: np.ndarray  # per text: where it begins in the concatenation
    paragraphs: np.ndarray  # per line with words: its first word


def words_of(texts: list[str]) -> Words:
    """White-space separated words of all texts with 64-bit hashes, without a Python loop over words."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (points == 32) | (points == 10)
    space |= ((points < 14) & (points > 8)) | ((points > 126) & np.isin(points, _SPACES))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(points) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(points) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], dtype=np.uint64)])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    offset = np.cumsum(sizes) - sizes
    line = np.searchsorted(np.flatnonzero(points == 10), starts)
    return Words(starts, ends, hashes, np.searchsorted(starts, np.append(offset, len(points))), offset, np.flatnonzero(np.diff(line, prepend=-1)))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of each run of SHINGLE words; at the last positions the runs cross into what follows."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, SHINGLE):
        out = out * _ODD + words[k : k + n]
    return mix(out)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, text number) of all texts; a text of fewer words than a shingle has all its words as one,
    and a text without words has none."""
    w = words_of(texts)
    counts = np.diff(w.first)
    runs = shingle_hashes(w.hashes)
    of = np.repeat(np.arange(len(texts)), np.maximum(counts - SHINGLE + 1, 0))
    full = counts >= SHINGLE
    n = counts[full] - SHINGLE + 1
    at = np.repeat(w.first[:-1][full] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    hashes = runs[at] if len(at) else np.zeros(0, np.uint64)
    few = np.flatnonzero((counts > 0) & ~full)
    if len(few):
        small = np.array([mix(np.array([int(sum(int(h) * pow(int(_ODD), k, 1 << 64) for k, h in enumerate(w.hashes[w.first[i] : w.first[i + 1]])) + int(counts[i])) & (2**64 - 1)], np.uint64))[0] for i in few], np.uint64)
        hashes, of = np.concatenate([hashes, small]), np.concatenate([of, few])
    return hashes, of


def weighted(hashes: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, text) with their counts, sorted by text; at most 256 texts at a time."""
    assert texts <= 256
    keys = np.sort((of.astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at] << np.uint64(8), (keys[at] >> np.uint64(56)).astype(np.int64), np.diff(np.append(at, len(keys)))


def occurrence_sets(texts: list[str]) -> list[np.ndarray]:
    """Per text the sorted set of (shingle, occurrence number): its Jaccard is the weighted Jaccard of counts."""
    h, of, c = weighted(*shingle_sets(texts), len(texts))
    number = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    items = mix(np.repeat(h, c) + number.astype(np.uint64) * _ODD)
    ends = np.cumsum(np.bincount(np.repeat(of, c), minlength=len(texts)))
    return [np.sort(x) for x in np.split(items, ends[:-1])]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted sets without repeats."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)

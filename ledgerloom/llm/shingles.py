"""Sets of hashed word shingles, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
#: Bytes of text hashed together; longer texts are hashed alone.
GROUP = 1 << 19


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_TURNS = _mixed(np.arange(7, 7 + SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_STEP = 0x5851F42D4C957F2D
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base))]))


_UP, _DOWN = _powers(_STEP, GROUP * 2), _powers(_BACK, GROUP * 2)


def _of_group(texts: list[bytes]) -> list[np.ndarray]:
    up, down = _UP, _DOWN
    buffer = np.frombuffer(b" " + b" ".join(texts).lower() + b" ", np.uint8)
    if len(buffer) >= len(up):
        up, down = _powers(_STEP, len(buffer)), _powers(_BACK, len(buffer))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[buffer] * up[: len(buffer)])])
    space = _SPACE[buffer]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    words = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])  # of each text in the buffer
    bounds = np.searchsorted(starts, first)
    shingles = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        shingles += words[k : k + len(shingles)] * _TURNS[k]
    shingles = _mixed(shingles)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= SHINGLE:
            out.append(np.unique(shingles[lo : hi - SHINGLE + 1]))
        elif hi > lo:
            own = words[lo:hi] * _TURNS[: hi - lo]
            out.append(_mixed(own.sum() + np.array([hi - lo], np.uint64) * _TURNS[SHINGLE:]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text (UTF-8) its distinct hashed shingles, sorted: words are `[^\\x20\\x09-\\x0D]+` with A-Z
    lower-cased; a text of fewer than SHINGLE words is one shingle, one of no words none."""
    group, size = [], 0
    for text in texts:
        group.append(text or b"")
        size += len(group[-1]) + 1
        if size >= GROUP:
            yield from _of_group(group)
            group, size = [], 0
    if group:
        yield from _of_group(group)

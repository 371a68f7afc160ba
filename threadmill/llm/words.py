"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy arrays.

Words are maximal runs of anything but ASCII white space, with A-Z in lower
case.  A word's hash is a polynomial over its bytes modulo 2^64 (from running
sums over the whole batch, so nothing is done word by word), then mixed.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 1
BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE[SPACE] = 0
BYTE[ord("A"):ord("Z") + 1] = BYTE[ord("a"):ord("z") + 1]
STEP = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that are hashed in one go.
BATCH_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, kept: dict) -> tuple[np.ndarray, np.ndarray]:
    if len(kept.get("up", ())) < n:
        size = max(n, BATCH_BYTES + 4096)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                kept[name] = np.cumprod(p)
    return kept["up"], kept["down"]


def runs(values: np.ndarray) -> list[tuple[int, slice]]:
    """(value, its places) of sorted values; the work follows the values, not their range."""
    starts = np.flatnonzero(values[1:] != values[:-1]) + 1
    edges = [0, *starts.tolist(), len(values)]
    return [(int(values[a]), slice(a, b)) for a, b in zip(edges[:-1], edges[1:]) if a < b]


def _with_places(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Sorted 64-bit keys whose lowest bits gave way to their places, and the number of these bits."""
    bits = max(0, len(keys) - 1).bit_length()
    out = keys >> np.uint64(bits) << np.uint64(bits)
    out |= np.arange(len(keys), dtype=np.uint64)
    out.sort()
    return out, bits


def rough_order(keys: np.ndarray) -> np.ndarray:
    """The places of 64-bit keys in ascending order of all but their lowest bits, as many as a place takes.

    Numbers alone are sorted several times as fast as places by their keys.
    """
    out, bits = _with_places(keys)
    return (out & np.uint64((1 << bits) - 1)).astype(np.int64)


def sorted_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of 64-bit keys in ascending order, equal ones in that of their places, and the sorted keys."""
    order = rough_order(keys)
    out = keys.take(order)
    wrong = np.flatnonzero(out[1:] < out[:-1])
    if len(wrong):
        # keys that differ in their lowest bits alone: the few runs of these are sorted anew
        top = out >> np.uint64(max(0, len(keys) - 1).bit_length())
        held = np.unique(top[wrong])
        edge = np.zeros(len(keys) + 1, np.int64)
        edge[np.searchsorted(top, held, "left")] += 1
        edge[np.searchsorted(top, held, "right")] -= 1
        run = np.flatnonzero(np.cumsum(edge[:-1]))
        again = np.argsort(out[run], kind="stable")
        order[run], out[run] = order[run[again]], out[run[again]]
    return order, out


def firsts(values: np.ndarray) -> np.ndarray:
    """The places in ``values`` where another value than the one before starts."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])


def word_hashes(texts: list[bytes], kept: dict) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of ``texts``, and where each text's words start (one more at the end).

    ``kept`` holds tables between calls.
    """
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    up, down = _powers(len(a), kept)
    space = SPACE[a]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    # the byte after each word: there is one, since the buffer ends with a space
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    sums = np.cumsum(BYTE[a] * up[:len(a)])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    h = mix((sums[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place of ``h`` on (for the places where there are as many)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[:len(h) - n + 1] * STEP[0]
    for k in range(1, n):
        out = out + h[k:len(h) - n + 1 + k] * STEP[k]
    return mix(out + np.uint64(n))


def batches(texts: list, size: int = BATCH_BYTES):
    """(first row, list of UTF-8 texts) in runs of about ``size`` bytes; null as empty."""
    start, held, run = 0, 0, []
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "replace") if t else b""
        run.append(b)
        held += len(b) + 1
        if held >= size:
            yield start, run
            start, held, run = i + 1, 0, []
    if run:
        yield start, run


def shingle_sets(texts: list[bytes], n: int, kept: dict):
    """Per text its sorted distinct ``n``-word shingles; a text of fewer words has its whole sequence as one."""
    h, at = word_hashes(texts, kept)
    grams = gram_hashes(h, n)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a:b - n + 1])
        elif b > a:
            yield gram_hashes(h[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)

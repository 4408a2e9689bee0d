"""Minwise hashing of character shingles with banded buckets, vectorised over an Arrow batch."""

from __future__ import annotations

import numpy as np

SHINGLE, BANDS, ROWS, SEED = 3, 64, 5, 20260214


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all shingles of all texts, and where each text's begin. A text shorter than ``k`` is padded."""
    codes = [np.frombuffer(t.encode("utf-32-le", "replace"), "<u4") for t in texts]
    codes = [c if len(c) >= k else np.r_[c, np.zeros(k - len(c), "<u4")] for c in codes]
    sizes = np.array([len(c) for c in codes])
    flat = np.concatenate(codes).astype(np.uint64)
    h = np.zeros(len(flat) - k + 1, np.uint64)
    for j in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[j : len(flat) - k + 1 + j])
    own = np.ones(len(flat), bool)
    ends = np.cumsum(sizes)
    for j in range(1, k):
        own[ends - j] = False
    starts = np.r_[0, np.cumsum(sizes - k + 1)[:-1]]
    return (h[own[: len(h)]] >> np.uint64(32)).astype(np.uint32), starts


def band_keys(texts: list[str], bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> np.ndarray:
    """(texts, bands) 64-bit bucket keys; equal keys mean that ``rows`` minima of one band agree."""
    if not texts:
        return np.zeros((0, bands), np.int64)
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    x, starts = shingle_hashes(texts, k)
    out = np.empty((len(texts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(texts), band + 1, np.uint64)
        for j in range(band * rows, band * rows + rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x * a[j] + b[j], starts))
        out[:, band] = key
    return out.view(np.int64)


def count_sketches(texts: list[str]) -> np.ndarray:
    """64-bit words of the counts of characters hashed into 16 bins, each modulo 16.

    An edit changes two counts by one at most, so two texts within d edits differ by at most 2 d in the sum over bins of
    the circular differences.
    """
    if not texts:
        return np.zeros(0, np.int64)
    h, starts = shingle_hashes(texts, 1)
    row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(h)]))
    counts = np.bincount(row * 16 + (h & np.uint32(15)), minlength=len(starts) * 16).reshape(-1, 16).astype(np.uint64) & np.uint64(15)
    return np.bitwise_or.reduce(counts << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64)


def parity_sketches(texts: list[str], bits: int, k: int) -> np.ndarray:
    """(bits / 64, texts) words of the parities of hashed k-gram counts; ``bits`` is a power of two, 64 at least.

    An edit takes away at most k grams and adds at most k, so two texts within d edits differ in at most 2 k d bits.
    """
    out = np.zeros((bits // 64, len(texts)), np.uint64)
    step = max(1, 2**21 // bits)
    for a in range(0, len(texts), step):
        h, starts = shingle_hashes(texts[a : a + step], k)
        row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(h)]))
        odd = np.bincount(row * bits + (h & np.uint32(bits - 1)), minlength=len(starts) * bits) & 1
        out[:, a : a + len(starts)] = np.packbits(odd.astype(np.uint8).reshape(len(starts), bits), axis=1).view(np.uint64).T
    return out

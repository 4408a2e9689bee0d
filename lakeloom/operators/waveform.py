"""Kernels over sample arrays. Sums and clips are column expressions; filters and mixtures are numpy, batch by batch."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / F.greatest(F.size(x), F.lit(1))


def dbfs(x: Column) -> Column:
    """10 log10 of the mean square, floored at -120."""
    return 10 * F.log10(mean_square(x) + F.lit(1e-12))


def with_gain(x: Column, db: Column, peak: float = 0.99) -> Column:
    """At a gain in dB, and scaled down so that no sample passes ``peak``."""
    gain = F.pow(F.lit(10.0), db / 20)
    top = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double") * gain)))
    scale = F.when(top > peak, peak / top).otherwise(F.lit(1.0))
    return F.transform(x, lambda v: v.cast("double") * gain * scale)


def limited(x: Column) -> Column:
    """Scaled to at most 1."""
    top = F.array_max(F.transform(x, lambda v: F.abs(v)))
    return F.transform(x, lambda v: v * F.least(F.lit(1.0), 1 / F.greatest(top, F.lit(1e-12))))


def active_rms(x: Column) -> Column:
    """Root mean square over the samples that aren't zero."""
    on = F.filter(x, lambda v: v != 0)
    return F.when(F.size(on) > 0, F.sqrt(mean_square(on))).otherwise(0.0)


def direct_to_reverberant_db(x: Column, around: int) -> Column:
    """Energy within ``around`` samples of the largest peak against the rest, in dB."""
    a = F.transform(x, lambda v: F.abs(v))
    at = F.array_position(a, F.array_max(a)).cast("int")
    energy = lambda y: F.aggregate(y, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    first = F.greatest(at - around, F.lit(1))
    direct = energy(F.slice(x, first, at + around - first + 1))
    return 10 * F.log10((direct + 1e-12) / (F.greatest(energy(x) - direct, F.lit(0.0)) + 1e-12))


def sabine_t60(volume: Column, surface: Column, absorption: Column) -> Column:
    return 0.161 * volume / (surface * absorption)


def speed_ratio(factor: float) -> Fraction:
    """A speed as a fraction with a denominator of at most 1000."""
    return Fraction(factor).limit_denominator(1000)


def mono(x: np.ndarray) -> np.ndarray:
    """Channels by samples, averaged."""
    return x.mean(axis=0) if x.ndim == 2 else x


def resampled(x: np.ndarray, ratio: Fraction) -> np.ndarray:
    """Linear interpolation at ``ratio`` times the samples, after a moving average where it shortens."""
    n = int(len(x) * ratio)
    if not n:
        return np.zeros(0)
    if ratio < 1:
        width = max(1, round(float(1 / ratio)))
        x = np.convolve(x, np.ones(width) / width, "same")
    return np.interp(np.arange(n) / float(ratio), np.arange(len(x)), x)


def reverberant(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Convolved by FFT, cut to the length, aligned to the room's peak."""
    n = len(x) + len(room) - 1
    size = 1 << max(0, n - 1).bit_length()
    y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(room, size), size)
    at = int(np.abs(room).argmax()) if len(room) else 0
    return y[at : at + len(x)]


def noise_floor(n: int, level_db: float, kind: str, seed: int) -> np.ndarray:
    """White or pink noise at a level in dBFS."""
    x = np.random.default_rng(seed).standard_normal(n)
    if kind == "pink":
        s = np.fft.rfft(x)
        s[1:] /= np.sqrt(np.arange(1, len(s)))
        x = np.fft.irfft(s, n)
    return x * 10 ** (level_db / 20) / max(np.sqrt((x * x).mean()), 1e-12) if n else x


def telephone(x: np.ndarray, rate: int, mu: float = 255.0) -> np.ndarray:
    """300 to 3400 Hz, companded to 8 bits and back."""
    s = np.fft.rfft(x)
    f = np.fft.rfftfreq(len(x), 1 / rate) if len(x) else np.zeros(0)
    s[(f < 300) | (f > 3400)] = 0
    y = np.clip(np.fft.irfft(s, len(x)), -1, 1)
    c = np.round(np.sign(y) * np.log1p(mu * np.abs(y)) / np.log1p(mu) * 127) / 127
    return np.sign(c) * np.expm1(np.abs(c) * np.log1p(mu)) / mu


def without_digital_silence(x: np.ndarray, frame: int) -> np.ndarray:
    """Frames that are exactly zero are left out."""
    whole = x[: len(x) // frame * frame].reshape(-1, frame)
    return np.r_[whole[np.abs(whole).max(axis=1) > 0].ravel(), x[len(whole) * frame :]] if len(whole) else x


def masked(features: np.ndarray, masks: int, width: int, axis: int, seed: int) -> np.ndarray:
    """``masks`` bands of up to ``width`` set to 0 along an axis."""
    rng, out = np.random.default_rng(seed), features.copy()
    for _ in range(masks):
        w = int(rng.integers(0, width + 1))
        at = int(rng.integers(0, max(1, features.shape[axis] - w + 1)))
        out[(slice(None),) * axis + (slice(at, at + w),)] = 0
    return out


def mixed(target: np.ndarray, others: list[tuple[np.ndarray, int, float]]) -> np.ndarray:
    """The target with others added at a start and a signal-to-interferer ratio in dB, then limited to 0.99."""
    out = target.astype(float).copy()
    rms = lambda x: np.sqrt((x[x != 0] ** 2).mean()) if (x != 0).any() else 0.0
    for x, start, sir in others:
        gain = rms(target) / max(rms(x), 1e-12) * 10 ** (-sir / 20)
        a, b = max(0, start), min(len(out), start + len(x))
        if a < b:
            out[a:b] += gain * x[a - start : b - start]
    top = np.abs(out).max() if len(out) else 0
    return out * min(1.0, 0.99 / top) if top else out


def hop_padded(x: np.ndarray, hop: int) -> np.ndarray:
    return np.r_[x, np.zeros(-len(x) % hop)]


def cropped(x: np.ndarray, start: float, length: int) -> np.ndarray:
    """``length`` samples from the share ``start`` of what can be left over; a shorter signal whole."""
    return x if len(x) <= length else x[(at := int(start * (len(x) - length + 1))) : at + length]


def contaminated(x: np.ndarray, other: np.ndarray, share: float, sir_db: float) -> np.ndarray:
    """An enrolment with a stretch of another voice, ``share`` of its length, over its end at ``sir_db``."""
    n = min(len(other), int(round(share * len(x))))
    return mixed(x, [(other[:n], len(x) - n, sir_db)]) if n else x


def reflected(x: np.ndarray, length: int) -> np.ndarray:
    """Padded to ``length`` samples by reflection; a single sample repeats, an empty signal becomes silence."""
    return x[:length] if len(x) >= length else np.zeros(length) if not len(x) else np.pad(x, (0, length - len(x)), "reflect" if len(x) > 1 else "edge")


def placed_in_rooms(voices: list[np.ndarray], rooms: list[np.ndarray], levels_db: list[float], starts: list[int], snr_db: float, seed: int, peak: float = 0.99) -> np.ndarray:
    """A meeting: each voice in its room at its level and start, noise at ``snr_db`` below all of it, limited to ``peak``."""
    wet = [reverberant(v, r) for v, r in zip(voices, rooms)]
    n = max((s + len(w) for s, w in zip(starts, wet)), default=0)
    out = np.zeros(n)
    for w, db, s in zip(wet, levels_db, starts):
        rms = np.sqrt((w * w).mean()) if len(w) else 0.0
        out[s : s + len(w)] += w * (10 ** (db / 20) / rms if rms > 0 else 0.0)
    if n:
        power = 10 * np.log10((out * out).mean() + 1e-12)
        out = out + noise_floor(n, power - snr_db, "white", seed)
        top = np.abs(out).max()
        out = out * (peak / top) if top > peak else out
    return out

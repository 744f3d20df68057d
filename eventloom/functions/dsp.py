"""Small numpy helpers for channels' samples: one series, or many of one length as rows, worked on along the last axis."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np


def padded(x: np.ndarray, n: int) -> np.ndarray:
    """The series with n samples on either side, turned about its end values."""
    n = min(n, x.shape[-1] - 1)
    return np.concatenate((2 * x[..., :1] - x[..., n:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -n - 2 : -1]), axis=-1) if n > 0 else x


def convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """x through a symmetric filter of odd length, zeros beyond the ends."""
    half = len(taps) // 2
    wide = np.concatenate((np.zeros((*x.shape[:-1], half)), x, np.zeros((*x.shape[:-1], half))), axis=-1)
    return np.lib.stride_tricks.sliding_window_view(wide, len(taps), axis=-1) @ taps


def zero_phase(x: np.ndarray, fs: float, gain) -> np.ndarray:
    """x through a filter forth and back: the spectrum times the squared magnitude gain(f), with turned ends."""
    n = min(x.shape[-1] - 1, max(int(fs), 3 * 64))
    p = padded(x, n)
    size = p.shape[-1]
    return np.fft.irfft(np.fft.rfft(p) * gain(np.fft.rfftfreq(size, 1 / fs)) ** 2, size)[..., n : n + x.shape[-1]]


def _warp(f, fs):
    return np.tan(np.pi * np.minimum(np.asarray(f, float), fs / 2 * 0.999999) / fs)


def low_pass(cut: float, fs: float, order: int = 4):
    """Magnitude of a Butterworth low-pass."""
    return lambda f: 1 / np.sqrt(1 + (_warp(f, fs) / _warp(cut, fs)) ** (2 * order))


def high_pass(cut: float, fs: float, order: int = 4):
    """Magnitude of a Butterworth high-pass."""
    return lambda f: 1 / np.sqrt(1 + (_warp(cut, fs) / np.maximum(_warp(f, fs), 1e-12)) ** (2 * order))


def low_pass_steep(cut: float, fs: float, order: int = 8, ripple_db: float = 60):
    """Magnitude of a Chebyshev low-pass of the second kind whose stop band begins at cut."""
    eps = 1 / math.sqrt(10 ** (ripple_db / 10) - 1)

    def gain(f):
        x = _warp(cut, fs) / np.maximum(_warp(f, fs), 1e-12)
        t = np.where(x <= 1, np.cos(order * np.arccos(np.minimum(x, 1))), np.cosh(order * np.arccosh(np.maximum(x, 1))))
        return 1 / np.sqrt(1 + 1 / (eps * eps * np.maximum(t * t, 1e-300)))

    return gain


def band_pass(low: float, high: float, fs: float):
    """Magnitude of a band-pass: a high-pass, and a steep low-pass at 200 Hz sampling or under, else a Butterworth one."""
    a, b = high_pass(low, fs), low_pass_steep(high, fs) if fs <= 200 else low_pass(high, fs)
    return lambda f: a(f) * b(f)


def notch(base: float, fs: float, width: float = 1.0):
    """Magnitude of notches at a mains frequency and its multiples."""
    every = np.arange(base, fs / 2, base)

    def gain(f):
        out = np.ones(len(np.atleast_1d(f)))
        for m in every:
            d = np.asarray(f) ** 2 - m * m
            out *= np.abs(d) / np.sqrt(d * d + (width * np.asarray(f)) ** 2 + 1e-30)
        return out

    return gain


def envelope(x: np.ndarray) -> np.ndarray:
    """The magnitude of the analytic signal."""
    n = x.shape[-1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h))


def median_filter(x: np.ndarray, k: int) -> np.ndarray:
    """Running median of k (odd) samples, zeros beyond the ends."""
    if k % 2 == 0:
        raise ValueError("the median's length is odd")
    wide = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(k // 2, k // 2)])
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, k, axis=-1), axis=-1) if k > 1 else x


def decimate(x: np.ndarray, factor: int) -> np.ndarray:
    """Every factor-th sample after a windowed-sinc low-pass of linear phase."""
    half = 10 * factor
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / factor) * np.hamming(2 * half + 1)
    p = padded(x, half)
    pad = (p.shape[-1] - x.shape[-1]) // 2
    return convolved(p, taps / taps.sum())[..., pad : pad + x.shape[-1]][..., ::factor]


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up / down times its rate: zeros put between, a sinc low-pass under a Kaiser window, every down-th sample; zeros beyond the ends.

    Every up-th result meets the same taps, `down` samples further on; the zeros between are not made.
    """
    if up == down:
        return x
    most = max(up, down)
    half = 10 * most
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / most) * np.kaiser(2 * half + 1, 5.0)
    taps = up * taps / taps.sum()
    n = x.shape[-1]
    y = np.empty((*x.shape[:-1], -(-n * up // down)))
    side = half // up + 1
    wide = np.concatenate((np.zeros((*x.shape[:-1], side)), x, np.zeros((*x.shape[:-1], side + down))), axis=-1)
    for phase in range(min(up, y.shape[-1])):
        middle, off = divmod(phase * down, up)
        at = off + half - up * np.arange(-side, side + 1)  # the taps of the samples from `side` before the middle to `side` after it
        part = np.where((at >= 0) & (at <= 2 * half), taps[np.clip(at, 0, 2 * half)], 0.0)
        many = -(-(y.shape[-1] - phase) // up)
        y[..., phase::up] = np.lib.stride_tricks.sliding_window_view(wide, 2 * side + 1, axis=-1)[..., middle::down, :][..., :many, :] @ part
    return y


def resampled(x: np.ndarray, fs: float, to: float) -> tuple[np.ndarray, float]:
    """(x, rate) at another rate, in as many steps of equal ratio as the whole ratio has powers of ten, each a ratio of whole numbers."""
    steps = max(math.ceil(math.log10(fs / to)), 1) if fs > to else 1
    ratio = (fs / to) ** (1 / steps)
    for i in range(steps):
        after = to if i == steps - 1 else round(fs / ratio) or fs / ratio
        part = Fraction(after / fs).limit_denominator(10_000)
        x, fs = resample(x, part.numerator, part.denominator), after
    return x, float(fs)


def smoothed(x: np.ndarray, width: int) -> np.ndarray:
    """A running mean of `width` values forth and back, with turned ends."""
    box = np.ones(width) / width
    p = padded(x, 3 * width)
    pad = (p.shape[-1] - x.shape[-1]) // 2
    return convolved(p, np.convolve(box, box))[..., pad : pad + x.shape[-1]]


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through points whose first two pieces, and last two, are one cubic; a line or parabola for two or three points."""
    n, y = len(x), np.asarray(y)
    if n < 4:
        return (np.vander(at - x[0], n) @ np.polyfit(x - x[0], y.T, n - 1)).T
    h = np.diff(x)
    a, r = np.zeros((n, n)), np.zeros((n, *y.shape[:-1]))  # for the second derivatives at the points
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        r[k] = 6 * ((y[..., k + 1] - y[..., k]) / h[k] - (y[..., k] - y[..., k - 1]) / h[k - 1])
    a[0, :3], a[-1, -3:] = (h[1], -h[0] - h[1], h[0]), (h[-1], -h[-2] - h[-1], h[-2])
    m = np.moveaxis(np.linalg.solve(a, r), 0, -1)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    left, right = at - x[k], x[k + 1] - at
    return (m[..., k] * right**3 + m[..., k + 1] * left**3) / (6 * h[k]) + (y[..., k] / h[k] - m[..., k] * h[k] / 6) * right + (y[..., k + 1] / h[k] - m[..., k + 1] * h[k] / 6) * left


def background(env: np.ndarray, window: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread (ddof 1) of the log envelope by window, smoothed over neighbouring windows and drawn out to every sample by a spline, level before the first window's middle and after the last's."""
    log = np.log(np.maximum(env, 1e-12))
    size = log.shape[-1]
    starts = np.arange(0, max(size - window, 0) + 1, step)
    parts = [log[..., a : a + window] for a in starts]
    both = [np.stack([p.mean(-1) for p in parts], -1), np.stack([p.std(-1, ddof=1) if p.shape[-1] > 1 else p[..., 0] * 0 for p in parts], -1)]
    width = round(window / (size / len(starts)))
    if width > 1 and len(starts) > 3 * width:
        both = [smoothed(x, width) for x in both]
    middle = starts + window / 2
    at = np.clip(np.arange(size), middle[0], middle[-1])
    mean, spread = (spline(middle, x, at) if len(starts) > 1 else np.broadcast_to(x, log.shape) for x in both)
    return mean, np.maximum(spread, 0.0)


def threshold(mean: np.ndarray, spread: np.ndarray, k1: float, k3: float = 0.0) -> np.ndarray:
    """k1 (mode + median) - k3 (mean - mode) of the lognormal background."""
    mode, median, average = np.exp(mean - spread**2), np.exp(mean), np.exp(mean + spread**2 / 2)
    return k1 * (mode + median) - k3 * (average - mode)


def maxima(env: np.ndarray, bound: np.ndarray, join: int) -> np.ndarray:
    """One mark for each run above the bound, runs closer than `join` samples united, at the run's highest point, the first of equal ones."""
    return maxima_of_rows(env[None], bound[None], join)[1]


def maxima_of_rows(env: np.ndarray, bound: np.ndarray, join: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places) of the same marks of many series."""
    row, at = np.nonzero(env > bound)
    if not len(row):
        return row, at
    first = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(at) > join))))
    last = np.concatenate((first[1:], [len(row)])) - 1
    size = at[last] - at[first] + 1
    begin = np.cumsum(size) - size
    run = np.repeat(np.arange(len(first)), size)
    place = np.arange(len(run)) - begin[run] + at[first][run]
    value = env[row[first][run], place]
    highest = np.flatnonzero(value == np.maximum.reduceat(value, begin)[run])
    highest = highest[np.unique(run[highest], return_index=True)[1]]
    return row[first], place[highest]


def lognormal_weight(value: float, mean: float, spread: float) -> tuple[float, float]:
    """Distribution and density of a lognormal background at a value."""
    if spread <= 0 or value <= 0:
        return (1.0 if value > math.exp(mean) else 0.0), 0.0
    z = (math.log(value) - mean) / spread
    return 0.5 * (1 + math.erf(z / math.sqrt(2))), math.exp(-z * z / 2) / (value * spread * math.sqrt(2 * math.pi))


def autoregression(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and noise power by Levinson's recursion on the autocorrelation."""
    x = x - x.mean(-1, keepdims=True)
    n = x.shape[-1]
    r = np.stack([np.einsum("...i,...i->...", x[..., : n - k], x[..., k:]) for k in range(order + 1)], -1) / n
    a, e = np.zeros((*x.shape[:-1], order)), r[..., 0]
    for k in range(order):
        left = np.where(e > 0, e, 1.0)
        reflect = np.where(e > 0, (r[..., k + 1] - np.einsum("...i,...i->...", a[..., :k], r[..., k:0:-1])) / left, 0.0)[..., None]
        a[..., : k + 1] = np.concatenate((a[..., :k] - reflect * a[..., :k][..., ::-1], reflect), -1)
        e = e * (1 - reflect[..., 0] ** 2)
    return a, e


def rhythm_peak(x: np.ndarray, fs: float, order: int = 12) -> np.ndarray:
    """The frequency of the highest peak of the autoregressive spectrum."""
    a, _ = autoregression(x, min(order, x.shape[-1] - 1))
    f = np.linspace(0, fs / 2, 513)
    waves = np.exp(-2j * np.pi * np.outer(f / fs, np.arange(1, a.shape[-1] + 1)))
    return f[(1 / np.abs(1 - a @ waves.T) ** 2).argmax(-1)]


def density(x: np.ndarray, fs: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided power density): the mean over half-overlapping Hann windows, means removed."""
    window = min(window, len(x))
    w = np.hanning(window + 1)[:-1]
    parts = [x[a : a + window] for a in range(0, len(x) - window + 1, max(window // 2, 1))]
    p = np.mean([np.abs(np.fft.rfft((s - s.mean()) * w)) ** 2 for s in parts], axis=0) / (fs * (w**2).sum())
    p[1 : -1 if window % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(window, 1 / fs), p


def detect(x: np.ndarray, fs: float, low: float, high: float, window: int, step: int, k1: float, k3: float, join: int, mains: float | None = None, k2: float | None = None) -> list[tuple[int, float, float, float, float]]:
    """(sample, envelope, weight, density, confidence) of each mark of the envelope detector on one channel's buffer: confidence 1 over the threshold of k1, and 0.5 for other marks over that of k2, a lower one."""
    return detect_rows(np.asarray(x)[None], fs, low, high, window, step, k1, k3, join, mains, k2)[0]


def detect_rows(x: np.ndarray, fs: float, low: float, high: float, window: int, step: int, k1: float, k3: float, join: int, mains: float | None = None, k2: float | None = None) -> list[list[tuple[int, float, float, float, float]]]:
    """The same marks of many buffers of one length, a list a row."""
    if x.shape[-1] < 8:
        return [[] for _ in x]
    if mains:
        x = zero_phase(x, fs, notch(mains, fs))
    env = envelope(zero_phase(x, fs, band_pass(low, high, fs)))
    mean, spread = background(env, min(window, x.shape[-1]), step)
    found: list[dict] = [{} for _ in x]
    for k, con in ((k2, 0.5), (k1, 1.0)):
        if con == 1 or (k is not None and k != k1):
            for row, i in zip(*(v.tolist() for v in maxima_of_rows(env, threshold(mean, spread, k, k3), join))):
                found[row][i] = con
    return [[(i, float(env[n, i]), *lognormal_weight(float(env[n, i]), float(mean[n, i]), float(spread[n, i])), con) for i, con in sorted(marks.items())] for n, marks in enumerate(found)]

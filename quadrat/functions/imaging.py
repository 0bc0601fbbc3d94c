"""Sensor-noise extraction and comparison of images, as NumPy kernels.

Images are float64 matrices h x w. Each kernel is pure.
"""

from __future__ import annotations

import numpy as np

#: Weights of red, green and blue in luminance.
_LUMA = {"R": 0.299, "G": 0.587, "B": 0.114}


def grayscale(data: bytes, h: int, w: int, order: str = "BGR") -> np.ndarray:
    """Luminance of packed 3-byte pixels. Spark's image source delivers BGR."""
    px = np.frombuffer(data, np.uint8).reshape(h, w, 3).astype(float)
    return sum(_LUMA[c] * px[:, :, k] for k, c in enumerate(order))


def difference(a: np.ndarray, axis: int) -> np.ndarray:
    """Centred differences inside, one-sided ones at the borders; 0 along an axis of one."""
    return np.gradient(a, axis=axis) if a.shape[axis] > 1 else np.zeros_like(a)


def gradient(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dx, dy), each divided by 1 + the gradient's length."""
    dx, dy = difference(a, 1), difference(a, 0)
    scale = 1 / (1 + np.hypot(dx, dy))
    return dx * scale, dy * scale


def noise(a: np.ndarray) -> np.ndarray:
    """First step of total-variation denoising: the divergence of the scaled gradient."""
    dx, dy = gradient(a)
    return difference(dx, 1) + difference(dy, 0)


def zero_mean(a: np.ndarray) -> np.ndarray:
    """Subtract the means of the even and of the odd rows of each column, then likewise for rows."""
    a = a.copy()
    for axis in (0, 1):
        for parity in (0, 1):
            part = a[parity::2] if axis == 0 else a[:, parity::2]
            if part.size:
                part -= part.mean(axis=axis, keepdims=True)
    return a


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Mean over a size x size box with zeros beyond the border, by running sums."""
    r = size // 2
    s = np.zeros((a.shape[0] + size, a.shape[1] + size))
    s[r + 1 : r + 1 + a.shape[0], r + 1 : r + 1 + a.shape[1]] = a
    s = s.cumsum(0).cumsum(1)
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / (size * size)


def power(a: np.ndarray) -> np.ndarray:
    f = np.fft.fft2(a)
    return f.real**2 + f.imag**2


def local_variance(p: np.ndarray) -> np.ndarray:
    """Smallest of the box means of 3, 5, 7 and 9."""
    return np.minimum.reduce([box_mean(p, k) for k in (3, 5, 7, 9)])


def global_variance(a: np.ndarray) -> float:
    """sum of squares times n / (n - 1)."""
    n = a.size
    return float((a * a).sum() * n / (n - 1)) if n > 1 else 0.0


def wiener(a: np.ndarray) -> np.ndarray:
    f = np.fft.fft2(a)
    g = global_variance(a)
    v = np.maximum(g, local_variance(f.real**2 + f.imag**2))
    return np.fft.ifft2(f * np.divide(g, v, out=np.zeros_like(v), where=v > 0)).real


def spectrum(a: np.ndarray) -> np.ndarray:
    """Half spectrum, h x (w // 2 + 1), not normalised."""
    return np.fft.rfft2(a)


def pattern(gray: np.ndarray) -> np.ndarray:
    """The noise pattern of a grayscale image: noise, zero mean, Wiener filter."""
    return wiener(zero_mean(noise(gray)))


def packed_spectrum(a: np.ndarray) -> np.ndarray:
    """The half spectrum as one vector of real and imaginary parts in turn; made once an image, compared many times."""
    return spectrum(a).ravel().view(np.float64)


def correlated(fx: np.ndarray, fy: np.ndarray, w: int, mirror: str = "hermitian") -> np.ndarray:
    """Circular cross-correlations by conj(X) Y of half spectra ... x h x (w // 2 + 1).

    mirror="row" completes the right half of the product from column w - j of the
    same row, as X conj(Y), instead of from the Hermitian symmetry.
    """
    c = np.conj(fx) * fy
    if mirror == "row":
        rest = np.conj(c[..., 1 : (w + 1) // 2][..., ::-1])
        return np.fft.ifft2(np.concatenate([c, rest], -1)).real
    return np.fft.irfft2(c, (c.shape[-2], w))


def cross_correlation(x: np.ndarray, y: np.ndarray, mirror: str = "hermitian") -> np.ndarray:
    return correlated(spectrum(x), spectrum(y), x.shape[1], mirror)


def peak_energy(c: np.ndarray, peak: str = "max") -> float:
    """Peak to correlation energy: squared peak over the mean energy beyond the 9 x 9 around the peak.

    peak="max" takes the value of greatest magnitude, peak="last" the last element.
    NaN for images of at most 121 pixels, whose energy has no positive divisor.
    """
    h, w = c.shape
    if h * w <= 121:
        return float("nan")
    py, px = np.unravel_index(int(np.abs(c).argmax()), c.shape)
    far = c * c
    far[max(py - 4, 0) : py + 5, max(px - 4, 0) : px + 5] = 0
    energy = float(far.sum()) / (w * h - 121)
    value = c[py, px] if peak == "max" else c[-1, -1]
    return float(value * value / energy) if energy else float("nan")


def pce(x: np.ndarray, y: np.ndarray, peak: str = "max", mirror: str = "hermitian") -> float:
    return peak_energy(cross_correlation(x, y, mirror), peak)


def _halves(packed: object, h: int, w: int) -> np.ndarray:
    return np.ascontiguousarray(packed, np.float64).view(np.complex128).reshape(-1, h, w // 2 + 1)


def pce_block(h: int, w: int, peak: str = "max", mirror: str = "hermitian"):
    """A block function over packed spectra."""

    def block(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        fy = _halves(ys, h, w)
        out = [[peak_energy(c, peak) for c in correlated(fx, fy[k : k + 64], w, mirror)] for fx in _halves(xs, h, w) for k in range(0, len(fy), 64)]
        return np.array([v for row in out for v in row]).reshape(len(xs), len(ys))

    return block


def ncc_block(xs: list, ys: list) -> np.ndarray:
    """Normalised cross-correlations of all rows of two blocks; sums as they are, without 1/n."""
    a, b = np.array(xs, float), np.array(ys, float)
    with np.errstate(invalid="ignore", divide="ignore"):
        da = np.sqrt((a * a).sum(1) - a.sum(1) ** 2)
        db = np.sqrt((b * b).sum(1) - b.sum(1) ** 2)
        return (a @ b.T) / da[:, None] / db[None, :]


def dot_block(xs: list, ys: list) -> np.ndarray:
    return np.array(xs, float) @ np.array(ys, float).T


def cosine_block(xs: list, ys: list) -> np.ndarray:
    """Cosines; NaN where a vector is zero."""
    a, b = np.array(xs, float), np.array(ys, float)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (a @ b.T) / np.sqrt((a * a).sum(1))[:, None] / np.sqrt((b * b).sum(1))[None, :]


def rounded(a: np.ndarray, digits: int) -> np.ndarray:
    """Rounded half away from zero, as SQL does; no negative zero. NaN and infinities stay."""
    scale = 10.0**digits
    with np.errstate(invalid="ignore", over="ignore"):
        x = a * scale
        r = np.rint(x)
        x -= r
        tie = (x == 0.5) & (a > 0) | (x == -0.5) & (a < 0)
        if tie.any():
            r[tie] += 2 * x[tie]
        r /= scale
    r += 0.0
    finite = np.isfinite(r)
    return r if finite.all() else np.where(finite, r, a)

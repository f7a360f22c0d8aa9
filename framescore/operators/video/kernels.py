"""Pixel kernels on NumPy arrays: one frame or one pair of frames in, scalars out."""

from __future__ import annotations

import numpy as np


def to_gray(rgb: np.ndarray) -> np.ndarray:
    """Gray 0..1 of (H, W, 3) in 0..1: weights .299, .587, .114 on values truncated to 8 bits, rounded."""
    u = (rgb * 255).astype(np.uint8).astype(np.float64)
    return np.floor(u @ np.array([0.299, 0.587, 0.114]) + 0.5) / 255


def laplacian_variance(gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian of 8-bit values; borders mirror without repeating the edge."""
    u = np.floor(gray * 255).astype(np.float64)
    mode = "reflect" if min(u.shape) > 1 else "edge"
    p = np.pad(u, 1, mode=mode)
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * u).var())


def blobs(mask: np.ndarray, min_area: int) -> int:
    """8-connected components of at least ``min_area`` pixels: labels spread to the smallest of the neighbours and jump
    to their label's label until nothing changes."""
    if not mask.any():
        return 0
    h, w = mask.shape
    own = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:
        p = np.pad(own, 1, constant_values=h * w)
        low = np.minimum.reduce([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        low = np.where(mask, low, h * w)
        jump = np.append(low.ravel(), h * w)[low]
        if (jump == own).all():
            break
        own = jump
    return int((np.bincount(own[mask]) >= min_area).sum())


def moving(a: np.ndarray, b: np.ndarray, min_area: int = 32) -> tuple[int, float, float, str]:
    """(blobs, x, y, how) of the change from a to b: how is "still", "few" (under five pixels) or "moved"."""
    d = np.abs(b - a)
    if d.max() < 1e-3:
        return 0, np.nan, np.nan, "still"
    mask = d > d.mean() + d.std()
    ys, xs = np.nonzero(mask)
    n = blobs(mask, min_area)
    return (n, np.nan, np.nan, "few") if len(xs) < 5 else (n, float(xs.mean()), float(ys.mean()), "moved")


def pair_indices(n_pixels: int, n_pairs: int = 256, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, n_pixels, size=n_pairs), rng.integers(0, n_pixels, size=n_pairs)


def gaussian(gray: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur, kernel max(3, int(6 sigma) | 1), mirrored borders."""
    k = max(3, int(6 * sigma) | 1)
    x = np.arange(k) - k // 2
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()
    out = gray
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (k // 2, k // 2)
        p = np.pad(out, pad, mode="reflect" if out.shape[axis] > 1 else "edge")
        out = sum(g[i] * np.take(p, range(i, i + out.shape[axis]), axis) for i in range(k))
    return out


def ssim(a: np.ndarray, b: np.ndarray, win: int = 7) -> float | None:
    """Mean structural similarity with a uniform window and sample covariance, range 1; null for a frame under the window."""
    if min(a.shape) < win:
        return None
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x, (win, win)).reshape(-1, win * win)
    x, y = view(a), view(b)
    mx, my = x.mean(1), y.mean(1)
    n = win * win / (win * win - 1)
    vx, vy, c = n * (x.var(1)), n * (y.var(1)), n * ((x * y).mean(1) - mx * my)
    c1, c2 = 0.01**2, 0.03**2
    return float((((2 * mx * my + c1) * (2 * c + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


def curl(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """|du/dy - dv/dx|, central differences with one-sided edges."""
    return np.abs(np.gradient(u, axis=0) - np.gradient(v, axis=1))


def iou(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over labels of either map of intersection over union."""
    values = [((a == x) & (b == x)).sum() / ((a == x) | (b == x)).sum() for x in np.union1d(a, b)]
    return float(np.mean(values)) if values else 0.0

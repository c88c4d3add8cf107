"""Image features and signature candidates from pixels, in numpy, for use in Arrow functions."""

from __future__ import annotations

import numpy as np


def _resized(grey: np.ndarray, size: int) -> np.ndarray:
    """Area means over a size x size grid."""
    rows, cols = (np.linspace(0, n, size + 1) for n in grey.shape[:2])
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)

    def at(r, c):
        r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
        r1, c1 = np.minimum(r0 + 1, grey.shape[0]), np.minimum(c0 + 1, grey.shape[1])
        fr, fc = (r - r0)[:, None], (c - c0)[None, :]
        return total[np.ix_(r0, c0)] * (1 - fr) * (1 - fc) + total[np.ix_(r1, c0)] * fr * (1 - fc) + total[np.ix_(r0, c1)] * (1 - fr) * fc + total[np.ix_(r1, c1)] * fr * fc

    corners = at(rows, cols)
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / ((rows[1:] - rows[:-1])[:, None] * (cols[1:] - cols[:-1])[None, :])


def _cosines(n: int, count: int) -> np.ndarray:
    k, x = np.arange(count)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


def perceptual_hash(rgb: np.ndarray) -> str:
    """16 hex digits: low frequencies of the grey 32 x 32 image against the median of all but the first."""
    grey = _resized(rgb.astype(float) @ np.array([0.299, 0.587, 0.114]), 32)
    basis = _cosines(32, 8)
    low = (basis @ grey @ basis.T).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def mean_rgb(rgb: np.ndarray) -> list[int]:
    return [int(x) for x in np.rint([_resized(rgb[..., c].astype(float), 32).mean() for c in range(3)])]


def _labels(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Connected regions (8 neighbours) by union-find over runs."""
    runs, root = _runs(mask)
    label = np.zeros(mask.shape, int)
    kept, own = np.unique(root, return_inverse=True)
    for (r, a, b), k in zip(runs.tolist(), (own + 1).tolist(), strict=True):
        label[r, a:b] = k
    return label, len(kept)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start, stop) of all runs of a mask, and the first run of the region (8 neighbours) that each belongs to."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    steps = np.diff(padded, axis=1)
    (row, start), stop = np.nonzero(steps > 0), np.nonzero(steps < 0)[1]
    # runs of the row above that touch one, by their place in the order of all runs
    wide = mask.shape[1] + 2
    first = np.searchsorted(row * wide + stop, (row - 1) * wide + start)
    last = np.searchsorted(row * wide + start, (row - 1) * wide + stop, "right")
    parent = list(range(len(row)))
    for k, (lo, hi) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        for x in range(lo, hi):
            a, b = k, x
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            parent[max(a, b)] = min(a, b)
    for k, x in enumerate(parent):  # a parent comes before its runs
        parent[k] = parent[x]
    return np.stack([row, start, stop], 1), np.array(parent, int)


def _grown(mask: np.ndarray, by: int) -> np.ndarray:
    """Dilation by a disc of radius `by`."""
    out = np.zeros_like(mask)
    padded = np.pad(mask, by)
    for dr in range(-by, by + 1):
        for dc in range(-by, by + 1):
            if dr * dr + dc * dc <= by * by + 1:
                out |= padded[by + dr : by + dr + mask.shape[0], by + dc : by + dc + mask.shape[1]]
    return out


def quality_flags(box: tuple[int, int, int, int], shape: tuple[int, ...], fill: float) -> list[str]:
    x, y, w, h = box
    flags = ["clipped"] if x <= 3 or y <= 3 or x + w >= shape[1] - 3 or y + h >= shape[0] - 3 else []
    return [*flags, *(["low_opacity"] if fill < 0.10 else [])]


def seal_candidates(rgb: np.ndarray) -> list[dict]:
    """Regions of saturated red or blue that are as large and as wide as a seal."""
    r, g, b = (np.ascontiguousarray(rgb[..., c], np.int32) for c in range(3))
    value = np.maximum(np.maximum(r, g), b)
    spread = value - np.minimum(np.minimum(r, g), b)
    saturated = (spread * 255 >= 55 * np.maximum(value, 1)) & (value >= 45)
    red = saturated & (r == value) & (np.abs(g - b) * 3 <= spread)
    blue = saturated & (b == value) & (r <= g + spread // 3)
    out, area = [], rgb.shape[0] * rgb.shape[1]
    for colour, mask in (("red", red), ("blue", blue)):
        if not mask.any():
            continue
        closed = ~_grown(~_grown(mask, 2), 2)
        runs, root = _runs(closed)
        for k in np.unique(root):
            own = runs[root == k]
            x, y, size = int(own[:, 1].min()), int(own[0, 0]), int((own[:, 2] - own[:, 1]).sum())
            w, h = int(own[:, 2].max()) - x, int(own[-1, 0]) - y + 1
            if size < max(60, 0.0004 * area) or size > 0.35 * area or min(w, h) < 12 or not 0.35 <= w / h <= 2.8:
                continue
            fill = float(mask[y : y + h, x : x + w].mean())
            score = min(1.0, 0.45 + 0.30 * min(1.0, fill / 0.35) + 0.25 * (1 - abs(w - h) / max(w, h)))
            out.append({"kind": "seal", "colour": colour, "bbox": (x, y, w, h), "confidence": round(score, 4), "quality_flags": quality_flags((x, y, w, h), rgb.shape, fill)})
    return sorted(out, key=lambda c: (-c["confidence"], c["bbox"]))


def _otsu(grey: np.ndarray) -> float:
    counts = np.bincount(grey.ravel(), minlength=256).astype(float)
    weight, mass = counts.cumsum(), (counts * np.arange(256)).cumsum()
    other = weight[-1] - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        between = weight * other * (mass / weight - (mass[-1] - mass) / other) ** 2
    return float(np.nanargmax(between)) if np.isfinite(between).any() else 127.0


def ink_candidate(rgb: np.ndarray, roi: tuple[int, int, int, int]) -> dict | None:
    """Handwriting in a given region: a share of ink between .002 and .45 that spreads over both directions."""
    x, y, w, h = roi
    part = rgb[y : y + h, x : x + w]
    if not part.size:
        return None
    grey = (part.astype(float) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    ink = grey <= min(_otsu(grey), 200)
    ratio = float(ink.mean())
    if not 0.002 <= ratio <= 0.45:
        return None
    rows, cols = np.nonzero(ink)
    spread = (np.ptp(rows) + 1) * (np.ptp(cols) + 1) / ink.size
    if spread < 0.03:
        return None
    box = (x + int(cols.min()), y + int(rows.min()), int(np.ptp(cols)) + 1, int(np.ptp(rows)) + 1)
    return {"kind": "signature", "colour": "ink", "bbox": box, "confidence": round(min(1.0, 0.5 + 0.3 * min(1.0, ratio / 0.05) + 0.2 * min(1.0, spread / 0.5)), 4), "quality_flags": quality_flags(box, rgb.shape, ratio / spread)}


def detect(rgb: np.ndarray | None, roi: tuple[int, int, int, int] | None = None) -> dict:
    """Status and candidates; it never raises."""
    try:
        if rgb is None or rgb.ndim != 3 or rgb.shape[-1] != 3:
            return {"status": "failed", "candidates": []}
        ink = ink_candidate(rgb, roi) if roi else None
        return {"status": "ok", "candidates": [*seal_candidates(rgb), *([ink] if ink else [])]}
    except Exception:
        return {"status": "failed", "candidates": []}

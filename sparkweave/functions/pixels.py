"""Kernels on pixels, in NumPy: pictures are height x width x 3 arrays of 8 bits in the order red, green, blue.

Borders repeat by reflection without the edge itself. Every kernel takes pictures of any size from 1 x 1 on.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Weights of the channels in a grey value, in thousandths; means and deviations of the usual training pictures.
GREY = (299, 587, 114)
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def to_bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def grey(img: np.ndarray) -> np.ndarray:
    return (img.astype(np.int64) @ np.array(GREY) + 500) // 1000


def padded(a: np.ndarray, n: int) -> np.ndarray:
    """n more rows and columns on each side, reflected as often as needed."""

    def at(size: int) -> np.ndarray:
        period = max(1, 2 * size - 2)
        i = np.arange(-n, size + n) % period
        return np.minimum(i, period - i) if size > 1 else np.zeros_like(i)

    return a[at(a.shape[0])][:, at(a.shape[1])]


def windows(a: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(padded(a, n), (2 * n + 1, 2 * n + 1), axis=(0, 1))


def correlate(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return np.einsum("yx...ij,ij->yx...", windows(a.astype(float), kernel.shape[0] // 2), kernel)


def laplacian(g: np.ndarray) -> np.ndarray:
    p = padded(g, 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g


def median(a: np.ndarray, n: int = 2) -> np.ndarray:
    return np.median(windows(a, n), axis=(-2, -1))


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian, one axis after the other."""
    n = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-np.square(np.arange(-n, n + 1)) / (2 * sigma * sigma))
    k /= k.sum()
    p = padded(a.astype(float), n)
    p = sum(k[i] * p[i : i + a.shape[0]] for i in range(2 * n + 1))
    return sum(k[i] * p[:, i : i + a.shape[1]] for i in range(2 * n + 1))


def spread(mask: np.ndarray) -> np.ndarray:
    """The mask and its eight neighbours."""
    p = np.pad(mask, 1)
    return np.logical_or.reduce([p[y : y + mask.shape[0], x : x + mask.shape[1]] for y in range(3) for x in range(3)])


def edges(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Ridges of the gradient above low that touch one above high."""
    across = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    dx, dy = correlate(g, across), correlate(g, across.T)
    size = np.abs(dx) + np.abs(dy)
    sector = np.round(np.arctan2(dy, dx) / (np.pi / 4)).astype(int) % 4
    p = np.pad(size, 1)
    h, w = size.shape
    ridge = np.zeros(size.shape, bool)
    for s, (y, x) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead, behind = p[1 + y : 1 + y + h, 1 + x : 1 + x + w], p[1 - y : 1 - y + h, 1 - x : 1 - x + w]
        ridge |= (sector == s) & (size > behind) & (size >= ahead)
    weak, kept = ridge & (size > low), ridge & (size > high)
    while (grown := spread(kept) & weak).sum() > kept.sum():
        kept = grown
    return kept


def components(mask: np.ndarray) -> np.ndarray:
    """Label of each pixel's 4-connected component, 0 outside; labels run to and fro until none changes."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(labels, 1)
        new = np.where(mask, np.maximum.reduce([labels, p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]), 0)
        new = np.where(mask, np.maximum(new, np.append(0, new.ravel())[new]), 0)
        if (new == labels).all():
            return labels
        labels = new


def largest(mask: np.ndarray) -> np.ndarray:
    labels = components(mask)
    sizes = np.bincount(labels.ravel())
    sizes[0] = 0
    return labels == sizes.argmax() if sizes.max() else mask


def hsv(img: np.ndarray) -> np.ndarray:
    """Hue 0 to 180, saturation and value 0 to 255."""
    x = img.astype(float)
    most, least = x.max(-1), x.min(-1)
    span = np.maximum(most - least, 1e-12)
    r, g, b = np.moveaxis(x, -1, 0)
    hue = np.select([most == least, most == r, most == g], [np.zeros_like(most), ((g - b) / span) % 6, (b - r) / span + 2], (r - g) / span + 4)
    return np.stack([hue * 30, np.where(most > 0, (most - least) / np.maximum(most, 1e-12), 0) * 255, most], -1)


def from_hsv(x: np.ndarray) -> np.ndarray:
    hue, s, v = x[..., 0] / 30 % 6, x[..., 1] / 255, x[..., 2]
    parts = [(n + hue) % 6 for n in (5, 3, 1)]
    return to_bytes(np.stack([v - v * s * np.clip(np.minimum(k, 4 - k), 0, 1) for k in parts], -1))


def variance(a: np.ndarray) -> float:
    """Of whole numbers, exact up to the one division."""
    x = a.astype(np.int64).ravel()
    n, total, squares = x.size, int(x.sum()), int((x * x).sum())
    return (n * squares - total * total) / (n * n)


def quality(img: np.ndarray) -> dict[str, float]:
    g = grey(img)
    return {"blur": variance(laplacian(g)), "brightness": float(g.mean()), "contrast": variance(g) ** 0.5, "noise": variance(g - median(g)) ** 0.5, "edges": float(edges(g).mean()), "cast": float(np.std(img.reshape(-1, 3).mean(0)))}


def noise_by_median(g: np.ndarray) -> float:
    """Median absolute deviation of what a 3 x 3 high pass leaves, as a deviation; 0 below 3 x 3 pixels."""
    if min(g.shape) < 3:
        return 0.0
    high = 9 * g - windows(g, 1).sum((-2, -1))
    return float(np.median(np.abs(high - np.median(high))) / 0.6745)


def asset_metrics(img: np.ndarray) -> dict[str, float]:
    """Scores for validation: blur (0 to 100), brightness and contrast in per cent, noise, content (50 to 100)."""
    g, x = grey(img), hsv(img)
    green = ((x[..., 0] >= 35) & (x[..., 0] <= 85) & (x[..., 1] >= 40) & (x[..., 2] >= 40)).mean()
    content = 50.0 + (30 if green > 0.2 else 15 if green > 0.1 else 0) + (20 if 0.05 < edges(g).mean() < 0.3 else 0)
    return {"blur": min(100.0, float(laplacian(g).var()) / 10), "brightness": float(g.mean()) / 255 * 100, "contrast": float(g.std()) / 128 * 100, "noise": noise_by_median(g), "content": content}


# --- foreground -----------------------------------------------------------------------------------------------------


def otsu(g: np.ndarray) -> int:
    """The least threshold with the greatest variance between the pixels up to it and those above."""
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    low, high = w, w[-1] - w
    between = np.where((low > 0) & (high > 0), (m * w[-1] - m[-1] * w) ** 2 / np.maximum(low * high, 1e-12), 0)
    return int(between.argmax())


def foreground_otsu(img: np.ndarray) -> np.ndarray:
    """The darker part: leaves lie on light ground."""
    g = grey(img)
    return largest(g <= otsu(g))


def foreground_clusters(img: np.ndarray, k: int = 3, rounds: int = 10) -> np.ndarray:
    """What isn't in the largest of k clusters of colours; the centres start at even ranks of grey."""
    x = img.reshape(-1, 3).astype(float)
    centres = x[np.argsort(grey(img).ravel(), kind="stable")[((np.arange(k) + 0.5) / k * len(x)).astype(int)]]
    for _ in range(rounds):
        near = ((x[:, None] - centres) ** 2).sum(-1).argmin(1)
        centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(k)])
    return (near != np.bincount(near, minlength=k).argmax()).reshape(img.shape[:2])


def foreground_probability(img: np.ndarray) -> np.ndarray:
    """Hue near green .3, saturation .3, texture .2, edges .2; each 0 to 1."""
    x, g = hsv(img), grey(img)
    rough = np.abs(laplacian(g)).astype(float)
    return 0.3 * ((x[..., 0] >= 25) & (x[..., 0] <= 95)) + 0.3 * x[..., 1] / 255 + 0.2 * rough / max(1.0, rough.max()) + 0.2 * spread(edges(g))


FOREGROUNDS = {"otsu": foreground_otsu, "clusters": foreground_clusters, "probability": lambda img: largest(foreground_probability(img) > 0.4)}


def foreground(img: np.ndarray) -> tuple[str, np.ndarray]:
    """The method whose share of foreground is nearest one half; of equals the first."""
    masks = {m: f(img) for m, f in FOREGROUNDS.items()}
    best = min(masks, key=lambda m: abs(masks[m].mean() - 0.5))
    return best, masks[best]


def on_white(img: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.where(mask[..., None], img, np.uint8(255))


def angle(mask: np.ndarray) -> float:
    """Degrees from the vertical to the long axis of the mask's second moments, in (-90, 90]; 0 where there is none."""
    y, x = np.nonzero(mask)
    if len(y) < 2:
        return 0.0
    (a, b), (_, d) = np.cov(np.stack([x, y]), bias=True)
    out = float(np.degrees(0.5 * np.arctan2(2 * b, a - d))) - 90
    return 0.0 if abs(a - d) + abs(b) < 1e-9 else out + 180 if out <= -90 else out


def box_angle(mask: np.ndarray) -> float:
    """Of the turn in whole degrees that gives the least bounding box; of equals the smallest."""
    y, x = np.nonzero(mask)
    turns = np.array(sorted(range(-44, 46), key=abs))
    t = np.radians(turns)
    u, v = np.outer(np.cos(t), x) + np.outer(np.sin(t), y), np.outer(np.cos(t), y) - np.outer(np.sin(t), x)
    return float(turns[np.round(np.ptp(u, axis=1) * np.ptp(v, axis=1), 6).argmin()]) if len(y) else 0.0


def voted_angle(mask: np.ndarray) -> float:
    """Axis of the mask's outline .3, of its moments .5, of its least box .2."""
    outline = mask & spread(~np.pad(mask, 1))[1:-1, 1:-1]
    return 0.3 * angle(outline) + 0.5 * angle(mask) + 0.2 * box_angle(mask)


def shape(img: np.ndarray, mask: np.ndarray) -> dict[str, float]:
    """aspect (height by width), complexity (outline squared by 4 pi area), mean hue, texture 0 to 1."""
    y, x = np.nonzero(mask)
    inner = mask & ~spread(~np.pad(mask, 1))[1:-1, 1:-1]
    around, area = float((mask & ~inner).sum()), float(mask.sum())
    known = area > 100
    return {"aspect": float(np.ptp(y) + 1) / float(np.ptp(x) + 1) if known else 1.0, "complexity": around**2 / (4 * np.pi * area) if known else 0.0, "hue": float(hsv(img)[..., 0].mean()), "texture": min(float(laplacian(grey(img)).var()) / 1000, 1.0)}


# --- corrections ----------------------------------------------------------------------------------------------------


def moved(img: np.ndarray, inverse: np.ndarray, fill: float = 255) -> np.ndarray:
    """Bilinear: the pixel (y, x) comes from inverse @ (x, y, 1) of the source; homogeneous."""
    h, w = img.shape[:2]
    y, x = np.mgrid[:h, :w]
    u, v, s = np.tensordot(inverse, np.stack([x, y, np.ones_like(x)]), 1)
    return sampled(img, v / s, u / s, fill)


def sampled(img: np.ndarray, y: np.ndarray, x: np.ndarray, fill: float = 255) -> np.ndarray:
    src = np.pad(img.astype(float), ((1, 1), (1, 1), (0, 0)), constant_values=fill)
    y, x = np.clip(y + 1, 0, img.shape[0] + 1), np.clip(x + 1, 0, img.shape[1] + 1)
    y0, x0 = np.minimum(y.astype(int), img.shape[0]), np.minimum(x.astype(int), img.shape[1])
    fy, fx = (y - y0)[..., None], (x - x0)[..., None]
    top, low = src[y0, x0] * (1 - fx) + src[y0, x0 + 1] * fx, src[y0 + 1, x0] * (1 - fx) + src[y0 + 1, x0 + 1] * fx
    return to_bytes(top * (1 - fy) + low * fy)


def about_centre(img: np.ndarray, m: np.ndarray) -> np.ndarray:
    cy, cx = (img.shape[0] - 1) / 2, (img.shape[1] - 1) / 2
    return np.array([[1, 0, cx], [0, 1, cy], [0, 0, 1]]) @ m @ np.array([[1, 0, -cx], [0, 1, -cy], [0, 0, 1]])


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    t = np.radians(degrees)
    return moved(img, about_centre(img, np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])))


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    y = np.clip((np.arange(height) + 0.5) * img.shape[0] / height - 0.5, 0, img.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * img.shape[1] / width - 0.5, 0, img.shape[1] - 1)
    return sampled(img, *np.meshgrid(y, x, indexing="ij"))


def resize_within(img: np.ndarray, most: int) -> np.ndarray:
    by = most / max(img.shape[:2])
    return img if by >= 1 else resize(img, max(1, round(img.shape[0] * by)), max(1, round(img.shape[1] * by)))


def upright(img: np.ndarray, least: float = 5.0) -> np.ndarray:
    turn = voted_angle(foreground(img)[1])
    return rotate(img, turn) if abs(turn) > least else img


def sharpen(img: np.ndarray, strength: float = 1.5) -> np.ndarray:
    return to_bytes(strength * img.astype(float) + (1 - strength) * blur(img, 1.0))


def denoise(img: np.ndarray, strength: float = 10.0) -> np.ndarray:
    """Means over a 5 x 5 search window, weighted by the likeness of 3 x 3 patches."""
    x = img.astype(float)
    total, weight = np.zeros_like(x), np.zeros(img.shape[:2])
    p = padded(x, 2)
    for dy in range(5):
        for dx in range(5):
            other = p[dy : dy + img.shape[0], dx : dx + img.shape[1]]
            far = correlate(((x - other) ** 2).mean(-1), np.full((3, 3), 1 / 9))
            w = np.exp(-far / strength**2)
            total, weight = total + w[..., None] * other, weight + w
    return to_bytes(total / weight[..., None])


def gray_world(img: np.ndarray) -> np.ndarray:
    means = img.reshape(-1, 3).mean(0)
    return to_bytes(img * (means.mean() / np.maximum(means, 1e-8)))


def equalise(img: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of grey, tile by tile, blended between tiles; colours keep their ratio to grey."""
    g = grey(img)
    ny, nx = min(tiles, g.shape[0]), min(tiles, g.shape[1])
    rows, cols = np.array_split(np.arange(g.shape[0]), ny), np.array_split(np.arange(g.shape[1]), nx)
    maps = np.empty((ny, nx, 256))
    for i, r in enumerate(rows):
        for j, c in enumerate(cols):
            n = np.bincount(g[r][:, c].ravel(), minlength=256).astype(float)
            most = max(1.0, clip * n.sum() / 256)
            n = np.minimum(n, most) + np.maximum(n - most, 0).sum() / 256
            maps[i, j] = np.cumsum(n) / n.sum() * 255
    y = np.clip((np.arange(g.shape[0]) + 0.5) * ny / g.shape[0] - 0.5, 0, ny - 1)[:, None]
    x = np.clip((np.arange(g.shape[1]) + 0.5) * nx / g.shape[1] - 0.5, 0, nx - 1)[None]
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    fy, fx = y - y0, x - x0
    new = (maps[y0, x0, g] * (1 - fx) + maps[y0, x1, g] * fx) * (1 - fy) + (maps[y1, x0, g] * (1 - fx) + maps[y1, x1, g] * fx) * fy
    return to_bytes(img * (new / np.maximum(g, 1))[..., None])


def stretch(img: np.ndarray) -> np.ndarray:
    """Each channel to the whole range; a flat one stays."""
    low, high = img.reshape(-1, 3).min(0).astype(float), img.reshape(-1, 3).max(0).astype(float)
    return np.where(high > low, to_bytes((img - low) / np.maximum(high - low, 1) * 255), img).astype(np.uint8)


def brighten(img: np.ndarray, factor: float) -> np.ndarray:
    return to_bytes(img * factor)


def brightness_factor(mean: float, target: float = 128) -> float:
    return float(np.clip(target / mean, 0.5, 2.0)) if mean > 0 else 1.0


def contrast(img: np.ndarray, factor: float) -> np.ndarray:
    mean = np.floor(grey(img).mean() + 0.5)
    return to_bytes(mean + (img - mean) * factor)


def saturate(img: np.ndarray, factor: float) -> np.ndarray:
    g = grey(img)[..., None]
    return to_bytes(g + (img - g) * factor)


def blend_edges(img: np.ndarray, share: float = 0.3) -> np.ndarray:
    return to_bytes(img * (1 - share) + 255 * share * edges(grey(img))[..., None])


#: The steps a plan names.
STEPS = {
    "background": lambda x: on_white(x, foreground(x)[1]), "rotation": upright, "denoise": denoise, "denoise_query": lambda x: denoise(x, 12.0), "color_balance": gray_world, "clahe": equalise, "stretch": stretch,
    "brightness": lambda x: brighten(x, brightness_factor(x.mean())), "sharpen_strong": lambda x: sharpen(x, 2.0), "sharpen": lambda x: sharpen(x, 1.3), "contrast_strong": lambda x: contrast(x, 1.5),
    "contrast": lambda x: contrast(x, 1.2), "color": lambda x: saturate(x, 1.1), "edges": blend_edges,
}


def tensor(img: np.ndarray, size: int = 256, crop: int = 224) -> np.ndarray:
    """Resized, cut from the middle, normalised: 3 x crop x crop."""
    at = (size - crop) // 2
    x = resize(img, size, size)[at : at + crop, at : at + crop] / 255.0
    return np.moveaxis((x - CHANNEL_MEAN) / CHANNEL_STD, -1, 0)


def project(img: np.ndarray, dimension: int, seed: int = 42) -> np.ndarray:
    """The built-in extractor: a fixed random projection of the 16 x 16 picture, of unit length."""
    x = tensor(img, 16, 16).ravel()
    v = np.random.Generator(np.random.PCG64(seed)).standard_normal((dimension, len(x))) @ x
    return v / max(float(np.linalg.norm(v)), 1e-12)


def perceptual_hash(img: np.ndarray) -> int:
    """64 signs against the median of the lowest cosine terms of the 32 x 32 grey picture, as a signed number."""
    n = np.arange(32)
    basis = np.cos(np.pi / 32 * (n[None, :] + 0.5) * n[:8, None])
    low = (basis @ grey(resize(img, 32, 32)) @ basis.T).ravel()
    bits = np.packbits(low > np.median(low))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def thumbnail_hash(img: np.ndarray, side: int = 64) -> str:
    """SHA-256 of the bytes of the picture at side x side."""
    return hashlib.sha256(resize(img, side, side).tobytes()).hexdigest()


# --- augmentation ---------------------------------------------------------------------------------------------------


def _between(r: np.random.Generator, low: float, high: float) -> float:
    return float(r.uniform(low, high))


def _scale(x: np.ndarray, r: np.random.Generator) -> np.ndarray:
    s = 1 / _between(r, 0.8, 1.2)
    return moved(x, about_centre(x, np.diag([s, s, 1.0])))


def _crop(x: np.ndarray, r: np.random.Generator, share: float = 0.9) -> np.ndarray:
    h, w = max(1, int(x.shape[0] * share)), max(1, int(x.shape[1] * share))
    y, c = int(r.integers(x.shape[0] - h + 1)), int(r.integers(x.shape[1] - w + 1))
    return resize(x[y : y + h, c : c + w], *x.shape[:2])


def _hue(x: np.ndarray, r: np.random.Generator) -> np.ndarray:
    y = hsv(x)
    y[..., 0] = (y[..., 0] + _between(r, -20, 20)) % 180
    return from_hsv(y)


def _cutout(x: np.ndarray, r: np.random.Generator) -> np.ndarray:
    n = min(x.shape[:2]) // 8
    y, c = int(r.integers(x.shape[0] - n + 1)), int(r.integers(x.shape[1] - n + 1))
    out = x.copy()
    out[y : y + n, c : c + n] = 0
    return out


def _perspective(x: np.ndarray, r: np.random.Generator, share: float = 0.1) -> np.ndarray:
    """The corners move by up to a share of the shorter side; the map back solves the eight equations of its corners."""
    h, w = x.shape[:2]
    if min(h, w) < 2:
        return x
    src = np.array([[0, 0], [w - 1, 0], [0, h - 1], [w - 1, h - 1]], float)
    dst = src + r.uniform(-1, 1, src.shape) * share * min(h, w) * 0.5
    rows = [[[u, v, 1, 0, 0, 0, -a * u, -a * v], [0, 0, 0, u, v, 1, -b * u, -b * v]] for (u, v), (a, b) in zip(dst, src, strict=True)]
    m = np.linalg.lstsq(np.array(rows).reshape(8, 8), src.ravel(), rcond=None)[0]
    return moved(x, np.append(m, 1.0).reshape(3, 3))


def _elastic(x: np.ndarray, r: np.random.Generator, alpha: float = 50.0, sigma: float = 5.0) -> np.ndarray:
    y, c = np.mgrid[: x.shape[0], : x.shape[1]]
    shift = [blur(r.uniform(-1, 1, x.shape[:2]), sigma) * alpha for _ in range(2)]
    return sampled(x, y + shift[0], c + shift[1])


AUGMENT = {
    "rotation": lambda x, r: rotate(x, _between(r, -45, 45)), "flip_horizontal": lambda x, r: x[:, ::-1], "flip_vertical": lambda x, r: x[::-1], "scale": _scale, "crop": _crop,
    "brightness": lambda x, r: brighten(x, _between(r, 0.7, 1.3)), "contrast": lambda x, r: contrast(x, _between(r, 0.7, 1.3)), "saturation": lambda x, r: saturate(x, _between(r, 0.7, 1.3)), "hue": _hue,
    "gaussian_noise": lambda x, r: to_bytes(x + r.normal(0, 5, x.shape)), "gaussian_blur": lambda x, r: to_bytes(blur(x, _between(r, 0.5, 2.0))), "sharpen": lambda x, r: sharpen(x, _between(r, 1.0, 2.0)),
    "cutout": _cutout, "perspective": _perspective, "elastic": _elastic,
}


def mixup(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    return to_bytes(share * a + (1 - share) * resize(b, *a.shape[:2]))


def cutmix(a: np.ndarray, b: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """A rectangle with 1 - share of the area comes from b."""
    h, w = (int(n * np.sqrt(1 - share)) for n in a.shape[:2])
    y, x = int(rng.integers(a.shape[0] - h + 1)), int(rng.integers(a.shape[1] - w + 1))
    out = a.copy()
    out[y : y + h, x : x + w] = resize(b, *a.shape[:2])[y : y + h, x : x + w]
    return out
